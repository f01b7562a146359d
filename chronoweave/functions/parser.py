"""Triplets from model output: one text to any number of rows.

Two formats are read: JSON arrays of five strings anywhere in the text, else, only if there is none, parenthesised
tuples with balanced inner parentheses. Cutting is sequential and runs in an Arrow-batched map; normalisation and
validity are native columns on what it yields.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ontology import normal_relation, normal_type
from chronoweave.functions.text import is_numeric

#: A quoted string: plain runs, with an escaped character between any two.
_STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
#: Escapes and what they stand for, in the order in which they are undone.
_ESCAPES = (('\\"', '"'), ("\\n", " "), ("\\\\", "\\"))
_FIVE = re.compile(r"\[\s*" + r"\s*,\s*".join([_STRING] * 5) + r"\s*\]")
FIELDS = tuple("h h_type r o o_type".split())


def tuples(text: str):
    """The inside of each outermost pair of parentheses; an open one at the end gives nothing."""
    depth, start = 0, 0
    for m in re.finditer(r"[()]", text):
        if m[0] == "(":
            if not depth:
                start = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield text[start : m.start()]


def fields(inside: str) -> list[str]:
    """Fields between quote-comma-quote, so that apostrophes within a name stay; else between commas."""
    inside = inside.strip()
    quote = inside[:1]
    if quote in ("'", '"'):
        parts = re.split(rf"{quote}\s*,\s*{quote}", inside)
        if len(parts) == len(FIELDS):
            inner = parts[1:-1]
            return [x.strip() for x in (parts[0].removeprefix(quote), *inner, parts[-1].removesuffix(quote))]
    return [_bare(x) for x in inside.split(",")]


def _bare(value: str) -> str:
    """Without blanks and quotes around it."""
    value = value.strip()
    return value.strip("\"'").strip()


def _unescaped(value: str) -> str:
    for written, meant in _ESCAPES:
        value = value.replace(written, meant)
    return value.strip()


def quintuples(text: str | None) -> list[tuple[str, ...]]:
    """Raw (h, h_type, r, o, o_type) with non-empty ends."""
    text = text or ""
    found = [tuple(map(_unescaped, m.groups())) for m in _FIVE.finditer(text)]
    found = [f for f in found if f[0] and f[3]]
    if found:
        return found
    cut = [tuple(fields(t)) for t in tuples(text)]
    return [f for f in cut if len(f) == 5 and f[0].strip() and f[3].strip()]


def triplets(completions: DataFrame, raw: str = "raw") -> DataFrame:
    """completions' columns but ``raw`` with h, h_type, r, o, o_type, valid: a row a triplet.

    Types and relations that have no canonical form stay as they are; such a row, or one with a bare number for an
    end, is not valid.
    """
    keep = [c for c in completions.columns if c != raw]
    item = pa.struct([(f, pa.string()) for f in FIELDS])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(raw)).to_pylist()
            rows = [[dict(zip(FIELDS, q)) for q in quintuples(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(rows, pa.list_(item))],
                names=[*keep, "__found"],
            )

    struct = ", ".join(f"{f}: string" for f in FIELDS)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in completions.select(*keep).schema.fields)
    found = completions.mapInArrow(run, f"{kept}, __found array<struct<{struct}>>")
    rows = found.select(*keep, F.inline("__found"))
    types = [normal_type(F.col("h_type")), normal_relation(F.col("r")), normal_type(F.col("o_type"))]
    valid = types[0].isNotNull() & types[1].isNotNull() & types[2].isNotNull() & ~is_numeric(F.col("h")) & ~is_numeric(F.col("o"))
    return rows.select(
        *keep,
        "h",
        F.coalesce(types[0], "h_type").alias("h_type"),
        F.coalesce(types[1], "r").alias("r"),
        "o",
        F.coalesce(types[2], "o_type").alias("o_type"),
        valid.alias("valid"),
    )


def extraction_stats(completions: DataFrame, raw: str = "raw") -> DataFrame:
    """id, n_parsed, n_valid, malformed (nothing parsed), raw_len of every completion (id, raw)."""
    parsed = triplets(completions.select("id", raw), raw).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_parsed"), F.count_if("valid").alias("n_valid")
    )
    return completions.join(parsed, "id", "left").fillna(0, ["n_parsed", "n_valid"]).select(
        "id",
        "n_parsed",
        "n_valid",
        (F.col("n_parsed") == 0).alias("malformed"),
        F.coalesce(F.length(raw), F.lit(0)).alias("raw_len"),
    )


def complete(prompts: DataFrame, client_factory, prompt: str = "prompt") -> DataFrame:
    """prompts with ``raw``: ``client_factory()`` gives, once a task, a function from a list of prompts to answers.

    This is the place of any batch model; Arrow batches bound what a call gets.
    """
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches):
        answer = client_factory()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(answer(texts), pa.string())], names=[*batch.schema.names, "raw"]
            )

    return prompts.mapInArrow(run, f"{keep}, raw string")
