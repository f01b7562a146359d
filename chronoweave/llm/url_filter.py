"""URL rules by a bit-parallel wildcard automaton.

Every rule becomes glob patterns over ``host NUL path``; all patterns are packed into one multiword Shift-And machine
that is stepped for all URLs of an Arrow batch together, one byte position at a time.

Glob syntax: ``*`` any bytes but NUL, ``**`` any bytes, ``?`` one byte other than NUL; anything else stands for itself.
Patterns are anchored at both ends.

Defined cases: a null url, or one without ``://``, has an empty host and path, so only patterns that accept a lone NUL
can fit. An empty table gives an empty result; of equally long rules that fit, a block rule wins, then the rule first in
text order. Columns of the input other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import buffers, table

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs that block what no rule decides.
BLOCK_GLOBS = (
    "*cheap-pills*\0**",
    "*casino-win*\0**",
    "*adult-x*\0**",
    "*spam-farm*\0**",
    "*ads-track*\0**",
    "*free-bets*\0**",
)


@dataclass
class Machine:
    """Masks of all patterns, packed one after another into 64-bit words."""

    chars: np.ndarray  # [256, words]: states that a byte may enter
    loops: np.ndarray  # [256, words]: states that a byte may stay in
    first: np.ndarray  # [words]: start states
    final: list[tuple[int, int]]  # of each pattern: word and bit of its last state
    words: int

    @classmethod
    def build(cls, patterns: list[str]) -> Machine:
        sizes = [len(_tokens(p)) + 1 for p in patterns]
        words = max(1, -(-sum(sizes) // 64))
        chars = np.zeros((256, words * 64), bool)
        loops = np.zeros((256, words * 64), bool)
        first = np.zeros(words * 64, bool)
        final, at = [], 0
        anything = np.arange(256) > 0
        for p in patterns:
            first[at] = True
            for kind, byte, star in _tokens(p, lead := [0]):
                at += 1
                chars[:, at] = anything if kind == "any" else np.arange(256) == byte
                loops[:, at] = True if star == 2 else anything if star == 1 else False
            start = at - len(_tokens(p))
            loops[:, start] = True if lead[0] == 2 else anything if lead[0] == 1 else False
            final.append(divmod(at, 64))
            at += 1

        def pack(x: np.ndarray) -> np.ndarray:
            return np.packbits(x, axis=-1, bitorder="little").view(np.uint64)

        return cls(pack(chars), pack(loops), pack(first[None])[0], final, words)

    def accepts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, patterns]: which patterns fit each whole text. Texts go longest first, so that ended ones drop out."""
        n, length = len(offsets) - 1, np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begins, sizes = offsets[:-1][order], length[order]
        state = np.repeat(self.first[None], n, 0)
        for t in range(int(sizes[0]) if n else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))
            byte = data[begins[:live] + t]
            old = state[:live]
            step = old << np.uint64(1)
            step[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:live] = step & self.chars[byte] | old & self.loops[byte]
        out = np.empty((n, len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return out


def _tokens(pattern: str, lead: list[int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, byte, stars that follow) of each state after the start; ``lead`` gets the stars before the first."""
    out: list[tuple[str, int, int]] = []
    for b in pattern.encode():
        if b == ord("*"):
            if out:
                out[-1] = (*out[-1][:2], min(2, out[-1][2] + 1))
            elif lead is not None:
                lead[0] = min(2, lead[0] + 1)
        else:
            out.append(("any", 0, 0) if b == ord("?") else ("is", b, 0))
    return out


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; these are native expressions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("_rest", F.coalesce(rest, F.lit(""))).select(
        *df.columns,
        F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), upper, lower).alias("host"),
        F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def judge(
    urls: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    block_globs: tuple[str, ...] = BLOCK_GLOBS,
    allow_globs: tuple[str, ...] = (),
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict of each url: the longest rule that fits, else the globs, else ``default``."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    patterns = [p for _, host, path in ranked for p in (f"{host}\0{path}**", f"*.{host}\0{path}**")]
    machine = Machine.build([*patterns, *block_globs, *allow_globs])
    names, verdicts = [h + p for _, h, p in ranked], [v for v, _, _ in ranked]
    n_rules, n_block = len(ranked), len(block_globs)
    schema = "page_id long, host string, path string, rule string, verdict string"

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.get_field_index("canonical")))
            hit = machine.accepts(data, offsets)
            by_rule = hit[:, 0 : 2 * n_rules : 2] | hit[:, 1 : 2 * n_rules : 2]
            fits = by_rule.any(1)
            which = by_rule.argmax(1) if n_rules else np.zeros(len(hit), int)
            globs = hit[:, 2 * n_rules :]
            blocked, allowed = globs[:, :n_block].any(1), globs[:, n_block:].any(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([names[k] if f else None for k, f in zip(which, fits)], pa.string()),
                    pa.array(
                        [
                            verdicts[k] if f else "block" if b and not a else "allow" if a else default
                            for k, f, b, a in zip(which, fits, blocked, allowed)
                        ],
                        pa.string(),
                    ),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    canonical = F.concat("host", F.lit("\0"), "path").alias("canonical")
    source = parts(urls.select(F.col("page_id").cast("long"), "url")).select("page_id", "host", "path", canonical)
    return source.mapInArrow(run, schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, h, s)),
m AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v FROM p, r
      WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host,
       'cheap-pills|casino-win|adult-x|spam-farm|ads-track|free-bets') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
