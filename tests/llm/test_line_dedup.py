import random
import re

import pytest

from chronoweave.llm import line_dedup


def slow(rows, least=8):
    """Texts after deletion, straight from the definition. rows: (doc_id, text)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seqs = []
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        seqs.append([(p, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)])
    first, gone = {}, [set() for _ in rows]
    runs = []
    for s, seq in enumerate(seqs):
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                if sum(x[2] for x in seq[i:j]) >= least:
                    run = tuple(x[1] for x in seq[i:j])
                    first.setdefault(run, (s, i))
                    runs.append((run, s, i, j))
    for run, s, i, j in runs:
        if first[run] < (s, i):
            gone[order[s]] |= {x[0] for x in seqs[s][i:j]}
    return [
        (d, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k])) for k, (d, t) in enumerate(rows)
    ]


def run(spark, rows, least=8):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, gone string").coalesce(1)
    out = line_dedup.dedup(docs, least)
    assert out.columns == docs.columns
    return [(r.doc_id, r.text) for r in out.collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    lines = ["a b c", "d e f g h i j k l", "one", "", " \t", "two words", "a b c d", "x y z x y z x", "é ß"]
    rows = []
    for k in range(60):
        rows.append((rng.choice([k, k, k, 5, None]), "\n".join(rng.choice(lines[: rng.choice([3, 9])]) for _ in range(rng.randint(0, 12)))))
    rows += [(200, None), (201, ""), rows[0], rows[1], (300, "\n".join(["one"] * 40)), (301, "\n".join(["one"] * 17))]
    assert sorted(run(spark, rows), key=repr) == sorted(slow(rows), key=repr)


def test_long_windows_need_more_doublings(spark):
    body = [f"w{k}" for k in range(50)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["new", *body[5:45], "end"])), (3, "\n".join(body[10:20]))]
    assert sorted(run(spark, rows, 30)) == sorted(slow(rows, 30))
    assert dict(run(spark, rows, 30))[2] == "new\nend"


def test_a_common_line_and_many_copies(spark):
    line = "this very common line has eight words here"
    rows = [(k, f"own start number {k}\n{line}\nown end of number {k} here it is") for k in range(400)]
    rows += [(1000 + k, "copied text\nof two lines with many words in it") for k in range(200)]
    got = dict(run(spark, rows))
    assert got[0] == rows[0][1] and all(line not in got[k] and f"number {k}" in got[k] for k in range(1, 400))
    assert got[1000] == rows[400][1] and all(got[1000 + k] == "" for k in range(1, 200))


def test_empty_table_and_report(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(docs, report=True).collect() == []
