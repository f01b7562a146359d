import math
import re
import zlib
from collections import Counter

import numpy as np

from chronoweave.llm import lm_score

TEXTS = [
    "The cat sat on the mat", "the cat ran\ton the\x0bmat", None, "", "  \n", "a dog barked at the cat", "é ß É the CAT",
    *[f"the cat number {k % 7} sat on mat {k % 3}" for k in range(60)], "words nobody used before", "the " * 400,
]


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["</s>"]


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7


def expected(rows):
    """Base scores, and full scores with the weights learned here from plain dictionaries."""
    tok = [tokens(t) for _, t in rows]
    folds = [fold(d) for d, _ in rows]

    def counts(keep):
        one, two = Counter(), Counter()
        for t, f in zip(tok, folds):
            if keep(f):
                one.update(t)
                two.update(zip(["</s>", *t], t))
        return one, two

    one, two = counts(lambda f: f not in (2, 3))
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for t, f in zip(tok, folds):
        if f == 3:
            for h, w in zip(["</s>", *t], t):
                c, p = one[h], two[h, w]
                level = lambda a, b: round(-math.log2(a / b) * 8) if a else -1
                cells[(0 if not c else int(math.log2(c)) + 1, level(p, c), level(one[w], n))] += 1
    rows_ = np.array([(*k, m) for k, m in sorted(cells.items())], float).reshape(-1, 4)
    weights = lm_score.learn_weights(rows_, 1 / (v + 1))
    one, two = counts(lambda f: f != 2)
    n, v = sum(one.values()), len(one)
    out = []
    for (doc, _), t, f in zip(rows, tok, folds):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip(["</s>", *t], t):
            c = one[h]
            l2, l1, l0 = weights[0 if not c else int(math.log2(c)) + 1]
            score += math.log10(l2 * (two[h, w] / max(c, 1)) + l1 * one[w] / max(n, 1) + l0 / (v + 1))
        out.append((doc, f == 2, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6, (g, w)


def test_scores_against_plain_dictionaries(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (5, TEXTS[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    close([tuple(r) for r in lm_score.score(docs, shards=5).collect()], expected(rows))


def test_better_than_the_base_on_held_out_rows(spark):
    rows = [(k, f"every day at {k % 24} the train from town {k % 5} leaves") for k in range(300)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_counts_above_a_byte_come_back():
    counts = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert lm_score.unsmall(lm_score.small(counts), len(counts)).tolist() == counts.tolist()


def test_weights_are_distributions():
    cells = np.array([[3, 4, 60, 50], [3, -1, 12, 20], [0, -1, 9, 7]], float)
    weights = lm_score.learn_weights(cells, 0.01)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all() and weights[0, 0] == 0
    assert weights[3, 0] > weights[3, 1]


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
