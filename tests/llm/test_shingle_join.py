import numpy as np
import pytest

import corpus_pipeline
from chronoweave.llm import shingle_join, simhash
from tests.conftest import data_dir
from tests.llm.test_decontam import shingles
from tests.llm.test_simhash import slow_components


def brute_force(rows):
    """The row that is kept of each component of pairs with a Jaccard of 0.8 or more."""
    low = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() for _, t in rows]
    bags = [shingles(w) if len(w) >= 5 else shingles([" ".join(w)] * 5 if w else []) for w in low]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if 5 * both >= 4 * either:
                root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append((row[0] is not None, row[0], i))
    return sorted((rows[min(g)[2]] for g in groups.values()), key=repr)


def edited():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for base in range(25):
        text = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        for _ in range(int(rng.integers(1, 7))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 6))):
                at = int(rng.integers(0, len(copy)))
                copy[at : at + 1] = [[], ["new"], [copy[at], "more"]][int(rng.integers(0, 3))] or ["x"]
            rows.append((len(rows), " ".join(copy).title() if base % 2 else " \n".join(copy)))
    rows += [(900, None), (901, ""), (902, " "), (None, "four words are few"), (903, "Four words are few"), rows[3], rows[3]]
    rows += [(950 + k, "again and again " * k) for k in range(1, 30)]
    return rows


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_survivors_against_brute_force(spark, bucket_rows):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.survivors(docs, bucket_rows).collect()
    want = brute_force(rows)
    assert sorted(map(tuple, got), key=repr) == want and 20 < len(want) < len(rows) - 20


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    rows = [(k, f"{t} the license of all these texts is the same one") for k, t in edited()[:60]]
    monkeypatch.setattr(shingle_join, "HOT_TEXTS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, shingle_join.survivors(docs).collect()), key=repr) == brute_force(rows)


def test_the_stage_drops_copies_at_the_rule(spark):
    words = [f"w{k}" for k in range(104)]
    near, far = list(words), list(words)
    near[50] = near[90] = "changed"
    far[20] = far[50] = far[80] = "changed"
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0), (3, " ".join(far), "en", "s", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, columns), data_dir())
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_the_gray_index_links_what_is_within_its_radius(spark):
    rows = [(k, k, t) for k, (_, t) in enumerate(edited())]
    table = spark.createDataFrame(rows, "row long, doc_id long, text string")
    pairs = [tuple(r) for r in shingle_join.indexed(table, table.where("row <> 5")).collect()]
    root = {k: k for k, _, _ in rows if k != 5}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    prints = [(k, simhash.fingerprint((t or "").encode(), 5)) for k, _, t in rows if k != 5]
    assert [root[k] for k, _ in prints] == slow_components(prints) and len(pairs) > 20 and all(a < b for a, b in pairs)


def test_the_stage_goes_through_the_gray_index(spark, monkeypatch):
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius, *rest: asked.append(radius) or links(fps, radius, *rest))
    docs = spark.createDataFrame(edited(), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, data_dir()).collect()
    assert asked == [simhash.RADIUS] and sorted(map(tuple, kept), key=repr) == brute_force(edited())
