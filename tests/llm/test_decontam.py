from collections import Counter

import numpy as np

from chronoweave.llm import decontam
from tests.conftest import data_dir


def words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if text else []


def shingles(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def slow(docs, items):
    out = {}
    for row, (_, text) in enumerate(docs):
        w = [x for x in words((text or "").replace("\n", " ").replace("\t", " ")) if x]
        for item, passage in items:
            p = [x for x in words((passage or "").replace("\n", " ")) if x]
            if len(p) < 5:
                continue
            s = shingles(p)
            for k in range(len(w) - len(p) + 1):
                x = shingles(w[k : k + len(p)])
                both = sum((x & s).values())
                share = both / (sum(x.values()) + sum(s.values()) - both)
                if share >= 0.8:
                    out[row, item] = max(out.get((row, item), 0), share)
    return out


def test_all_windows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(300)]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, draw(int(rng.integers(5, 60)))) for k in range(40)] + [(90, None), (91, "four words are few"), (92, "")]
    items.append((93, items[0][1]))
    docs = []
    for k in range(120):
        parts = [draw(int(rng.integers(0, 80)))]
        if k % 3:
            passage = items[int(rng.integers(0, 40))][1].split(" ")
            for _ in range(k % 4):
                passage[int(rng.integers(0, len(passage)))] = "changed"
            parts.append(" ".join(passage).title() if k % 2 else " ".join(passage))
        docs.append((k, " \n".join([*parts, draw(20)])))
    docs += [(500, None), (501, ""), (None, "x " + items[3][1]), (3, docs[4][1]), (3, docs[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontam.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow(docs, items)
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == Counter(
        (docs[row][0], item, round(share, 9)) for (row, item), share in want.items()
    )
    assert len(want) > 30


def test_groups_of_items_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{data_dir('sf0.01')}/documents.parquet")
    items = spark.read.parquet(f"{data_dir('sf0.01')}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "GROUP_BYTES", 3000)
    monkeypatch.setattr(decontam.groups, "__defaults__", (7,))
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == whole and whole


def test_clean_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{data_dir('sf0.01')}/documents.parquet").withColumnRenamed("source", "item_id")
    items = spark.read.parquet(f"{data_dir('sf0.01')}/benchmark.parquet")
    hit = {r.doc_id for r in decontam.matches(docs, items).collect()}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - hit


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64)
    q = np.concatenate([f ^ np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (0, 7, 19, 20)], np.uint64) for f in fps])
    got = set(zip(*[x.tolist() for x in decontam.Hamming(fps).within(q)]))
    want = {(i, j) for i in range(len(q)) for j in range(len(fps)) if int(q[i] ^ fps[j]).bit_count() <= decontam.RADIUS}
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(docs, none).collect() == [] and decontam.clean(docs, none).count() == 1
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.matches(docs.limit(0), items).collect() == [] and decontam.clean(docs, items).count() == 0


def test_texts_shorter_than_the_item_against_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [(k, " ".join(rng.choice([f"v{j}" for j in range(300)], int(rng.integers(5, 60))))) for k in range(40)]
    docs = []
    for _, text in items:
        passage = text.split(" ")
        for cut in (1, 2, 4, 8, 12):
            docs += [(len(docs), " ".join(passage[:-cut])), (len(docs) + 1, " ".join(passage[cut:]).title())]
    want = {}
    for doc, text in docs:
        x = shingles(words(text))
        for item, passage in items:
            s = shingles(words(passage))
            both = sum((x & s).values())
            share = both / (sum(x.values()) + sum(s.values()) - both)
            if share >= 0.8 and len(words(text)) < len(words(passage)):
                want[doc, item] = len(words(text)), round(share, 9)
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, round(r.similarity, 9)) for r in decontam.matches(frame, benchmark).collect()}
    assert got == want and len(want) > 60
    assert {r.doc_id for r in decontam.clean(frame, benchmark).collect()} == {d for d, _ in docs} - {d for d, _ in want}
