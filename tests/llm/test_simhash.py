import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from chronoweave.llm import simhash
from tests.conftest import data_dir


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words, word = [], b""
    for b in low + b" ":
        if b == 0x20 or 9 <= b <= 13:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([b])
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)].append(doc)
    return [min(ids[find(i)], default=None) for i in range(len(rows))]


def test_fingerprints_follow_the_definition():
    texts = ["", "  \n", "One", "a b c", "A b C d", "a b c d e " * 30, "é ß x y z w\x0bq", "x" * 5000]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("rows", [10, 10**7, 10**9, 10**12])
def test_masks_cover_all_pairs_within_the_radius(rows):
    rng = random.Random(rows)
    masks = simhash.key_masks(rows, 4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert any((a ^ b) & m == 0 for m in masks)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(900)], np.uint64)
    fp = np.unique(base[rng.integers(0, 40, 900)] ^ flips)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    edges = simhash.forest(fp, 4)
    assert all(bin(int(fp[a] ^ fp[b])).count("1") <= 4 for a, b in edges)
    rows = [(i, int(f)) for i, f in enumerate(fp)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(rows))] == slow_components(rows)


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_components_against_brute_force(spark, bucket_rows):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{data_dir()}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9002, ""), (None, docs[3][1]), (None, "lonely words of nobody else here"), docs[5], docs[5]]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bucket_rows=bucket_rows).collect()
    rows = [(d, slow_fingerprint(t)) for d, t in docs]
    want = sorted(((d, f, c) for (d, f), c in zip(rows, slow_components(rows))), key=repr)
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == want


def test_a_large_group_of_near_copies(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words) + f" tail{k % 90}") for k in range(1500)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=40)
    flat = [(r[0], r[1] % 2**64) for r in got.collect()]
    distinct = sorted({f for _, f in flat})
    least = {f: min(d for d, g in flat if g == f) for f in distinct}
    want = slow_components([(least[f], f) for f in distinct])
    by = dict(zip(distinct, want))
    assert {r[0]: r[2] for r in got.collect()} == {d: by[f] for d, f in flat}


def test_survivors_keep_all_columns_and_one_row_a_group(spark):
    rows = [(2, "same text of five words", 1), (1, "same text of five words", 2), (1, "same text of five words", 3), (7, None, 4), (None, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = sorted((tuple(r) for r in simhash.survivors(docs).collect()), key=repr)
    assert [k[1:] for k in kept if k[1]] == [("same text of five words", k[2]) for k in kept if k[1]]
    assert len(kept) == 2 and kept[0][0] in (1, None) and docs.columns == simhash.survivors(docs).columns


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
