import math

import numpy as np
import pytest

from chronoweave.llm import ball_tree


def slow(rows, k=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (dims - len(v))) for i, v in ok]
    out = []
    queries = {}
    for i, v in ok:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, x in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf", "block"), [(16_384, 512, 32_768), (60, 8, 3)])
def test_against_brute_force(spark, monkeypatch, shard, leaf, block):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", shard)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", leaf)
    monkeypatch.setattr(ball_tree, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 6) for i in range(150)]  # many equal vectors and ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (2080, []), (2100, [0.5, -0.5])]
    rows += [(None, [0.1] * 6), (-20, [0.3] * 6), (40, [9.0] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ball_tree.top_k(frame).collect())
    assert got == slow(rows)


def test_few_rows_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 1, 32 * 64), (0, 2, 2, -64 * 64)]
    assert ball_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (12, 8))
    x = np.round(np.repeat(centres, 200, 0) + rng.normal(0, 2, (2400, 8)))
    ids = np.arange(2400)
    tree = ball_tree.BallTree(ids, x.copy())
    q = x[::100]
    got, scores = tree.search(ids[::100], q, np.full(24, -np.inf), 5)
    full = q @ x.T
    full[np.arange(24), ids[::100]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :5]
    assert (got == want).all() and (scores == np.take_along_axis(full, want, 1)).all()


def exact(rows, k=20):
    """Whole-number scores of any size by plain Python."""
    def whole(x):
        return int(x) * 64 if abs(x) >= 2.0**47 else math.floor(64 * x)

    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    out = []
    for q, a in ints:
        if q % 20 == 0:
            best = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, r + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [1e7, 1e30, 1e300, 1.7e308])
def test_components_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * (size / 4 if k % 3 == 0 else 1)).clip(-size, size).tolist()) for k in range(150)]
    rows += [(200 + k, [size, -size, 0.0, 1.0, size, 0.25]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df).collect()) == exact(rows)


def test_queries_skip_far_shards(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.01 * rng.normal(size=16)).tolist()) for k in range(4000)]
    seen, reached = [], ball_tree._reached
    monkeypatch.setattr(ball_tree, "_reached", lambda *a: seen.append(reached(*a)) or seen[-1])
    got = ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == exact(rows)
    # 200 queries and some 40 shards
    assert seen[0].count() < 200 * 10


def test_equal_vectors_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 20)
    rows = [(k, [0.5, -0.25]) for k in range(200)] + [(300 + k, [k / 64, 1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df).collect()) == exact(rows)
