import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoweave.operators import bursts, embedding, evaluation, filters, stats, temporal, themes
from chronoweave.streaming import lifelines as stream_lines
from chronoweave.streaming import windows
from chronoweave.operators.runtime import scratch
from tests.conftest import data_dir

STEP = [2] * 10 + [10] * 6 + [2] * 4


def step_series(spark):
    return spark.createDataFrame([("x", t, n) for t, n in enumerate(STEP)], "key string, time int, n long")


def test_detectors_on_a_step(spark):
    assert [(a, b, round(i, 6)) for a, b, i in bursts.automaton_bursts(STEP)] == [(10, 15, 33.6)]
    assert [(a, b, round(i, 6)) for a, b, i in bursts.changepoint_bursts(STEP)] == [(9, 14, 25.6)]
    assert bursts.changepoint_bursts(STEP, onset_offset=1)[0][:2] == (10, 15)
    got = [(r.start, r.end, round(r.intensity, 6)) for r in bursts.cusum(step_series(spark)).collect()]
    assert got == [(10, 19, 24.0)]
    assert [tuple(r)[:3] for r in bursts.automaton(step_series(spark)).collect()] == [("x", 10, 15)]
    row = bursts.catalogue(step_series(spark), bursts.automaton(step_series(spark))).first()
    assert (row.peak, row.weeks) == (10, 6)
    assert bursts.automaton_bursts([]) == bursts.automaton_bursts([0, 0]) == bursts.changepoint_bursts([0]) == []


def test_cusum_against_a_loop(spark):
    rng = np.random.default_rng(4)
    series = {f"k{k}": rng.poisson(3, 80) + (np.arange(80) % 23 > 18) * rng.poisson(9, 80) for k in range(6)}
    rows = [(k, t, int(n)) for k, x in series.items() for t, n in enumerate(x)]
    got = sorted((r.key, r.start, r.end, round(r.intensity, 6)) for r in bursts.cusum(spark.createDataFrame(rows, "key string, time int, n long")).collect())
    want = []
    for k, x in series.items():
        c, start, hot = 0.0, None, False
        z = (x - x.mean()) / (x.std() + 1e-9)
        for t in range(80):
            c = max(0.0, c + z[t] - 0.5)
            start = t if c > 1e-12 and start is None else start
            hot |= c >= 5
            if c <= 1e-12 and start is not None:
                if hot:
                    want.append((k, start, t - 1, round(float((x[start:t] - x.mean()).sum()), 6)))
                start, hot = None, False
        if start is not None and hot:
            want.append((k, start, 79, round(float((x[start:] - x.mean()).sum()), 6)))
    assert got == sorted(want)


def test_surprise_against_dense_arrays(spark):
    rng = np.random.default_rng(1)
    dense = rng.poisson(0.3, (5, 90))
    rows = [(f"e{e}", t, int(n)) for e in range(5) for t, n in enumerate(dense[e]) if n]
    got = {(r.ent, r.time): r.z for r in temporal.surprise(spark.createDataFrame(rows, "ent string, time int, n long"), 90).collect()}
    for e in range(5):
        for t in range(30, 90):
            obs, base = dense[e, t - 3 : t + 1].sum(), dense[e, t - 29 : t - 3].sum()
            z = (obs - base * 4 / 26) / math.sqrt(base * 4 / 26 + 1)
            assert abs(got.get((f"e{e}", t), 0.0) - z) < 1e-9
    flat = spark.createDataFrame([(6, 0)], "obs int, base int").select(temporal.excess_columns(alpha=9.9)[2]).first()[0]
    assert flat == 6


def test_louvain_finds_cliques_and_is_a_partition():
    links = [(a, b, 1.0) for c in (0, 5, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 5, 0.1), (9, 10, 0.1)]
    found = themes.louvain(15, links)
    assert [len(set(found[c : c + 5])) for c in (0, 5, 10)] == [1, 1, 1] and len(set(found)) == 3
    assert themes.louvain(3, []).tolist() == [0, 1, 2] and len(themes.louvain(0, [])) == 0


def test_equal_overlap_continues_the_latest_lifeline():
    lines = themes.Lifelines()
    m = lambda *names: [(n, 1.0, 0) for n in names]
    lines.week(0, [(1, 2.0, m("a", "b")), (2, 2.0, m("c", "d"))])
    out = lines.week(1, [(1, 5.0, m("a", "b", "c", "d"))])
    assert out[0]["theme"] == 1 and lines.known[1]["peak"] == 5.0 and lines.known[0]["weeks"] == 1
    # live lifelines before dead ones, whatever the overlap
    lines = themes.Lifelines()
    lines.week(0, [(1, 1.0, m("a", "b", "c"))])
    lines.week(20, [(1, 1.0, m("a", "x", "y"))])
    assert themes.Lifelines().week(0, [(1, 1.0, [("a", 3.0, 5), ("b", 1.0, 0)])])[0]["size"] == 2


def test_streamed_lifelines_equal_the_fold(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(12):
        for rank in range(1, 4):
            names = sorted(f"e{k}" for k in rng.choice(9, 4, replace=False))
            rows.append((t, rank, float(10 - rank), [(n, float(rng.integers(1, 9)), int(rng.integers(0, 3))) for n in names]))
    schema = "time int, rank int, score double, members array<struct<ent:string,excess:double,prior_episodes:long>>"
    frame = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, themes.theme_weeks(frame).collect()))
    path = scratch(spark, "clusters")
    for t in range(12):
        frame.where(F.col("time") == t).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = windows.run_available(stream_lines.theme_weeks(stream), "append", "lines")
    assert sorted(map(tuple, got.collect())) == want
    assert themes.lifelines(frame).count() == len({w[0] for w in want})


def test_streamed_surprise_equals_the_batch(spark):
    rows = [(f"e{e}", t, int((t * 7 + e) % 5 == 0) + int(t % 11 == e)) for e in range(3) for t in range(70)]
    frame = spark.createDataFrame([r for r in rows if r[2]], "ent string, time int, n long")
    path = scratch(spark, "counts")
    for a in range(0, 70, 10):
        frame.where((F.col("time") >= a) & (F.col("time") < a + 10)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.ent, r.time): round(r.z, 9) for r in windows.run_available(stream_lines.surprise(stream), "append", "surprise").collect()}
    last = {r.ent: r.m for r in frame.groupBy("ent").agg(F.max("time").alias("m")).collect()}
    want = {(r.ent, r.time): round(r.z, 9) for r in temporal.surprise(frame, 70).collect() if r.time <= last[r.ent]}
    assert got == want


def test_intervals_and_tails(spark):
    rows = spark.createDataFrame([(107, 282), (109, 244)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n")))
    assert [(round(r[0], 4), round(r[1], 4)) for r in rows.collect()] == [(0.3248, 0.4373), (0.3856, 0.5094)]
    assert abs(stats.detection_tail([0.5, 0.5], 1) - 0.75) < 1e-12 and stats.detection_tail([0.1], 0) == 1
    rng = np.random.default_rng(0)
    chances = rng.random(10) * 0.4
    sims = (rng.random((200_000, 10)) < chances).sum(1)
    assert abs(stats.detection_tail(list(chances), 4) - (sims >= 4).mean()) < 0.01
    observed, p = stats.permutation_p(np.arange(100.0), [99, 98], rounds=2000)
    assert observed == 98.5 and p < 0.01


def test_bootstrap_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("v"))
    a, b = stats.bootstrap(rows, "v", "id", 100).first(), stats.bootstrap(rows.repartition(7), "v", "id", 100).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b)) and a.lo < a["mean"] < a.hi


def test_learned_filters(spark):
    rng = np.random.default_rng(0)
    rows = [(k, k % 10, 2015 + k % 10, float(k % 2), float(k % 2 * 3 + rng.normal()), float(rng.normal())) for k in range(200)]
    frame = spark.createDataFrame(rows, "id int, g int, year int, label double, a double, b double")
    scored = filters.grouped_cv(frame, ["a", "b"], "label", "g", folds=3)
    assert scored.count() == 200
    auc = stats.roc_auc(scored.select("score", F.col("label").cast("int").alias("label"))).first()[0]
    assert auc > 0.9
    held = filters.temporal_holdout(frame, ["a", "b"], "label", "year", 2022, "boosted")
    assert {r.year for r in held.collect()} == {2022, 2023, 2024}


def test_complex_factors_learn_and_rank():
    rng = np.random.default_rng(0)
    triples = np.array([(s, s % 2, (s * 3 + 1) % 20) for s in range(20)])
    model = embedding.ComplexFactors(20, 2, 16, seed=1)
    before = (1 / model.ranks(triples)).mean()
    after = (1 / model.fit(triples, epochs=150, batch=8, rate=0.05).ranks(triples)[:, 0]).mean()
    assert after > 0.9 > before
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    small = embedding.ComplexFactors(5, 2, 3, seed=2)
    grads = {k: np.zeros_like(v) for k, v in small.p.items()}
    s, r, o = rng.integers(0, 5, 6), rng.integers(0, 2, 6), rng.integers(0, 5, 6)
    small._object_grads(s, r, o, grads)

    def loss():
        z = small.objects(s, r)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(6), o]).mean())

    for k in small.p:
        for at in [(0, 0), (1, 2)]:
            keep = small.p[k][at]
            small.p[k][at] = keep + 1e-6
            up = loss()
            small.p[k][at] = keep - 1e-6
            down = loss()
            small.p[k][at] = keep
            assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-5


def test_event_recovery_on_a_step(spark):
    events = spark.createDataFrame([("x", 12), ("x", 3), ("y", 5)], "key string, week int")
    found = bursts.automaton(step_series(spark))
    got = {(r.key, r.week): (r.hit, round(r.chance, 3), r.error) for r in evaluation.event_recovery(events, found, step_series(spark), 20).collect()}
    assert got == {("x", 12): (True, 0.6, -2), ("x", 3): (False, 0.6, 7), ("y", 5): (False, 0.0, None)}


def test_late_rows_count_in_their_own_week(spark):
    rows = [("2024-01-08", "a"), ("2024-01-03", "a"), ("2024-01-14", "a")]
    path = scratch(spark, "late")
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, k string").coalesce(1).write.mode("append").json(f"{path}/{k}")
    stream = spark.readStream.schema("ts string, k string").option("maxFilesPerTrigger", 1).json(f"{path}/*")
    got = windows.run_available(windows.tumbling_counts(stream, "ts", "k"), "complete", "late")
    assert {(str(r.bucket), r.n) for r in got.collect()} == {("2024-01-01", 1), ("2024-01-08", 2)}


def test_batch_and_stream_counts_agree(spark):
    rows = windows.run_available(windows.tumbling_counts(windows.stream_table(spark, data_dir(), "events"), "ts", "event_type"))
    assert rows.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data_dir()}/events.parquet").count()
    assert pd.Timestamp(rows.agg(F.min("bucket")).first()[0]).weekday() == 0


def test_stretches_are_few_and_cover_what_a_row_a_week_would(spark):
    """A lone formation is two stretches of trailing sums, not thirty rows, and sums equal a count by hand."""
    import random

    lone = temporal.trailing(spark.createDataFrame([("a", 10, 3)], "ent string, time int, n long"), 100).collect()
    assert sorted((r.start, r.stop, r.obs, r.base) for r in lone) == [(10, 13, 3, 0), (14, 39, 0, 3)]
    rng = random.Random(1)
    rows = sorted({(rng.choice("ab"), rng.randrange(50)): rng.randint(1, 4) for _ in range(25)}.items())
    frame = spark.createDataFrame([(*k, n) for k, n in rows], "ent string, time int, n long")
    total = lambda e, lo, hi: sum(n for (x, w), n in rows if x == e and lo <= w <= hi)
    got = {(r.ent, r.time): r.velocity for r in temporal.entity_velocity(frame, 50).collect()}
    assert got == {(e, t): total(e, t - 4, t + 3) for e in "ab" for t in range(50) if total(e, t - 4, t + 3)}
    blocked = temporal.surprise(frame, 50)
    strict = themes.candidates(blocked, frame, None, True, -99.0, 0)
    want = {(r.ent, r.time) for r in blocked.collect()}
    assert {(r.ent, r.time) for r in strict.collect()} == want


def test_cooccurrence_meets_only_weeks_of_candidates(spark):
    cands = spark.createDataFrame([("a", 5), ("b", 5), ("b", 6), ("a", 9), ("b", 9)], "ent string, time int")
    edges = spark.createDataFrame([("a", "r", "b", 2, 4), ("b", "s", "a", 5, 1), ("a", "r", "a", 5, 7), ("a", "r", "c", 5, 9)], "subj string, rel string, obj string, time int, weight long")
    got = {(r.time, r.a, r.b): r.weight for r in themes.cooccurrence(cands, edges).collect()}
    assert got == {(5, "a", "b"): 5, (9, "a", "b"): 5}


def test_louvain_solves_components_by_themselves():
    """Two far parts give what each gives under the same whole weight; small ones are left as single nodes."""
    ring = [(i, (i + 1) % 6, 1.0) for i in range(6)]
    both = ring + [(a + 6, b + 6, w) for a, b, w in ring] + [(12, 13, 5.0)]
    found = themes.louvain(14, both, size_least=3).tolist()
    same = themes._component(6, ring, 1.0, 2.0 * (12 + 5)).tolist()
    assert found[:6] == same and [x - found[6] for x in found[6:12]] == same and found[12] != found[13]


def test_lifelines_count_shared_entities_once_each(monkeypatch):
    """Overlap comes from one pass over a cluster's entities; no set of a lifeline's members is built."""
    lines = themes.Lifelines()
    lines.week(1, [(1, 3.0, [(e, 1.0, 0) for e in "abcd"]), (2, 2.0, [(e, 1.0, 0) for e in "wxyz"])])

    class Whole(set):
        def __rand__(self, other):
            raise AssertionError("members are gone through")

        __ror__ = __rand__

    for line in lines.known.values():
        line["members"] = Whole(line["members"])
    out = lines.week(2, [(1, 2.0, [(e, 1.0, 1) for e in "cdwxyz"])])
    assert [o["theme"] for o in out] == [1]


def test_vector_searches_hold_tiles_of_scores(spark, monkeypatch):
    """Small tiles, several blocks of queries and equal vectors give what a whole matrix gives."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 5)), 2)
    x[40:50] = x[:10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    monkeypatch.setattr(embedding, "QUERY_BYTES", 400)
    tiles = embedding._tiles(30, 1_000_000)
    assert len(tiles) >= 15 and max(t.stop - t.start for t in tiles) * 1_000_000 <= embedding.TILE
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    got = sorted(map(tuple, embedding.cosine_top(rows.where("vec_id % 3 = 0"), rows, 4).collect()))
    want = []
    for q in range(0, 90, 3):
        s = np.round(unit[q] @ unit.T, 6)
        want += sorted((q, int(c), float(s[c])) for c in sorted((c for c in range(90) if c != q), key=lambda c: (-s[c], c))[:4])
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    ranks = {r.q: r["rank"] for r in embedding.bilinear_ranks(rows.where("vec_id % 3 = 0").selectExpr("vec_id", "embedding", "(vec_id + 1) % 90 AS true_id"), rows, places=6).collect()}
    for q in range(0, 90, 3):
        s = np.round(x[q] @ x.T, 6)
        mine = s[(q + 1) % 90]
        assert ranks[q] == 1 + (s > mine).sum() + ((s == mine).sum() - 1) / 2


def test_automaton_of_many_series_is_that_of_each(spark):
    rng = np.random.default_rng(4)
    counts = rng.poisson(1.0, (60, 80)) * (rng.random((60, 80)) < 0.4)
    counts[:20, 30:36] += 6
    rows = [(f"e{i}", int(t), int(counts[i, t])) for i in range(60) for t in np.flatnonzero(counts[i])]
    frame = spark.createDataFrame(rows, "ent string, time int, n long")
    got = sorted((r.key, r.start, r.end, r.intensity, r.peak, r.weeks) for r in bursts.automaton_catalogue(frame, 80).collect())
    want = []
    for i, c in enumerate(counts):
        if c.sum() >= bursts.LEAST_TOTAL:
            want += [(f"e{i}", a, b, x, a + int(c[a : b + 1].argmax()), b - a + 1) for a, b, x in bursts.automaton_bursts(c)]
    assert len(want) >= 20 and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def test_jaccard_blocks_equal_the_join(spark, monkeypatch):
    from chronoweave.operators import canonical

    rng = np.random.default_rng(6)
    rows = [(f"u{i}", f"m{m}") for i in range(60) for m in rng.integers(0, 25, rng.integers(0, 12)).tolist()]
    rows += [("u1", None), ("u2", None)]
    frame = spark.createDataFrame(rows, "id string, member string")
    want = sorted(map(tuple, canonical._joined_pairs(frame.distinct(), 0.2).collect()))
    for name, small in (("BLOCK", 25), ("TILE", 7), ("MEMBERS", 4)):
        monkeypatch.setattr(canonical, name, small)
    monkeypatch.setattr(canonical, "_joined_pairs", None)
    assert sorted(map(tuple, canonical.jaccard_pairs(frame, 0.2).collect())) == want and len(want) > 50


def test_recurrence_ranks_meet_no_history(spark):
    """Ranks come from windows: no query is joined with its group's earlier rows."""
    from chronoweave.operators import linkpred

    rows = [("a", "r", "x", 1), ("a", "r", "y", 2), ("a", "r", "x", 3), ("a", "r", "x", 5), ("a", "r", "z", 5), ("a", "r", "y", 5)]
    found = linkpred.recurrence_ranks(spark.createDataFrame(rows, "subj string, rel string, obj string, time int"), 5, 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.obj: r["rank"] for r in found.collect() if r.direction == "object"}
    assert got == {"x": 1.0, "y": 2.0, "z": 1 + 2 + (10 - 2 - 1) / 2}
