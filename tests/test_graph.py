import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import canonical, dedup, graph, linkpred, sampling, temporal
from chronoweave.operators.runtime import fixpoint, indexed

EDGES = "subj string, rel string, obj string, time int, weight long"


def edges(spark, rows):
    return spark.createDataFrame([(s, "r", o, t, w) for s, o, t, w in rows], EDGES)


def mentions(spark, days):
    rows = [(k, dt.datetime.fromisoformat(d), "A", "r", "B") for k, d in enumerate(days)]
    return spark.createDataFrame(rows, "article int, ts timestamp_ntz, head string, relation string, tail string")


def test_weeks_start_on_monday_and_gaps_take_no_id(spark):
    rows = graph.bucketed(mentions(spark, ["2024-01-07T12:00:00", "2024-01-08T00:00:00", "2024-01-22T01:00:00"]))
    got = {(str(r.bucket), r.time) for r in graph.time_dictionary(rows).collect()}
    assert got == {("2024-01-01", 0), ("2024-01-08", 1), ("2024-01-22", 2)}


def test_fortnights_are_anchored_at_the_first_date(spark):
    rows = graph.bucketed(mentions(spark, ["2024-01-03T12:00:00", "2024-01-16T23:00:00", "2024-01-17T00:00:00"]), "fortnight")
    assert [str(r.bucket) for r in rows.orderBy("ts").collect()] == ["2024-01-03", "2024-01-03", "2024-01-17"]
    with pytest.raises(ValueError):
        graph.bucketed(rows, "year")


@pytest.mark.parametrize(("weeks", "bounds"), [(365, (255, 310)), (90, (62, 76)), (170, (118, 144))])
def test_split_bounds_truncate_doubles(spark, weeks, bounds):
    got = spark.range(1).select(*graph.split_bounds(F.lit(weeks))).first()
    assert got[0] == bounds[0] == int(weeks * 0.7) and got[1] == int(weeks * (0.7 + 0.15))


def test_a_path_vanishes_and_a_triangle_stays(spark):
    path = [(f"n{k}", f"n{k + 1}", 0, 2) for k in range(5)]
    triangle = [("a", "b", 0, 2), ("b", "c", 1, 2), ("a", "c", 2, 5), ("c", "low", 3, 1)]
    got = graph.degree_core(edges(spark, path + triangle), 2, 2)
    assert {(r.subj, r.obj) for r in got.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_self_loops_count_twice_until_dropped(spark):
    rows = edges(spark, [("a", "a", 0, 1), ("a", "b", 0, 1)])
    assert {(r.ent, r.degree) for r in graph.degrees(rows).collect()} == {("a", 3), ("b", 1)}
    assert graph.without_self_loops(rows).count() == 1


def test_majority_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a")], "k int, v string")
    assert {(r.k, r.v, r.votes) for r in graph.majority(rows, "k", "v").collect()} == {(1, "a", 1), (2, "z", 2)}


def test_indexed_is_dense_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(7)
    got = [(r.x, r.n) for r in indexed(rows, ["x"], "n", first=3).collect()]
    assert sorted(got) == [(k, k + 3) for k in range(5000)]
    assert indexed(rows.limit(0), ["x"], "n").count() == 0


def test_fixpoint_gives_up(spark):
    with pytest.raises(RuntimeError):
        fixpoint(spark.range(10), lambda d: d.where(F.col("id") < d.count() - 1), most=2)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = graph.connected_components(
        spark.createDataFrame([(n,) for n in {x for e in links for x in e} | {500}], "node long"),
        spark.createDataFrame(links, "a long, b long"),
    )
    assert {r.node: r.component for r in got.collect()} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {500: 500}


def test_later_weeks_change_nothing_before(spark):
    base = [("a", "b", 0, 1), ("a", "c", 1, 1), ("b", "c", 33, 1), ("a", "b", 34, 2), ("c", "d", 36, 1), ("a", "c", 36, 1)]
    more = [*base, ("a", "b", 40, 9), ("d", "a", 41, 1), ("c", "d", 44, 3)]

    def looks(rows):
        e = edges(spark, rows)
        series = temporal.entity_weeks(e)
        sur = temporal.surprise(series, 60).where("time <= 36").collect()
        hist = linkpred.with_history(e).where("time <= 36").collect()
        ranks = linkpred.recurrence_ranks(e, 30, 10).unionByName(
            linkpred.popularity_ranks(e, 30, 10).withColumn("seen", F.lit(0).cast("long"))
        )
        return sorted(map(tuple, sur)), sorted(map(tuple, hist)), sorted(map(tuple, ranks.where("time <= 36").collect()))

    assert looks(base) == looks(more)


def test_mean_ranks(spark):
    counts = spark.createDataFrame([(3, 0, 1, 3), (1, 1, 2, 3), (0, 0, 0, 3)], "s int, higher int, equal int, scored int")
    rank = linkpred.mean_rank(F.col("s"), F.col("higher"), F.col("equal"), F.col("scored"), 10)
    assert [r[0] for r in counts.select(rank).collect()] == [1, 2.5, 7]


def test_recurrence_ranks_against_a_replay(spark):
    import random

    rng = random.Random(3)
    quads = sorted({(rng.randrange(6), rng.randrange(2), rng.randrange(6), rng.randrange(12)) for _ in range(160)}, key=lambda q: q[3])
    frame = spark.createDataFrame([(str(s), str(r), str(o), t, 1) for s, r, o, t in quads], EDGES)
    pool, want = 9, {}
    for s, r, o, t in quads:
        if t >= 6:
            for d, true, same in (("object", o, lambda q: (q[0], q[1]) == (s, r) and q[2]), ("subject", s, lambda q: (q[2], q[1]) == (o, r) and q[0])):  # noqa: B023
                seen = {}
                for q in quads:
                    hit = same(q)
                    if q[3] < t and hit is not False:
                        seen[hit] = seen.get(hit, 0) + 1
                c = seen.get(true, 0)
                vals = list(seen.values())
                rank = 1 + sum(v > c for v in vals) + (vals.count(c) - 1) / 2 if c else 1 + len(vals) + (pool - len(vals) - 1) / 2
                want[str(s), str(r), str(o), t, d] = rank
    got = {(x.subj, x.rel, x.obj, x.time, x.direction): x["rank"] for x in linkpred.recurrence_ranks(frame, 6, pool).collect()}
    assert got == want


def test_alias_rules(spark):
    entities = spark.createDataFrame(
        [
            (1, "Apple Inc.", "COMP"), (2, "Apple", "COMP"), (3, "apple corp", "ORG"), (4, "Acme Holdings", "COMP"), (5, "Acme Ltd", "COMP"),
            (6, "Acme", "COMP"), (7, "Alphabet", "COMP"), (8, "Alphabet Class A", "COMP"), (9, "Co", "COMP"), (10, "Person X", "PERSON"), (11, "Blocked Inc", "COMP"), (12, "Blocked", "COMP"),
        ],
        "id long, name string, type string",
    )
    dominant = spark.createDataFrame(
        [("Acme Holdings", "COMP", "AC1"), ("Acme Ltd", "COMP", "AC2"), ("Alphabet", "COMP", "GOOG"), ("Alphabet Class A", "COMP", "GOOG")], "name string, type string, tag string"
    )
    titles = spark.createDataFrame([("Apple Inc", "AAPL", 0), ("apple", "XX", 1)], "title string, tag string, place int")
    blocked = spark.createDataFrame([("Blocked Inc",), ("Blocked",)], "name string")
    got = {r.id: r for r in canonical.alias_table(entities, dominant, titles, blocked).collect()}
    assert {i: got[i]["group"] for i in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12}
    assert got[1].tag == "AAPL" and got[3].tag is None and not got[9].mergeable and not got[10].mergeable
    groups = canonical.merge_groups(spark.createDataFrame([tuple(got[i]) for i in got], canonical.alias_table(entities, dominant, titles).schema),
                                    spark.createDataFrame([(2, 5), (1, 1)], "ent long, weight long"))
    assert {(r["group"], r.size, r.members) for r in groups.collect()} == {(1, 2, "Apple | Apple Inc."), (7, 2, "Alphabet | Alphabet Class A")}


def test_samples(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), "id")
    one = sampling.per_group_sample(rows, "g", "id", 10, seed=1).collect()
    two = sampling.per_group_sample(rows.repartition(9), "g", "id", 10, seed=1).collect()
    assert sorted(one) == sorted(two) and len(one) == 30
    assert sampling.simple_sample(rows, "id", 5, 2).count() == 5
    parts = [sampling.shard(rows, ["id"], 4, k) for k in range(4)]
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(2000))


def test_duplicates_and_templates(spark):
    rows = spark.createDataFrame([(k, f"AAPL rose {k}% in March", f"body {k}") for k in range(30)] + [(99, "Another title", "body x y")], "id int, title string, body string")
    flags = {r.id: r.templated for r in dedup.templated(rows, "title", "body", 25).collect()}
    assert all(flags[k] for k in range(30)) and not flags[99]
    same = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, "")], "id int, body string")
    assert {r.id for r in dedup.keep_first(same).collect()} == {1, 3} and {r.id for r in dedup.dropped(same).collect()} == {2, 4}
