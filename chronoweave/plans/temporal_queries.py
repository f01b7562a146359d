"""Formations, weekly series, velocity, surprise, bursts and theme candidates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import bursts, graph, temporal, themes
from chronoweave.operators.runtime import written
from chronoweave.plans.graph_queries import edges, stored_edges
from chronoweave.plans.registry import Registry, rounded
from chronoweave.sources.fixtures import GRAPH_SQL, table

R = Registry()
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CAL_SQL = "cal AS (SELECT CAST(unnest(generate_series(0, t - 1)) AS INTEGER) AS time FROM span)"


def n_times(rows) -> int:
    """Weeks of the calendar: one number."""
    return (rows.agg(F.max("time")).first()[0] or 0) + 1


@R.add(f"WITH {GRAPH_SQL} SELECT subj, rel, obj, time FROM forms")
def formations(spark, sf_dir):
    return temporal.formations(edges(spark, sf_dir))


@R.add(f"WITH {GRAPH_SQL} SELECT *, min(time) OVER (PARTITION BY subj, rel, obj) AS first FROM edges")
def formations_window(spark, sf_dir):
    return temporal.with_first_week(edges(spark, sf_dir))


@R.add(f"""WITH {GRAPH_SQL}, {CAL_SQL},
ends AS (SELECT DISTINCT ent, time FROM (SELECT subj AS ent, time FROM edges UNION ALL SELECT obj, time FROM edges)),
a AS (SELECT time, count(*) AS edge_instances FROM edges GROUP BY time), f AS (SELECT time, count(*) AS formations FROM forms GROUP BY time),
c AS (SELECT time, count(*) AS active_entities FROM ends GROUP BY time),
w AS (SELECT time, count(*) AS new_entities FROM (SELECT ent, min(time) AS time FROM ends GROUP BY ent) GROUP BY time),
j AS (SELECT cal.time, coalesce(edge_instances, 0) AS edge_instances, coalesce(formations, 0) AS formations,
coalesce(active_entities, 0) AS active_entities, coalesce(new_entities, 0) AS new_entities
FROM cal LEFT JOIN a USING (time) LEFT JOIN f USING (time) LEFT JOIN c USING (time) LEFT JOIN w USING (time))
SELECT j.*, CAST(sum(formations) OVER o AS BIGINT) AS cum_relationships, CAST(sum(new_entities) OVER o AS BIGINT) AS cum_entities,
CASE WHEN time < CAST(floor(t * CAST(0.7 AS DOUBLE)) AS INTEGER) THEN 'train' WHEN time < CAST(floor(t * CAST(0.85 AS DOUBLE)) AS INTEGER)
THEN 'valid' ELSE 'test' END AS split FROM j, span WINDOW o AS (ORDER BY time)""")
def weekly_stats(spark, sf_dir):
    return temporal.weekly_stats(stored_edges(spark, sf_dir))


_PIVOT = ", ".join(f"count(*) FILTER (WHERE rel = '{p}') AS \"{p}\"" for p in PRIORITIES)


@R.add(f"WITH {GRAPH_SQL}, {CAL_SQL} SELECT cal.time, {_PIVOT} FROM cal LEFT JOIN edges USING (time) GROUP BY cal.time")
def relation_mix_pivot(spark, sf_dir):
    return temporal.relation_counts(edges(spark, sf_dir), PRIORITIES)


@R.add(f"""WITH {GRAPH_SQL}, {CAL_SQL}, g AS (SELECT time, rel FROM cal, (SELECT DISTINCT rel FROM edges)),
c AS (SELECT time, rel, count(*) AS n FROM edges GROUP BY ALL),
j AS (SELECT g.time, g.rel, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.time = c.time AND g.rel = c.rel),
s AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY time), 0) AS share FROM j)
SELECT time, rel, n, round(share, 6) AS share,
round(avg(share) OVER (PARTITION BY rel ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS share_mean FROM s""")
def relation_mix_share(spark, sf_dir):
    return rounded(temporal.relation_share(edges(spark, sf_dir)), "share", "share_mean")


@R.add(f"""WITH {GRAPH_SQL}, {CAL_SQL}, s AS (SELECT cal.time, count(forms.time) AS n FROM cal LEFT JOIN forms USING (time) GROUP BY cal.time),
v AS (SELECT time, n, avg(n) OVER (ORDER BY time ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS velocity FROM s)
SELECT time, n, round(velocity, 6) AS velocity, round(velocity - lag(velocity) OVER (ORDER BY time), 6) AS acceleration FROM v""")
def velocity_global(spark, sf_dir):
    return rounded(temporal.global_velocity(stored_edges(spark, sf_dir)), "velocity", "acceleration")


_ROLL_SQL = """roll AS (SELECT ent, b.time + o.k AS time, CAST(sum(n) AS BIGINT) AS velocity FROM both_ends b,
(SELECT CAST(unnest(generate_series(-3, 4)) AS INTEGER) AS k) o, span WHERE b.time + o.k BETWEEN 0 AND t - 1 GROUP BY ALL)"""


@R.add(f"WITH {GRAPH_SQL}, {_ROLL_SQL} SELECT ent, CAST(time AS INTEGER) AS time, velocity FROM roll")
def velocity_entity(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return temporal.entity_velocity(temporal.entity_weeks(rows), n_times(rows))


@R.add(f"""WITH {GRAPH_SQL}, {_ROLL_SQL},
top AS (SELECT ent, max(velocity) AS peak, arg_max(time, (velocity, -time)) AS pk FROM roll GROUP BY ent),
dense AS (SELECT top.ent, peak, pk, c.time, coalesce(velocity, 0) AS velocity FROM top,
(SELECT CAST(unnest(generate_series(0, t - 1)) AS INTEGER) AS time FROM span) c LEFT JOIN roll ON roll.ent = top.ent AND roll.time = c.time),
m AS (SELECT ent, peak, avg(velocity) AS mu, stddev_pop(velocity) AS sd FROM dense WHERE abs(time - pk) > 8 GROUP BY ent, peak),
tot AS (SELECT ent, CAST(sum(n) AS BIGINT) AS total_formations, CAST(arg_max(time, (n, -time)) AS INTEGER) AS peak_week FROM both_ends GROUP BY ent)
SELECT ent, total_formations, peak AS peak_velocity, peak_week, round((peak - mu) / greatest(sd, 1), 6) AS burst_z FROM m JOIN tot USING (ent)""")
def burst_z(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return rounded(temporal.burst_scores(temporal.entity_weeks(rows), n_times(rows)), "burst_z")


@R.add(f"""WITH {GRAPH_SQL}, {_ROLL_SQL} SELECT ent, max(velocity) AS peak_velocity FROM roll GROUP BY ent ORDER BY 2 DESC, 1 LIMIT 20""")
def velocity_leaderboard(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return temporal.peak_velocity(temporal.entity_weeks(rows), n_times(rows)).orderBy(F.desc("peak_velocity"), "ent").limit(20)


@R.add(f"""WITH {GRAPH_SQL} SELECT rel, count(*) FILTER (WHERE time < t // 2) AS early, count(*) FILTER (WHERE time >= t // 2) AS late,
round(count(*) FILTER (WHERE time >= t // 2) / greatest(count(*) FILTER (WHERE time < t // 2), 1), 6) AS growth FROM forms, span GROUP BY rel""")
def relation_growth(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return rounded(temporal.relation_growth(rows, n_times(rows)), "growth")


_TRAIL_SQL = """trail AS (SELECT ent, b.time + o.k AS time, CAST(sum(CASE WHEN k < 4 THEN n ELSE 0 END) AS BIGINT) AS obs,
CAST(sum(CASE WHEN k >= 4 THEN n ELSE 0 END) AS BIGINT) AS base FROM both_ends b, (SELECT CAST(unnest(generate_series(0, 29)) AS INTEGER) AS k) o, span
WHERE b.time + o.k < t GROUP BY ALL)"""


def _surprise_sql(alpha: str, extra: str = "") -> str:
    return f"""WITH {GRAPH_SQL}, {_TRAIL_SQL}{extra}, x AS (SELECT ent, CAST(time AS INTEGER) AS time, obs, base * CAST(4 AS DOUBLE) / 26 AS e FROM trail WHERE time >= 30)
SELECT ent, time, obs, round(obs - e, 6) AS excess, round((obs - e) / sqrt(e + {alpha} * e * e + 1), 6) AS z FROM x"""


def _surprise(spark, sf_dir, alpha=0.0):
    rows = stored_edges(spark, sf_dir)
    return temporal.surprise(temporal.entity_weeks(rows), n_times(rows), alpha=alpha, places=6)


@R.add(_surprise_sql("0"))
def formation_surprise(spark, sf_dir):
    return _surprise(spark, sf_dir)


@R.add(_surprise_sql("3.748"))
def surprise_nb(spark, sf_dir):
    return _surprise(spark, sf_dir, 3.748)


@R.add(f"""WITH {GRAPH_SQL}, {_TRAIL_SQL}, x AS (SELECT ent, CAST(time AS INTEGER) AS time, obs, base * CAST(4 AS DOUBLE) / 26 AS e FROM trail)
SELECT ent, time, round(ln(1 + obs), 6) AS log_obs, round(ln(1 + e), 6) AS log_exp,
round(greatest(-10, least(10, (obs - e) / sqrt(e + 1))) / 10, 6) AS z_scaled FROM x""")
def surprise_features(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return temporal.surprise_features(temporal.entity_weeks(rows), n_times(rows), places=6)


_ALPHA_MEAN = 0.05


@R.add(f"""WITH {GRAPH_SQL}, k AS (SELECT CAST(floor(t * CAST(0.7 AS DOUBLE)) AS INTEGER) AS tr FROM span),
s AS (SELECT ent, sum(n) / max(tr) AS m, sum(n * n) / max(tr) AS q FROM both_ends, k WHERE time < tr GROUP BY ent)
SELECT round(median((q - m * m - m) / greatest(m * m, 1e-9)), 6) AS alpha, count(*) AS n_entities FROM s WHERE m >= {_ALPHA_MEAN}""")
def dispersion_alpha(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    weeks = int(n_times(rows) * 0.7)
    return rounded(temporal.dispersion(temporal.entity_weeks(rows), weeks, _ALPHA_MEAN), "alpha")


# -- bursts
def _global_series(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    formed = temporal.formations(rows).groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    return temporal.densified(formed, temporal.calendar(rows), "n").select(F.lit("all").alias("key"), "time", "n"), n_times(rows)


def _relation_series(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    grid = temporal.calendar(rows).crossJoin(F.broadcast(rows.select(F.col("rel").alias("key")).distinct()))
    formed = temporal.formations(rows).groupBy(F.col("rel").alias("key"), "time").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(formed, ["key", "time"], "left").fillna(0, ["n"]).select("key", "time", "n"), n_times(rows)


_REL_SERIES_SQL = f"""{CAL_SQL}, ser AS (SELECT g.rel AS key, g.time, count(forms.time) AS n
FROM (SELECT time, rel FROM cal, (SELECT DISTINCT rel FROM edges)) g LEFT JOIN forms ON forms.time = g.time AND forms.rel = g.rel GROUP BY ALL)"""
_CUSUM_SQL = """z AS (SELECT key, time, n, avg(n) OVER (PARTITION BY key) AS mu,
(n - avg(n) OVER (PARTITION BY key)) / (stddev_pop(n) OVER (PARTITION BY key) + 1e-9) - 0.5 AS z FROM ser),
s AS (SELECT *, sum(z) OVER (PARTITION BY key ORDER BY time) AS s FROM z),
c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY time)) AS c FROM s),
r AS (SELECT *, sum((c = 0)::INT) OVER (PARTITION BY key ORDER BY time) AS run FROM c),
cus AS (SELECT key, min(time) AS a, max(time) AS b, sum(n - mu) AS intensity FROM r WHERE c > 0 GROUP BY key, run HAVING max(c) >= 2)"""


@R.add(f"""WITH {GRAPH_SQL}, {_REL_SERIES_SQL}, {_CUSUM_SQL} SELECT key, a AS start, b AS "end", round(intensity, 6) AS intensity FROM cus""")
def cusum_bursts(spark, sf_dir):
    series, _ = _relation_series(spark, sf_dir)
    return rounded(bursts.cusum(series, alarm=2.0), "intensity")


@R.add(f"""WITH {GRAPH_SQL}, {_REL_SERIES_SQL}, {_CUSUM_SQL}, f AS (SELECT DISTINCT key, unnest(generate_series(greatest(0, a - 3), least(t - 1, b + 3))) AS w FROM cus, span)
SELECT key, round(count(*) / max(t), 6) AS share FROM f, span GROUP BY key""")
def dilated_coverage(spark, sf_dir):
    series, weeks = _relation_series(spark, sf_dir)
    return rounded(bursts.coverage(bursts.cusum(series, alarm=2.0), weeks, 3), "share")


@R.add(f"""WITH {GRAPH_SQL}, {_REL_SERIES_SQL}, {_CUSUM_SQL}, f AS (SELECT DISTINCT key IN ('1-URGENT', '2-HIGH') AS side, unnest(generate_series(a, b)) AS w FROM cus),
x AS (SELECT w FROM f WHERE side), y AS (SELECT w FROM f WHERE NOT side), i AS (SELECT w FROM x INTERSECT SELECT w FROM y), u AS (SELECT w FROM x UNION SELECT w FROM y)
SELECT (SELECT count(*) FROM x) AS n_a, (SELECT count(*) FROM y) AS n_b, (SELECT count(*) FROM i) AS "both",
round((SELECT count(*) FROM i) / greatest((SELECT count(*) FROM u), 1), 6) AS jaccard, round((SELECT count(*) FROM i) / greatest((SELECT count(*) FROM x), 1), 6) AS nested""")
def week_set_jaccard(spark, sf_dir):
    series, weeks = _relation_series(spark, sf_dir)
    found = bursts.cusum(series, alarm=2.0)
    first = F.col("key").isin("1-URGENT", "2-HIGH")
    return rounded(bursts.agreement(found.where(first), found.where(~first), weeks), "jaccard", "nested")


@R.add()
def kleinberg_bursts(spark, sf_dir):
    series, _ = _relation_series(spark, sf_dir)
    return bursts.automaton(series)


@R.add()
def bocd_bursts(spark, sf_dir):
    series, _ = _relation_series(spark, sf_dir)
    return bursts.changepoints(series)


@R.add()
def burst_catalogue(spark, sf_dir):
    """Entities with 30 formations or more, on densified series of the calendar's weeks."""
    rows = stored_edges(spark, sf_dir)
    return bursts.automaton_catalogue(temporal.entity_weeks(rows), n_times(rows))


# -- themes
_Z, _OBS = 1.0, 4
_CAND_SQL = f"""{_TRAIL_SQL}, sur AS (SELECT ent, CAST(time AS INTEGER) AS time, obs, obs - base * CAST(4 AS DOUBLE) / 26 AS excess,
(obs - base * CAST(4 AS DOUBLE) / 26) / sqrt(base * CAST(4 AS DOUBLE) / 26 + 1) AS z FROM trail WHERE time >= 30),
cand AS (SELECT * FROM sur WHERE z >= {_Z} AND obs >= {_OBS} AND ent NOT IN ('S1', 'S2', 'C1'))"""


def _candidates(spark, sf_dir, strict=False):
    rows = stored_edges(spark, sf_dir)
    series = temporal.entity_weeks(rows)
    blocked = spark.createDataFrame([("S1",), ("S2",), ("C1",)], "ent string")
    sur = temporal.surprise(series, n_times(rows))
    return written(themes.candidates(sur, series, blocked, strict, _Z, _OBS), "candidates"), rows


@R.add(f"""WITH {GRAPH_SQL}, {_CAND_SQL}, f AS (SELECT *, CASE WHEN time - lag(time) OVER o > 4 OR lag(time) OVER o IS NULL THEN 1 ELSE 0 END AS nw FROM cand
WINDOW o AS (PARTITION BY ent ORDER BY time))
SELECT ent, time, obs, round(excess, 6) AS excess, round(z, 6) AS z,
CAST(coalesce(sum(nw) OVER (PARTITION BY ent ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN nw = 1 THEN 0 ELSE 1 END AS BIGINT) AS prior_episodes FROM f""")
def theme_candidates(spark, sf_dir):
    cands, _ = _candidates(spark, sf_dir)
    return rounded(themes.with_episodes(cands), "excess", "z")


@R.add(f"""WITH {GRAPH_SQL}, {_CAND_SQL}, act AS (SELECT c.ent, c.time, count(b.time) AS active FROM cand c LEFT JOIN both_ends b ON b.ent = c.ent AND b.time < c.time GROUP BY ALL)
SELECT c.ent, c.time, c.obs, round(excess, 6) AS excess, round(z, 6) AS z FROM cand c JOIN act USING (ent, time) WHERE c.time < 52 OR active <= 0.5 * c.time""")
def theme_candidates_strict(spark, sf_dir):
    cands, _ = _candidates(spark, sf_dir, strict=True)
    return rounded(cands, "excess", "z")


@R.add(f"""WITH {GRAPH_SQL}, {_CAND_SQL} SELECT x.time, least(subj, obj) AS a, greatest(subj, obj) AS b, CAST(sum(weight) AS BIGINT) AS weight
FROM edges e JOIN cand x ON x.ent = e.subj AND e.time BETWEEN x.time - 7 AND x.time JOIN cand y ON y.ent = e.obj AND y.time = x.time WHERE subj <> obj GROUP BY ALL""")
def cooccurrence_edges(spark, sf_dir):
    cands, rows = _candidates(spark, sf_dir)
    return themes.cooccurrence(cands, rows)


def _clusters(spark, sf_dir):
    cands, rows = _candidates(spark, sf_dir)
    return themes.clusters(themes.with_episodes(cands), themes.cooccurrence(cands, rows))


@R.add()
def theme_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("time", "rank", "score", "size", "members")


@R.add()
def theme_weeks(spark, sf_dir):
    return themes.theme_weeks(_clusters(spark, sf_dir))


@R.add()
def theme_lifelines(spark, sf_dir):
    return themes.lifelines(_clusters(spark, sf_dir))


_LINES_SQL = """lines AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS theme, CAST(min(date_trunc('week', o_orderdate)) AS DATE) + 7 * CAST(n_nationkey % 40 AS INTEGER) AS birth,
lower(n_name) || ' | ' || lower(min(p_type)) AS label FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey, (SELECT min(p_type) AS p_type FROM part) GROUP BY n_nationkey, n_name)"""
_GOLD = [("first", "nation_1"), ("first", "nation_3"), ("second", "nation_17"), ("third", "NATION_9"), ("none", "nation_")]
_EVENTS = [("first", "1995-03-02"), ("second", "1995-04-10"), ("third", "1996-12-15"), ("none", "1995-01-01")]
_GOLD_SQL = f"""gold(name, pattern) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _GOLD)}),
ev(name, event) AS (VALUES {', '.join(f"('{a}', DATE '{b}')" for a, b in _EVENTS)}),
mt AS (SELECT DISTINCT name, theme, birth FROM lines, gold WHERE regexp_matches(lower(label), '(^|[^\\p{{L}}\\p{{N}}_])' || lower(pattern) || '($|[^\\p{{L}}\\p{{N}}_])'))"""


def _gold(spark, sf_dir):
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    joined = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"))
    first = joined.groupBy("n_nationkey", "n_name").agg(F.min(graph.week_bucket(F.col("o_orderdate"))).alias("first"))
    kind = table(spark, sf_dir, "part").agg(F.min("p_type").alias("kind"))
    lines = first.crossJoin(F.broadcast(kind)).select(
        F.col("n_nationkey").alias("theme"),
        F.date_add("first", 7 * F.pmod(F.col("n_nationkey"), F.lit(40))).alias("birth"),
        F.concat_ws(" | ", F.lower("n_name"), F.lower("kind")).alias("label"),
    )
    patterns = spark.createDataFrame([(a, b.lower()) for a, b in _GOLD], "name string, pattern string")
    events = spark.createDataFrame(_EVENTS, "name string, event string").withColumn("event", F.col("event").cast("date"))
    return themes.matching(lines, patterns), lines, events


@R.add(f"""WITH {_LINES_SQL}, {_GOLD_SQL} SELECT ev.name, event, min(birth) AS birth, CAST(trunc((min(birth) - event) / 7) AS INTEGER) AS lead_weeks
FROM mt JOIN ev ON ev.name = mt.name WHERE birth BETWEEN event - 91 AND event + 56 GROUP BY ev.name, event""")
def gold_match(spark, sf_dir):
    matched, _, events = _gold(spark, sf_dir)
    return themes.gold_matches(matched, events)


@R.add(f"""WITH {_LINES_SQL}, {_GOLD_SQL}, grid AS (SELECT d FROM (SELECT CAST(unnest(generate_series(min(birth), max(birth), INTERVAL 1 DAY)) AS DATE) AS d FROM lines) WHERE isodow(d) = 1)
SELECT name, (SELECT count(*) FROM grid) AS weeks, count(DISTINCT d) AS hits, round(count(DISTINCT d) / (SELECT count(*) FROM grid), 6) AS chance
FROM mt JOIN grid ON birth BETWEEN d - 91 AND d + 56 GROUP BY name""")
def placebo_chance(spark, sf_dir):
    matched, lines, _ = _gold(spark, sf_dir)
    return rounded(themes.placebo_chance(matched, lines), "chance").select("name", "weeks", "hits", "chance")
