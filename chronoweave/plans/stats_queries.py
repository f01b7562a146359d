"""Statistics, ranking metrics, learned filters, event recovery and streams on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import bursts, evaluation, filters, stats
from chronoweave.plans.graph_queries import _REP_SQL, _mapping, edges
from chronoweave.plans.linkpred_queries import _setting
from chronoweave.plans.registry import Registry, rounded
from chronoweave.plans.temporal_queries import _CUSUM_SQL, _REL_SERIES_SQL, _relation_series
from chronoweave.sources.fixtures import GRAPH_SQL, table
from chronoweave.streaming import windows

R = Registry()
_SCORED = "sc AS (SELECT (n_chars % 97) / CAST(97 AS DOUBLE) AS score, quality AS label, toxic FROM documents JOIN labels USING (doc_id))"
_CUT = """g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM sc GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS kept FROM g), t AS (SELECT sum(label) AS total FROM sc)"""


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"), F.col("quality").alias("label"), "toxic")


@R.add("""WITH l AS (SELECT quality AS grp, sum(toxic) AS k, count(*) AS n FROM labels GROUP BY quality), z AS (SELECT *, CAST(1.959963984540054 AS DOUBLE) AS z FROM l)
SELECT grp, CAST(k AS BIGINT) AS k, n, round((k + z*z/2 - z*sqrt(k*(n-k)/n + z*z/4)) / (n + z*z), 6) AS lo, round((k + z*z/2 + z*sqrt(k*(n-k)/n + z*z/4)) / (n + z*z), 6) AS hi FROM z""")
def wilson_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("grp")).agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("grp", "k", "n", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


@R.add(f"WITH {_SCORED}, {_CUT} SELECT round(sum(pos / total * tp / kept), 6) AS average_precision FROM c, t")
def average_precision(spark, sf_dir):
    return rounded(stats.average_precision(_scored(spark, sf_dir)), "average_precision")


@R.add(f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sc)
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    return rounded(stats.roc_auc(_scored(spark, sf_dir)), "roc_auc")


@R.add(f"""WITH {_SCORED}, {_CUT}, k(retention) AS (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.682 AS DOUBLE)), (CAST(0.9 AS DOUBLE)))
SELECT retention, round(arg_max(tp / kept, score), 6) AS precision, CAST(arg_max(kept, score) AS BIGINT) AS kept FROM c, t, k WHERE tp >= greatest(ceil(total * retention), 1) GROUP BY retention""")
def precision_at_retention(spark, sf_dir):
    return rounded(stats.retention_curve(_scored(spark, sf_dir), [0.5, 0.682, 0.9]), "precision")


@R.add(f"""WITH {_SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(label) AS y FROM sc GROUP BY 1)
SELECT round((SELECT avg((score - label) * (score - label)) FROM sc), 6) AS brier, round((SELECT sum(n * abs(s - y)) / sum(n) FROM b), 6) AS ece""")
def calibration(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return rounded(stats.brier(rows).crossJoin(stats.calibration_error(rows)), "brier", "ece")


@R.add("""WITH l AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS e, avg(((a = 1) = (b = 1))::INT) AS bi, avg((a = 1)::INT) AS pa, avg((b = 1)::INT) AS pb FROM l)
SELECT n, round(e, 6) AS exact, round(bi, 6) AS "binary", round((e - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM n""")
def label_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return rounded(stats.agreement(rows, "a", "b", "1"), "exact", "binary", "kappa")


@R.add("""WITH a AS (SELECT source AS v, count(*) / (SELECT count(*) FROM documents WHERE lang = 'en') AS p FROM documents WHERE lang = 'en' GROUP BY 1),
b AS (SELECT source AS v, count(*) / (SELECT count(*) FROM documents WHERE lang <> 'en') AS q FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS tv FROM a FULL JOIN b ON a.v = b.v""")
def tv_distance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(stats.total_variation(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "source"), "tv")


@R.add("""WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
i AS (SELECT * FROM a INTERSECT SELECT * FROM b)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM i) AS "both", round((SELECT count(*) FROM i) / greatest((SELECT count(*) FROM a), 1), 6) AS share""")
def mask_overlap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = stats.set_overlap(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey", "o_orderpriority")
    return rounded(out, "share")


@R.add()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", rounds=200)


@R.add("""WITH r AS (SELECT o_orderstatus AS arm, o_custkey % 3 AS seed, o_custkey AS query, 1 / CAST(1 + o_orderkey % 9 AS DOUBLE) AS rr FROM orders),
q AS (SELECT arm, query, avg(rr) AS rr FROM r GROUP BY ALL), s AS (SELECT arm, seed, avg(rr) AS m FROM r GROUP BY ALL)
SELECT arm, round((SELECT avg(rr) FROM q WHERE q.arm = s.arm), 6) AS mean, round(max(m) - min(m), 6) AS spread FROM s GROUP BY arm""")
def seed_spread(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("arm"),
        F.pmod("o_custkey", F.lit(3)).alias("seed"),
        F.col("o_custkey").alias("query"),
        (1 / (1 + F.pmod("o_orderkey", F.lit(9))).cast("double")).alias("rr"),
    )
    return rounded(stats.seed_spread(rows), "mean", "spread")


@R.add("""WITH r AS (SELECT o_orderstatus AS arm, o_custkey AS query, 1 / CAST(1 + o_orderkey % 9 AS DOUBLE) AS rr FROM orders),
p AS (SELECT query, avg(rr) FILTER (WHERE arm = 'F') AS x, avg(rr) FILTER (WHERE arm = 'O') AS y FROM r GROUP BY query)
SELECT query, round(x - y, 6) + 0 AS gap FROM p WHERE x IS NOT NULL AND y IS NOT NULL""")
def paired_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("arm"), F.col("o_custkey").alias("query"), (1 / (1 + F.pmod("o_orderkey", F.lit(9))).cast("double")).alias("rr")
    )
    return rounded(stats.paired_gap(rows, "F", "O"), "gap")


@R.add("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang""")
def corpus_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.percentile("n_chars", 0.5).alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")
    )
    return rounded(rows, "mean", "median")


# -- compositions
_EV = [("1-URGENT", 40), ("1-URGENT", 200), ("2-HIGH", 30), ("3-MEDIUM", 120), ("5-LOW", 300)]
_EV_SQL = "ev(key, week) AS (VALUES " + ", ".join(f"('{k}', {w})" for k, w in _EV) + ")"


def _recovered(spark, sf_dir):
    series, weeks = _relation_series(spark, sf_dir)
    found = bursts.cusum(series, alarm=2.0)
    return evaluation.event_recovery(spark.createDataFrame(_EV, "key string, week int"), found, series, weeks)


@R.add(f"""WITH {GRAPH_SQL}, {_REL_SERIES_SQL}, {_CUSUM_SQL}, {_EV_SQL},
f AS (SELECT DISTINCT key, unnest(generate_series(greatest(0, a - 3), least(t - 1, b + 3))) AS w FROM cus, span), cov AS (SELECT key, count(*) / max(t) AS chance FROM f, span GROUP BY key),
h AS (SELECT ev.key, week, coalesce(bool_or(week BETWEEN a - 3 AND b + 3), false) AS hit FROM ev LEFT JOIN cus ON cus.key = ev.key GROUP BY ALL),
o AS (SELECT ev.key, week, arg_max(time, (n, -time)) AS onset FROM ev JOIN ser ON ser.key = ev.key AND abs(time - week) <= 8 GROUP BY ALL)
SELECT h.key, h.week, hit, round(coalesce(chance, 0), 6) AS chance, onset - h.week AS error FROM h LEFT JOIN cov USING (key) LEFT JOIN o ON o.key = h.key AND o.week = h.week""")
def event_recovery(spark, sf_dir):
    return rounded(_recovered(spark, sf_dir), "chance")


@R.add(f"""WITH {GRAPH_SQL}, {_REL_SERIES_SQL}, {_CUSUM_SQL}, {_EV_SQL},
f AS (SELECT DISTINCT key, unnest(generate_series(greatest(0, a - 3), least(t - 1, b + 3))) AS w FROM cus, span), cov AS (SELECT key, count(*) / max(t) AS chance FROM f, span GROUP BY key),
h AS (SELECT ev.key, week, coalesce(bool_or(week BETWEEN a - 3 AND b + 3), false) AS hit FROM ev LEFT JOIN cus ON cus.key = ev.key GROUP BY ALL)
SELECT count(*) AS events, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 6) AS recall, round(avg(coalesce(chance, 0)), 6) AS chance, round(avg(hit::INT) - avg(coalesce(chance, 0)), 6) AS excess FROM h LEFT JOIN cov USING (key)""")
def event_recovery_summary(spark, sf_dir):
    return rounded(evaluation.recovery_summary(_recovered(spark, sf_dir)), "recall", "chance", "excess")


@R.add(f"""WITH {GRAPH_SQL}, cal AS (SELECT CAST(unnest(generate_series(0, t - 1)) AS INTEGER) AS time FROM span)
SELECT cal.time, count(forms.time) AS all_formations, count(forms.time) FILTER (WHERE rel NOT IN ('1-URGENT', '2-HIGH')) AS kept_formations FROM cal LEFT JOIN forms USING (time) GROUP BY cal.time""")
def structural_only(spark, sf_dir):
    return evaluation.without_and_with(edges(spark, sf_dir), ["1-URGENT", "2-HIGH"])


def _merge_rank_sql(name: str, e: str) -> str:
    sides = []
    for d, g, o in (("object", "subj", "obj"), ("subject", "obj", "subj")):
        sides.append(f"""SELECT q.subj, q.rel, q.obj, q.time, '{d}' AS d, q.seen, CASE WHEN q.seen > 0 THEN 1 + count(*) FILTER (WHERE c > q.seen) + (count(*) FILTER (WHERE c = q.seen) - 1) / 2
ELSE 1 + count(c) + (max(pn) - count(c) - 1) / 2 END AS rank FROM {name}_pool, {name}_q q LEFT JOIN
(SELECT k.{g} AS g, k.rel, k.time AS t, x.{o} AS cand, count(*) AS c FROM (SELECT DISTINCT {g}, rel, time FROM {name}_q) k JOIN {e} x ON x.{g} = k.{g} AND x.rel = k.rel AND x.time < k.time GROUP BY ALL) c
ON c.g = q.{g} AND c.rel = q.rel AND c.t = q.time GROUP BY q.subj, q.rel, q.obj, q.time, q.seen""")
    return f"""{name}_pool AS (SELECT count(*) AS pn FROM (SELECT subj FROM {e} UNION SELECT obj FROM {e})),
{name}_q AS (SELECT * FROM (SELECT subj, rel, obj, time, row_number() OVER (PARTITION BY subj, rel, obj ORDER BY time) - 1 AS seen FROM {e}), lo WHERE time >= lo),
{name}_r AS ({sides[0]} UNION ALL {sides[1]})"""


@R.add(f"""WITH {GRAPH_SQL}, {_REP_SQL}, lo AS (SELECT CAST(floor(t * CAST(0.85 AS DOUBLE)) AS INTEGER) AS lo FROM span),
me AS (SELECT DISTINCT a.rep AS subj, rel, b.rep AS obj, time FROM edges JOIN m a ON a.ent = subj JOIN m b ON b.ent = obj WHERE a.rep <> b.rep),
{_merge_rank_sql('pl', 'edges')}, {_merge_rank_sql('mg', 'me')}
SELECT 'plain' AS graph, count(*) AS n_ranks, round(avg((seen = 0)::INT), 6) AS novelty, round(avg(1 / rank), 6) AS mrr FROM pl_r UNION ALL
SELECT 'merged', count(*), round(avg((seen = 0)::INT), 6), round(avg(1 / rank), 6) FROM mg_r""")
def merge_effect(spark, sf_dir):
    rows, first, _ = _setting(spark, sf_dir)
    return rounded(evaluation.merge_effect(rows, _mapping(spark, sf_dir, rows), first), "novelty", "mrr")


@R.add()
def filter_grouped_cv(spark, sf_dir):
    """Logistic scores of text quality from shallow features, no source in both training and test."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(
        "doc_id",
        "source",
        F.col("quality").cast("double").alias("label"),
        F.log1p("n_chars").alias("size"),
        (F.regexp_count("text", F.lit("[!#$%&*]")) / (F.col("n_chars") + 1)).alias("marks"),
        (F.regexp_count("text", F.lit("[A-Z]")) / (F.col("n_chars") + 1)).alias("capitals"),
    )
    return filters.grouped_cv(rows, ["size", "marks", "capitals"], "label", "source")


# -- streams
@R.add("""SELECT CAST(date_trunc('week', ts) AS DATE) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_tumbling_counts(spark, sf_dir):
    rows = windows.stream_table(spark, sf_dir, "events")
    return windows.run_available(windows.tumbling_counts(rows, "ts", "event_type"), "complete", "tumbling")


@R.add("""WITH b AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS w, event_type FROM events), o AS (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS k)
SELECT w + 7 * k AS bucket, event_type, count(*) AS n FROM b, o GROUP BY ALL""")
def stream_sliding_velocity(spark, sf_dir):
    rows = windows.stream_table(spark, sf_dir, "events")
    return windows.run_available(windows.sliding_counts(rows, "ts", "event_type"), "complete", "sliding")


