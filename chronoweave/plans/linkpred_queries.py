"""Point-in-time ranks and their metrics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import linkpred
from chronoweave.operators.graph import QUAD, endpoints
from chronoweave.operators.runtime import written
from chronoweave.plans.graph_queries import edges, stored_edges
from chronoweave.plans.registry import Registry, rounded
from chronoweave.plans.temporal_queries import n_times
from chronoweave.sources.fixtures import GRAPH_SQL, table

R = Registry()


def _setting(spark, sf_dir):
    """edges, first test week, number of entities (the pool is every entity that occurs at all)."""
    rows = stored_edges(spark, sf_dir)
    return rows, int(n_times(rows) * 0.85), endpoints(rows).distinct().count()


BASE_SQL = f"""{GRAPH_SQL}, lo AS (SELECT CAST(floor(t * CAST(0.85 AS DOUBLE)) AS INTEGER) AS lo FROM span),
pool AS (SELECT count(*) AS n FROM (SELECT subj FROM edges UNION SELECT obj FROM edges)),
seen AS (SELECT subj, rel, obj, time, row_number() OVER (PARTITION BY subj, rel, obj ORDER BY time) - 1 AS seen FROM edges),
q AS (SELECT * FROM seen, lo WHERE time >= lo)"""


def _rec_sql(direction: str, group: str, other: str) -> str:
    return f"""c_{direction} AS (SELECT q.{group} AS g, q.rel, q.time AS t, e.{other} AS cand, count(*) AS c
FROM (SELECT DISTINCT {group}, rel, time FROM q) q JOIN edges e ON e.{group} = q.{group} AND e.rel = q.rel AND e.time < q.time GROUP BY ALL),
rec_{direction} AS (SELECT q.subj, q.rel, q.obj, q.time, q.seen, '{direction}' AS direction, CASE WHEN q.seen > 0
THEN 1 + count(*) FILTER (WHERE c > q.seen) + (count(*) FILTER (WHERE c = q.seen) - 1) / 2 ELSE 1 + count(c.cand) + (max(n) - count(c.cand) - 1) / 2 END AS rank
FROM pool, q LEFT JOIN c_{direction} c ON c.g = q.{group} AND c.rel = q.rel AND c.t = q.time GROUP BY q.subj, q.rel, q.obj, q.time, q.seen)"""


REC_SQL = f"""{_rec_sql('object', 'subj', 'obj')}, {_rec_sql('subject', 'obj', 'subj')},
rec AS (SELECT * FROM rec_object UNION ALL SELECT * FROM rec_subject)"""


def _pop_sql(direction: str, role: str) -> str:
    return f"""w_{direction} AS (SELECT DISTINCT time AS t FROM q), ents_{direction} AS (SELECT DISTINCT {role} AS ent FROM edges),
p_{direction} AS (SELECT t, ent, count(e.time) AS c FROM w_{direction}, ents_{direction} LEFT JOIN edges e ON e.{role} = ent AND e.time < t GROUP BY ALL),
h_{direction} AS (SELECT t, c, count(*) AS m FROM p_{direction} WHERE c > 0 GROUP BY ALL),
r_{direction} AS (SELECT p.t, p.ent, p.c, coalesce(sum(m) FILTER (WHERE h.c > p.c), 0) AS higher, coalesce(sum(m) FILTER (WHERE h.c = p.c), 0) AS eq, coalesce(sum(m), 0) AS scored
FROM p_{direction} p LEFT JOIN h_{direction} h ON h.t = p.t GROUP BY p.t, p.ent, p.c),
pop_{direction} AS (SELECT subj, rel, obj, time, '{direction}' AS direction, CASE WHEN c > 0 THEN 1 + higher + (eq - 1) / 2 ELSE 1 + scored + (n - scored - 1) / 2 END AS rank
FROM pool, q JOIN r_{direction} r ON r.ent = q.{role} AND r.t = q.time)"""


POP_SQL = f"""{_pop_sql('object', 'obj')}, {_pop_sql('subject', 'subj')}, pop AS (SELECT * FROM pop_object UNION ALL SELECT * FROM pop_subject)"""


@R.add(f"WITH {BASE_SQL} SELECT subj, rel, obj, time, seen FROM seen")
def pit_history(spark, sf_dir):
    return linkpred.with_history(edges(spark, sf_dir)).select(*QUAD, "seen")


@R.add(f"WITH {BASE_SQL}, {REC_SQL} SELECT subj, rel, obj, time, seen, direction, CAST(rank AS DOUBLE) AS rank FROM rec")
def pit_recurrence_rank(spark, sf_dir):
    return linkpred.recurrence_ranks(*_setting(spark, sf_dir))


@R.add(f"WITH {BASE_SQL}, {POP_SQL} SELECT subj, rel, obj, time, direction, CAST(rank AS DOUBLE) AS rank FROM pop")
def pit_popularity_rank(spark, sf_dir):
    return linkpred.popularity_ranks(*_setting(spark, sf_dir))


_BACK_SQL = """back AS (SELECT subj, rel, obj, time, direction, seen, CASE WHEN seen > 0 THEN rec.rank ELSE pop.rank END AS rank FROM rec JOIN pop USING (subj, rel, obj, time, direction))"""


@R.add(f"WITH {BASE_SQL}, {REC_SQL}, {POP_SQL}, {_BACK_SQL} SELECT subj, rel, obj, time, direction, seen, CAST(rank AS DOUBLE) AS rank FROM back")
def backoff_rank(spark, sf_dir):
    setting = _setting(spark, sf_dir)
    return linkpred.backoff(linkpred.recurrence_ranks(*setting), linkpred.popularity_ranks(*setting))


_ALL_SQL = f"""{_BACK_SQL}, ranks AS (SELECT 'recurrence' AS method, seen, rel, rank FROM rec UNION ALL
SELECT 'popularity', seen, rel, pop.rank FROM pop JOIN seen USING (subj, rel, obj, time) UNION ALL SELECT 'backoff', seen, rel, rank FROM back)"""


def _ranks(spark, sf_dir):
    setting = _setting(spark, sf_dir)
    rec, pop = written(linkpred.recurrence_ranks(*setting), "ranks"), written(linkpred.popularity_ranks(*setting), "ranks")
    seen = rec.select(*QUAD, "direction", "seen")
    pop_seen = pop.join(seen, [*QUAD, "direction"])
    back = linkpred.backoff(rec, pop)
    parts = [x.select(F.lit(m).alias("method"), "seen", "rel", "rank") for m, x in (("recurrence", rec), ("popularity", pop_seen), ("backoff", back))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@R.add(f"""WITH {BASE_SQL}, {REC_SQL}, {POP_SQL}, {_ALL_SQL}, k AS (SELECT *, CASE WHEN seen > 0 THEN 'recurring' ELSE 'novel' END AS part FROM ranks)
SELECT method, coalesce(part, 'all') AS subset, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits1,
round(avg((rank <= 3)::INT), 6) AS hits3, round(avg((rank <= 10)::INT), 6) AS hits10 FROM k GROUP BY GROUPING SETS ((method), (method, part))""")
def linkpred_metrics(spark, sf_dir):
    return rounded(linkpred.metrics_by_subset(_ranks(spark, sf_dir)), "mrr", "hits1", "hits3", "hits10")


@R.add(f"""WITH {BASE_SQL}, {REC_SQL}, {POP_SQL}, {_ALL_SQL} SELECT rel, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits1,
round(avg((rank <= 3)::INT), 6) AS hits3, round(avg((rank <= 10)::INT), 6) AS hits10 FROM ranks WHERE method = 'backoff' GROUP BY rel HAVING count(*) >= 100""")
def relation_metrics(spark, sf_dir):
    ranks = _ranks(spark, sf_dir).where("method = 'backoff'")
    return rounded(linkpred.metrics(ranks, "rel").where("n >= 100"), "mrr", "hits1", "hits3", "hits10")


@R.add(f"""WITH {BASE_SQL}, {REC_SQL}, {POP_SQL}, {_ALL_SQL}, k AS (SELECT method, CASE WHEN seen > 0 THEN 'recurring' ELSE 'novel' END AS subset, sum(1 / rank) AS s FROM ranks GROUP BY ALL)
SELECT method, subset, round(s / sum(s) OVER (PARTITION BY method), 6) AS share FROM k""")
def mrr_mass(spark, sf_dir):
    return rounded(linkpred.mass(_ranks(spark, sf_dir)), "share")


@R.add(f"""WITH {BASE_SQL}, {REC_SQL}, c AS (SELECT direction, rank, count(*) AS n FROM rec GROUP BY ALL)
SELECT direction, CAST(rank AS DOUBLE) AS rank, round(sum(n) OVER (PARTITION BY direction ORDER BY rank) / sum(n) OVER (PARTITION BY direction), 6) AS ecdf FROM c""")
def rank_ecdf(spark, sf_dir):
    return rounded(linkpred.rank_ecdf(linkpred.recurrence_ranks(*_setting(spark, sf_dir)), "direction"), "ecdf")


# -- neighbourhoods, over the whole test split
_ADJ_SQL = """tw AS (SELECT DISTINCT time AS t FROM q),
adj AS (SELECT DISTINCT t, a, b FROM (SELECT tw.t, subj AS a, obj AS b FROM edges JOIN tw ON time BETWEEN tw.t - 12 AND tw.t - 1
UNION ALL SELECT tw.t, obj, subj FROM edges JOIN tw ON time BETWEEN tw.t - 12 AND tw.t - 1)),
deg AS (SELECT t, a, count(*) AS d FROM adj GROUP BY ALL),
qs AS (SELECT DISTINCT t, q FROM (SELECT time AS t, subj AS q FROM q UNION ALL SELECT time, obj FROM q)),
sc AS (SELECT qs.t, qs.q, y.b AS cand, count(*) AS cn, sum(1 / ln(greatest(d, 2))) AS aa FROM qs JOIN adj x ON x.t = qs.t AND x.a = qs.q
JOIN deg ON deg.t = x.t AND deg.a = x.b JOIN adj y ON y.t = x.t AND y.a = x.b GROUP BY ALL),
b AS (SELECT subj, rel, obj, time, 'object' AS direction, subj AS q, obj AS tr FROM q UNION ALL SELECT subj, rel, obj, time, 'subject', obj, subj FROM q)"""


def _neighbours(spark, sf_dir):
    """Stored edges and their first test week: two-step scores come from windows that begin before it."""
    rows = stored_edges(spark, sf_dir)
    return rows, int(n_times(rows) * 0.85)


@R.add(f"WITH {BASE_SQL}, {_ADJ_SQL} SELECT t, q, cand, cn FROM sc")
def common_neighbours(spark, sf_dir):
    return linkpred.neighbour_scores(*_neighbours(spark, sf_dir)).select("t", "q", "cand", "cn")


@R.add(f"WITH {BASE_SQL}, {_ADJ_SQL} SELECT t, q, cand, round(aa, 6) AS aa FROM sc")
def adamic_adar(spark, sf_dir):
    return rounded(linkpred.neighbour_scores(*_neighbours(spark, sf_dir)).select("t", "q", "cand", "aa"), "aa")


def _neighbour_ctes(value: str) -> str:
    v, o, k = f"v_{value}", f"o_{value}", f"k_{value}"
    return f"""{v} AS (SELECT t, q, cand, round({value}, 9) AS v FROM sc),
{o} AS (SELECT b.*, coalesce(v.v, 0) AS s FROM b LEFT JOIN {v} v ON v.t = b.time AND v.q = b.q AND v.cand = b.tr),
{k} AS (SELECT o.subj, o.rel, o.obj, o.time, o.direction, o.s, o.q, o.tr, count(*) FILTER (WHERE v.v > o.s) AS higher, count(*) FILTER (WHERE v.v = o.s) AS eq, count(v.v) AS scored
FROM {o} o LEFT JOIN {v} v ON v.t = o.time AND v.q = o.q AND (v.cand <> o.q OR o.q = o.tr) GROUP BY ALL),
{value} AS (SELECT subj, rel, obj, time, direction, CAST(CASE WHEN s > 0 THEN 1 + higher + (eq - 1) / 2 ELSE 1 + scored + (n - CASE WHEN q = tr THEN 0 ELSE 1 END - scored - 1) / 2 END AS DOUBLE) AS rank FROM {k}, pool)"""


@R.add(f"WITH {BASE_SQL}, {_ADJ_SQL}, {_neighbour_ctes('cn')} SELECT * FROM cn")
def common_neighbour_rank(spark, sf_dir):
    return linkpred.neighbour_ranks(*_setting(spark, sf_dir)).select(*QUAD, "direction", F.col("cn").alias("rank"))


@R.add(f"WITH {BASE_SQL}, {_ADJ_SQL}, {_neighbour_ctes('aa')} SELECT * FROM aa")
def adamic_adar_rank(spark, sf_dir):
    return linkpred.neighbour_ranks(*_setting(spark, sf_dir)).select(*QUAD, "direction", F.col("aa").alias("rank"))


def _hybrid_sql(value: str) -> str:
    return f"""SELECT '{value}' AS method, seen, x.rank FROM {value} x JOIN seen USING (subj, rel, obj, time) UNION ALL
SELECT 'recurrence->{value}', seen, CASE WHEN seen > 0 THEN rec.rank ELSE x.rank END FROM rec JOIN {value} x USING (subj, rel, obj, time, direction)"""


@R.add(f"""WITH {BASE_SQL}, {REC_SQL}, {_ADJ_SQL}, {_neighbour_ctes('cn')}, {_neighbour_ctes('aa')}, ranks AS ({_hybrid_sql('cn')} UNION ALL {_hybrid_sql('aa')}),
g AS (SELECT *, CASE WHEN seen > 0 THEN 'recurring' ELSE 'novel' END AS part FROM ranks)
SELECT method, coalesce(part, 'all') AS subset, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits1,
round(avg((rank <= 3)::INT), 6) AS hits3, round(avg((rank <= 10)::INT), 6) AS hits10 FROM g GROUP BY GROUPING SETS ((method), (method, part))""")
def neighbour_metrics(spark, sf_dir):
    """Neighbour ranks by themselves, and behind recurrence, by subset."""
    setting, parts = _setting(spark, sf_dir), []
    keys = [*QUAD, "direction"]
    ranks = linkpred.neighbour_ranks(*setting).join(linkpred.recurrence_ranks(*setting), keys)
    ranks = written(ranks.select("seen", "rank", "cn", "aa"), "ranks")
    for value in ("cn", "aa"):
        behind = F.when(F.col("seen") > 0, F.col("rank")).otherwise(F.col(value))
        parts += [ranks.select(F.lit(m).alias("method"), "seen", r.alias("rank")) for m, r in ((value, F.col(value)), (f"recurrence->{value}", behind))]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return rounded(linkpred.metrics_by_subset(every), "mrr", "hits1", "hits3", "hits10")


# -- vectors
_VEC_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT q.vec_id AS q, c.vec_id AS cand, list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)) AS cosine
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)"""


@R.add(f"""WITH {_VEC_SQL}, r AS (SELECT q, cand, round(cosine, 6) AS cosine FROM c)
SELECT q, cand, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, cand) AS k FROM r) WHERE k <= 10""")
def cosine_topk(spark, sf_dir):
    from chronoweave.operators.embedding import cosine_top

    rows = table(spark, sf_dir, "embeddings")
    return cosine_top(rows.where("vec_id % 20 = 0"), rows, 10)


@R.add("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS q, c.vec_id AS cand, round(list_inner_product(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0),
t AS (SELECT q, score AS st FROM s WHERE cand = (q + 1) % (SELECT count(*) FROM embeddings))
SELECT s.q, CAST(1 + count(*) FILTER (WHERE score > st) + (count(*) FILTER (WHERE score = st) - 1) / 2 AS DOUBLE) AS rank FROM s JOIN t ON t.q = s.q GROUP BY s.q""")
def distmult_rank(spark, sf_dir):
    from chronoweave.operators.embedding import bilinear_ranks

    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select("vec_id", "embedding", F.pmod(F.col("vec_id") + 1, F.lit(rows.count())).alias("true_id"))
    return bilinear_ranks(queries, rows, places=6)
