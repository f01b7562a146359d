"""Assembly, dictionaries, splits, pruning, filters, samples and duplicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.text import MONTHS
from chronoweave.operators import canonical, dedup, graph, sampling
from chronoweave.operators.runtime import written
from chronoweave.plans.registry import Registry, rounded
from chronoweave.sources.fixtures import GRAPH_SQL, MENTIONS_SQL, mentions, table

R = Registry()
CORE_WEIGHT, CORE_DEGREE = 1, 40


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.assemble(mentions(spark, sf_dir))


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a table, for queries that read them several times."""
    return written(edges(spark, sf_dir), "edges")


@R.add(f"WITH {GRAPH_SQL} SELECT subj, rel, obj, time, weight FROM edges")
def assemble_quads(spark, sf_dir):
    return edges(spark, sf_dir)


def _buckets(kind: str, expr: str):
    return f"""WITH {MENTIONS_SQL}, b AS (SELECT {expr} AS bucket FROM mentions)
    SELECT bucket, count(*) AS n FROM b GROUP BY bucket"""


def _bucket_counts(spark, sf_dir, resolution):
    return graph.bucketed(mentions(spark, sf_dir), resolution).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@R.add(_buckets("week", "CAST(date_trunc('week', ts) AS DATE)"))
def bucket_week(spark, sf_dir):
    return _bucket_counts(spark, sf_dir, "week")


@R.add(_buckets("month", "CAST(date_trunc('month', ts) AS DATE)"))
def bucket_month(spark, sf_dir):
    return _bucket_counts(spark, sf_dir, "month")


@R.add(
    _buckets(
        "fortnight",
        "(SELECT min(CAST(ts AS DATE)) FROM mentions) + CAST(14 * ((CAST(ts AS DATE) -"
        " (SELECT min(CAST(ts AS DATE)) FROM mentions)) // 14) AS INTEGER)",
    )
)
def bucket_fortnight(spark, sf_dir):
    return _bucket_counts(spark, sf_dir, "fortnight")


@R.add("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type, n AS votes FROM r WHERE k = 1""")
def majority_type(spark, sf_dir):
    return graph.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@R.add(f"""WITH {MENTIONS_SQL}, c AS (SELECT name, count(*) AS n FROM
(SELECT head AS name FROM mentions UNION ALL SELECT tail FROM mentions) GROUP BY name)
SELECT name, n, row_number() OVER (ORDER BY n DESC, name) - 1 AS id FROM c""")
def entity_dictionary(spark, sf_dir):
    return graph.entity_dictionary(mentions(spark, sf_dir))


@R.add(f"""WITH {GRAPH_SQL}, d AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) - 1 AS id FROM (SELECT name, count(*) AS n FROM
(SELECT head AS name FROM mentions UNION ALL SELECT tail FROM mentions) GROUP BY name))
SELECT a.id AS subj, rel, b.id AS obj, time, weight FROM edges JOIN d a ON a.name = subj JOIN d b ON b.name = obj""")
def encoded_quads(spark, sf_dir):
    rows = mentions(spark, sf_dir)
    return graph.encode(graph.assemble(rows), graph.entity_dictionary(rows))


@R.add(f"""WITH {GRAPH_SQL} SELECT CASE WHEN time < CAST(floor(t * CAST(0.7 AS DOUBLE)) AS INTEGER) THEN 'train'
WHEN time < CAST(floor(t * CAST(0.85 AS DOUBLE)) AS INTEGER) THEN 'valid' ELSE 'test' END AS split, count(*) AS n,
min(time) AS first, max(time) AS last FROM edges, span GROUP BY 1""")
def chrono_split_counts(spark, sf_dir):
    rows = graph.with_split(edges(spark, sf_dir))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@R.add(f"""WITH {GRAPH_SQL}, s AS (SELECT edges.*, CASE WHEN time < CAST(floor(t * CAST(0.7 AS DOUBLE)) AS INTEGER) THEN 'train'
WHEN time < CAST(floor(t * CAST(0.85 AS DOUBLE)) AS INTEGER) THEN 'valid' ELSE 'test' END AS split FROM edges, span)
SELECT *, row_number() OVER (PARTITION BY split ORDER BY time, subj, rel, obj) - 1 AS idx FROM s""")
def split_file_index(spark, sf_dir):
    return graph.split_index(edges(spark, sf_dir))


def _core_sql(rounds: int) -> str:
    """Rounds spelt out; a round past the fixpoint changes nothing."""
    steps = [f"e0 AS (SELECT * FROM edges WHERE weight >= {CORE_WEIGHT})"]
    for k in range(rounds):
        deg = f"SELECT ent FROM (SELECT subj AS ent FROM e{k} UNION ALL SELECT obj FROM e{k}) GROUP BY ent HAVING count(*) >= {CORE_DEGREE}"
        steps.append(f"d{k} AS MATERIALIZED ({deg})")
        steps.append(
            f"e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} WHERE subj IN (SELECT ent FROM d{k}) AND obj IN (SELECT ent FROM d{k}))"
        )
    return f"WITH {GRAPH_SQL}, {', '.join(steps)} SELECT subj, rel, obj, time, weight FROM e{rounds}"


@R.add(_core_sql(25))
def degree_core(spark, sf_dir):
    return graph.degree_core(edges(spark, sf_dir), CORE_WEIGHT, CORE_DEGREE)


@R.add(f"""WITH {GRAPH_SQL}, d AS (SELECT ent, count(*) AS degree FROM
(SELECT subj AS ent FROM edges UNION ALL SELECT obj FROM edges) GROUP BY ent)
SELECT ent, degree, row_number() OVER (ORDER BY degree DESC, ent) - 1 AS id FROM d""")
def degree_index(spark, sf_dir):
    return graph.reindexed(edges(spark, sf_dir))


_DROP = "('C1', 'C2', 'C3', 'S1', 'S2', 'S3')"


@R.add(f"WITH {GRAPH_SQL} SELECT subj, rel, obj, time, weight FROM edges WHERE subj NOT IN {_DROP} AND obj NOT IN {_DROP}")
def entity_filter(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("C1", "C2", "C3", "S1", "S2", "S3")], "ent string")
    return graph.without_entities(edges(spark, sf_dir), names)


@R.add(f"WITH {GRAPH_SQL} SELECT subj, rel, obj, time, weight FROM edges WHERE rel NOT IN ('1-URGENT', '5-LOW')")
def relation_filter(spark, sf_dir):
    return graph.without_relations(edges(spark, sf_dir), ["1-URGENT", "5-LOW"])


_NATIONS_SQL = """nat AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS bucket, c_nationkey AS a, s_nationkey AS b, o_orderpriority AS rel
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@R.add(f"WITH {_NATIONS_SQL} SELECT a, b, rel, count(*) AS n FROM nat WHERE a <> b GROUP BY ALL")
def self_loop_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = rows.select(F.col("c_nationkey").alias("subj"), F.col("s_nationkey").alias("obj"), F.col("o_orderpriority").alias("rel"))
    kept = graph.without_self_loops(named).groupBy("subj", "obj", "rel").agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumnsRenamed({"subj": "a", "obj": "b"})


# -- samples
@R.add("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k FROM o)
SELECT month, o_orderkey FROM r WHERE k <= 20""")
def reservoir_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return sampling.per_group_sample(rows, "month", "o_orderkey", 20).select("month", "o_orderkey")


@R.add("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k FROM o)
SELECT month, count(*) AS available, count(*) FILTER (WHERE k <= 20) AS selected FROM r GROUP BY month""")
def sample_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return sampling.group_counts(rows, sampling.per_group_sample(rows, "month", "o_orderkey", 20), "month")


@R.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 300")
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 300, 7)


@R.add("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT o_orderkey FROM r WHERE n % 4 = 1""")
def shard_interleave(spark, sf_dir):
    return sampling.shard(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 4, 1)


@R.add("""SELECT o_orderkey, printf('a%07d', row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS id FROM orders""")
def synthetic_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sampling.with_ids(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@R.add(r"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '20' || (10 + doc_id % 20) || '-01-02' ELSE 'n/a' END AS date, text AS body FROM documents)
SELECT doc_id FROM a WHERE regexp_matches(date, '^\d{4}.{3}') AND TRY_CAST(substr(date, 1, 4) AS INTEGER) BETWEEN 2012 AND 2024
AND len(regexp_extract_all(body, '[^\s]+')) >= 50""")
def article_filter(spark, sf_dir):
    year = F.concat(F.lit("20"), (10 + F.col("doc_id") % 20).cast("string"), F.lit("-01-02"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, year).otherwise("n/a").alias("date"), F.col("text").alias("body")
    )
    return sampling.valid_articles(rows, 2012, 2024, min_words=50).select("doc_id")


# -- duplicates
@R.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@R.add("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY text)""")
def dedup_drop_list(spark, sf_dir):
    return dedup.dropped(table(spark, sf_dir, "documents"), "text", "doc_id")


@R.add("""SELECT count(*) AS n, count(DISTINCT text) AS distinct_bodies, round(1 - count(DISTINCT text) / count(*), 6) AS rate FROM documents""")
def duplicate_rate(spark, sf_dir):
    return rounded(dedup.duplicate_rate(table(spark, sf_dir, "documents"), "text"), "rate")


@R.add("""SELECT sha256(text) AS h, count(*) AS copies, count(DISTINCT source) AS tags, max(doc_id // 100) - min(doc_id // 100) AS span
FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_group_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("week", F.floor(F.col("doc_id") / 100))
    return dedup.duplicate_groups(rows, "text", "source", "week")


_NOT = r"[^\p{L}\p{N}_]"


def _slots(x: str) -> str:
    """Boundaries are kept as groups, twice, since two words may share one."""
    months = "|".join(MONTHS)
    steps = [
        (f"(^|{_NOT})[A-Z]{{1,5}}($|{_NOT})", r"\1@t\2"),
        (f"(^|{_NOT})[A-Z]{{1,5}}($|{_NOT})", r"\1@t\2"),
        (f"(?i)(^|{_NOT})(?:{months})($|{_NOT})", r"\1@M\2"),
        (f"(?i)(^|{_NOT})(?:{months})($|{_NOT})", r"\1@M\2"),
        (r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:th|st|nd|rd)?", "@N"),
        (r"[^\p{L}\p{N}_@ ]+", " "),
    ]
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return rf"trim(regexp_replace(lower({x}), '[\s\p{{Z}}]+', ' ', 'g'))"


@R.add(f"SELECT doc_id, {_slots('substr(text, 1, 120)')} AS skeleton FROM documents")
def template_skeleton(spark, sf_dir):
    from chronoweave.functions.text import lede, slot_norm

    return table(spark, sf_dir, "documents").select("doc_id", slot_norm(lede(F.col("text"))).alias("skeleton"))


@R.add(f"""WITH s AS (SELECT p_partkey, {_slots('p_type')} AS t, {_slots('substr(p_name, 1, 120)')} AS b FROM part)
SELECT p_partkey, (count(*) OVER (PARTITION BY t) >= 25 OR count(*) OVER (PARTITION BY b) >= 25) AS templated FROM s""")
def template_fingerprints(spark, sf_dir):
    return dedup.templated(table(spark, sf_dir, "part"), "p_type", "p_name").select("p_partkey", "templated")


@R.add(f"""WITH {MENTIONS_SQL}, f AS (SELECT o_orderkey AS article FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT article, head AS ent FROM mentions UNION ALL SELECT article, tail FROM mentions),
c AS (SELECT ent, count(*) AS n, count(f.article) AS t FROM e LEFT JOIN f ON e.article = f.article GROUP BY ent)
SELECT ent, n, round(t / n, 6) AS share FROM c WHERE n >= 50 AND t / n >= 0.5""")
def template_share(spark, sf_dir):
    flagged = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("article"))
    return rounded(dedup.template_entities(mentions(spark, sf_dir), flagged, 50, 0.5), "share")


# -- merging
_MAP_SQL = """map AS (SELECT 'C' || c_custkey AS ent, 'N' || c_nationkey AS grp FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"""
_WEIGHT_SQL = """w AS (SELECT ent, sum(weight) AS weight FROM (SELECT subj AS ent, weight FROM edges UNION ALL SELECT obj, weight FROM edges) GROUP BY ent)"""
_REP_SQL = f"""{_MAP_SQL}, {_WEIGHT_SQL},
rep AS (SELECT grp, ent AS rep FROM (SELECT grp, map.ent, row_number() OVER (PARTITION BY grp ORDER BY coalesce(weight, 0) DESC, map.ent) AS k
FROM map LEFT JOIN w ON map.ent = w.ent) WHERE k = 1),
m AS (SELECT map.ent, rep FROM map JOIN rep USING (grp))"""


def _mapping(spark, sf_dir, rows):
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ent"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("group"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ent"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("group"),
    )
    groups = c.unionAll(s)
    reps = canonical.representatives(groups, canonical.entity_weights(rows))
    return groups.join(reps, "group").select("ent", F.col("rep").alias("to"))


@R.add(f"""WITH {GRAPH_SQL}, {_REP_SQL}
SELECT a.rep AS subj, rel, b.rep AS obj, time, CAST(sum(weight) AS BIGINT) AS weight FROM edges JOIN m a ON a.ent = subj JOIN m b ON b.ent = obj
WHERE a.rep <> b.rep GROUP BY ALL""")
def canonical_merge(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return canonical.merged_core(rows, _mapping(spark, sf_dir, rows))


@R.add(f"""WITH {GRAPH_SQL}, {_REP_SQL}
SELECT DISTINCT a.rep AS subj, rel, b.rep AS obj, time FROM edges JOIN m a ON a.ent = subj JOIN m b ON b.ent = obj WHERE a.rep <> b.rep""")
def canonical_evaluation_edges(spark, sf_dir):
    rows = stored_edges(spark, sf_dir)
    return canonical.merged_for_evaluation(rows, _mapping(spark, sf_dir, rows))


@R.add(f"""WITH {GRAPH_SQL}, {_WEIGHT_SQL} SELECT ent, CAST(weight AS BIGINT) AS weight FROM w""")
def entity_weights(spark, sf_dir):
    return canonical.entity_weights(edges(spark, sf_dir))


@R.add("""WITH c AS (SELECT 'C' || o_custkey AS name, o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT name, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, arg_min(tag, (-n, tag)) AS tag FROM c GROUP BY name)
SELECT name, 'COMP' AS type, tag, total, top FROM t WHERE total >= 5 AND top / total >= 0.4""")
def dominant_tag(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"), F.lit("COMP").alias("type"), F.col("o_orderpriority").alias("tag")
    )
    return canonical.dominant_tag(rows, 5, 0.4)


_SETS_SQL = """sets AS (SELECT DISTINCT user_id AS id, json_extract_string(props, '$.k') || '/' || event_type AS member FROM events),
sz AS (SELECT id, count(*) AS size FROM sets GROUP BY id),
prs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.member = b.member AND a.id < b.id GROUP BY ALL),
jac AS (SELECT a, b, shared / (x.size + y.size - shared) AS jaccard FROM prs JOIN sz x ON x.id = a JOIN sz y ON y.id = b)"""


def _user_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.concat_ws("/", F.get_json_object("props", "$.k"), "event_type").alias("member")
    )


@R.add(f"WITH {_SETS_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM jac WHERE jaccard >= 0.1")
def jaccard_selfjoin(spark, sf_dir):
    return rounded(canonical.jaccard_pairs(_user_sets(spark, sf_dir), 0.1), "jaccard")


_CC_ROUNDS = 10
# labels spread by one link a round; the rounds are more than the graph's diameter
_CC_SQL = """WITH l AS (SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r0 AS (SELECT DISTINCT a AS node, a AS component FROM e), """ + ", ".join(
    f"r{k + 1} AS MATERIALIZED (SELECT r.node, least(any_value(r.component), min(o.component)) AS component FROM r{k} r JOIN e ON e.a = r.node JOIN r{k} o ON o.node = e.b GROUP BY r.node)"
    for k in range(_CC_ROUNDS)
) + f" SELECT node, component FROM r{_CC_ROUNDS}"


def _component_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()


@R.add(_CC_SQL)
def connected_components(spark, sf_dir):
    links = _component_links(spark, sf_dir)
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select("b"))
    return graph.connected_components(nodes, links)


@R.add("""SELECT o_custkey, o_orderkey, max((o_orderdate >= TIMESTAMP '1997-01-01')::INT) OVER (PARTITION BY o_custkey) = 1 AS is_test FROM orders""")
def group_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group"), "o_orderkey", (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("is_test")
    )
    return canonical.whole_groups_to_test(rows).withColumnRenamed("group", "o_custkey")
