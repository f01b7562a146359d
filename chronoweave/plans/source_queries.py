"""Round trips: driver tables are written by a sink to the shared folder, and read back by a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators import graph, stats, themes
from chronoweave.operators.runtime import indexed, scratch, written
from chronoweave.plans.graph_queries import stored_edges
from chronoweave.plans.registry import Registry, rounded
from chronoweave.plans.temporal_queries import _GOLD_SQL, _LINES_SQL, _gold
from chronoweave.sources import core_store, readers, sinks
from chronoweave.sources.fixtures import GRAPH_SQL, mentions, table

R = Registry()


# -- articles
@R.add("""SELECT CAST(doc_id AS VARCHAR) AS row, '2024-01-01' AS date, coalesce(lang, '') AS title, coalesce(source, '') AS ticker, '' AS publisher, text AS body
FROM documents WHERE text IS NOT NULL AND text <> ''""")
def news_csv(spark, sf_dir):
    """Quoted, multi-line bodies through a CSV with a header in each part."""
    path = scratch(spark, "news")
    rows = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select(
        F.col("doc_id").alias("id"), F.lit("2024-01-01").alias("Date"), F.col("lang").alias("Article_title"),
        F.col("source").alias("Stock_symbol"), F.col("text").alias("Article"),
    )
    sinks.append_csv(rows, path)
    return readers.raw_news(spark, path)


@R.add("""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS date, coalesce(text, '') AS body, '' AS ticker, '' AS publisher FROM documents""")
def articles_jsonl(spark, sf_dir):
    """JSON lines by suffix; the columns they lack are empty."""
    path = scratch(spark, "articles") + ".jsonl"
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("date"), F.coalesce("text", F.lit("")).alias("body"))
    sinks.append_json(rows, path)
    return readers.articles(spark, path).select("id", "date", "body", "ticker", "publisher")


@R.add("SELECT doc_id AS id, source AS date, text AS body, '' AS ticker, '' AS publisher FROM documents")
def articles_parquet(spark, sf_dir):
    path = scratch(spark, "articles") + ".parquet"
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("date"), F.col("text").alias("body")).write.parquet(path)
    return readers.articles(spark, path).select("id", "date", "body", "ticker", "publisher")


# -- mentions
_VALID_SQL = """m AS (SELECT o_orderkey AS id, 'C' || o_custkey AS h, o_orderpriority AS r, CASE WHEN l_linenumber = 7 THEN '' ELSE 'S' || l_suppkey END AS o,
CASE l_linenumber % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'TRUE' ELSE 'False' END AS valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _mention_files(spark, sf_dir):
    """Two folders of mention rows in CSV."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    nth = F.col("l_linenumber") % 4
    valid = F.when(nth == 0, "True").when(nth == 1, "true").when(nth == 2, "TRUE").otherwise("False")
    out = rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("date"), F.lit("T").alias("ticker"), F.lit("").alias("publisher"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("h"), F.lit("COMP").alias("h_type"), F.col("o_orderpriority").alias("r"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("o"),
        F.lit("COMP").alias("o_type"), valid.alias("valid"),
    )
    paths = [scratch(spark, f"mentions{k}") for k in (0, 1)]
    for k, path in enumerate(paths):
        sinks.append_csv(out.where(F.col("id") % 2 == k), path)
    return paths


@R.add(f"WITH {_VALID_SQL} SELECT r, count(*) AS n, count(DISTINCT o) AS objects FROM m WHERE lower(valid) = 'true' AND h <> '' AND o <> '' GROUP BY r")
def mention_files(spark, sf_dir):
    """Several CSV files as one table; valid in any case, both ends filled."""
    rows = readers.usable(readers.mentions(spark, _mention_files(spark, sf_dir)))
    return rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("objects"))


@R.add(f"WITH {_VALID_SQL} SELECT h, count(*) AS n FROM m WHERE valid = 'True' GROUP BY h")
def mention_files_strict(spark, sf_dir):
    """``valid`` compared with its case, over two columns of the files."""
    rows = readers.csv(spark, _mention_files(spark, sf_dir), readers.MENTION, multi_line=False)
    return rows.where("valid = 'True'").groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT doc_id, TIMESTAMP '2024-01-31 10:20:30' AS ts FROM documents WHERE doc_id % 3 <> 2""")
def parse_dates(spark, sf_dir):
    """Dates with and without a zone; what doesn't parse goes."""
    nth = F.col("doc_id") % 3
    date = F.when(nth == 0, "2024-01-31 10:20:30 UTC").when(nth == 1, "2024-01-31 10:20:30").otherwise("2024-31-31 99:00")
    return readers.parsed_dates(table(spark, sf_dir, "documents").select("doc_id", date.alias("date"))).select("doc_id", "ts")


# -- stored cores
_CORE_SQL = f"""{GRAPH_SQL}, tot AS (SELECT ent, sum(n) AS n FROM (SELECT subj AS ent, 1 AS n FROM edges UNION ALL SELECT obj, 1 FROM edges) GROUP BY ent)"""


def _core(spark, sf_dir):
    """Stores the graph's core; returns its folder."""
    said, rows, path = mentions(spark, sf_dir), stored_edges(spark, sf_dir), scratch(spark, "core")
    ids = written(graph.entity_dictionary(said).select("name", F.col("id").cast("int").alias("id")), "ids")
    relations = indexed(said.select(F.col("relation").alias("name")).distinct(), ["name"], "id")
    relations = written(relations.select("name", F.col("id").cast("int").alias("id")), "relations")
    coded = graph.encode(rows, ids).join(F.broadcast(relations.select(F.col("name").alias("rel"), F.col("id").alias("r"))), "rel")
    edges = coded.select("subj", F.col("r").alias("rel"), "obj", "time", F.col("weight").cast("int").alias("weight"))
    kind = F.when(F.col("name").startswith("C"), "COMP").otherwise("PRODUCT")
    core_store.store(ids.withColumn("type", kind), relations, graph.time_dictionary(graph.bucketed(said, "week")), edges, path)
    return path


@R.add(f"""WITH {_CORE_SQL} SELECT subj AS subj_name, 'COMP' AS subj_type, rel AS rel_name, obj AS obj_name, 'PRODUCT' AS obj_type, bucket AS date, weight
FROM edges JOIN times USING (time)""")
def core_named(spark, sf_dir):
    """A stored core read back, with ids decoded to names, types and dates."""
    named = core_store.TemporalGraph.load(spark, _core(spark, sf_dir)).named()
    return named.select("subj_name", "subj_type", "rel_name", "obj_name", "obj_type", "date", "weight")


@R.add(f"WITH {_CORE_SQL} SELECT time, count(*) AS n, sum(weight) AS weight FROM edges WHERE rel <> '1-URGENT' GROUP BY time")
def core_without_relation(spark, sf_dir):
    """A core loaded without one of its relations."""
    kg = core_store.TemporalGraph.load(spark, _core(spark, sf_dir), drop_relations=("1-URGENT",))
    return kg.edges.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@R.add(f"""WITH {_CORE_SQL} SELECT (SELECT count(*) FROM tot) AS entities, (SELECT count(DISTINCT rel) FROM edges) AS relations, (SELECT t FROM span) AS times, 6 AS checks""")
def core_sizes(spark, sf_dir):
    """Sizes that a stored core states, and how many of its six checks hold."""
    path = _core(spark, sf_dir)
    kg = core_store.TemporalGraph.load(spark, path)
    held = core_store.check(spark, path).where("ok").agg(F.count(F.lit(1)).cast("int").alias("checks"))
    sizes = [F.lit(n).alias(c) for c, n in (("entities", kg.n_entities), ("relations", kg.n_relations), ("times", kg.n_times))]
    return held.select(*sizes, "checks")


# -- lists, packs, checkpoints
@R.add("SELECT c_mktsegment || '/' || c_custkey AS name FROM customer")
def line_list(spark, sf_dir):
    """A list with a tab-separated remark a line; blank lines go."""
    path = scratch(spark, "list")
    name = F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.concat(name, F.lit("\tremark")).alias("v")).unionAll(spark.createDataFrame([("",), ("  ",)], "v string"))
    rows.write.text(path)
    return readers.lines(spark, path)


@R.add("SELECT CAST(n_nationkey AS INTEGER) AS place, 'k' || n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def json_records(spark, sf_dir):
    """A JSON object of records: a row each, with its key and place."""
    path = scratch(spark, "records")
    rows = table(spark, sf_dir, "nation")
    item = F.concat(F.lit('"k'), F.col("n_nationkey").cast("string"), F.lit('":'), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("j")))), lambda x: x["j"]), ",")
    rows.agg(F.concat(F.lit("{"), whole, F.lit("}")).alias("value")).write.text(path)
    return readers.records(spark, path, "name string, region long")


@R.add("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def json_array_or_lines(spark, sf_dir):
    """A JSON array and JSON lines read alike."""
    path = scratch(spark, "json")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    nation.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).write.text(f"{path}/a")
    sinks.json_lines(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), f"{path}/b")
    return readers.json_any(spark, [f"{path}/a", f"{path}/b"], "id long, name string")


@R.add("""SELECT CAST(c_custkey AS INTEGER) AS theme, count(*) AS n_members_total, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def theme_packs(spark, sf_dir):
    """Nested packs through JSON lines."""
    path = scratch(spark, "packs")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("int").alias("theme")).agg(
        F.count(F.lit(1)).cast("int").alias("n_members_total"),
        F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").cast("double").alias("excess"))).alias("members"),
    )
    sinks.json_lines(orders.withColumn("birth_month", F.lit("1995-01")), path)
    packs = readers.packs(spark, path)
    return packs.select("theme", F.col("n_members_total").cast("long").alias("n_members_total"), F.array_max("members.excess").alias("top"))


@R.add("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def checkpoint_ids(spark, sf_dir):
    """Ids of a JSON-lines checkpoint that was appended to twice, once with a cut line."""
    path = scratch(spark, "done")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    sinks.append_json(orders, path)
    orders.select(F.concat(F.lit('{"id":"'), "id", F.lit('"}')).alias("value")).unionAll(spark.createDataFrame([('{"id":"9',)], "value string")).write.mode("append").text(path)
    return readers.done_ids(spark, path)


@R.add("SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_acctbal > 0")
def selected_list(spark, sf_dir):
    path = scratch(spark, "selected")
    sinks.list_file(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", path)
    return readers.lines(spark, path)


@R.add("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def upsert_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sinks.upsert(rows, rows.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("new")), "c_custkey")


@R.add("SELECT o_orderkey AS id, o_orderkey * 2 AS twice FROM orders")
def resumed_batches(spark, sf_dir):
    """What a cut-off run left is done, in batches; what it had done is not done again."""
    path = scratch(spark, "resumed")
    todo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    process = lambda df: df.select("id", (F.col("id") * 2).alias("twice"))
    process(todo.where("id % 20 = 0")).write.parquet(path)
    sinks.resumable(spark, todo, path, process, batch_rows=1_000_000)
    return spark.read.parquet(path)


# -- strings
@R.add(r"""SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents) WHERE regexp_matches(w, '^[$€£¥\s]*(?:\+|-)?[0-9][0-9,.]*\s*(?:%\s*)?$')
UNION ALL SELECT event_id, x FROM (SELECT event_id, '$' || event_id || ',5 %' AS x FROM events)""")
def numeric_words(spark, sf_dir):
    """Bare numbers, amounts and percentages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    amounts = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("$"), F.col("event_id").cast("string"), F.lit(",5 %")).alias("word"))
    return docs.unionAll(amounts).where(text.is_numeric(F.col("word")))


@R.add("""SELECT c_custkey, (c_custkey // 60) // 60 || 'h' || lpad(CAST((c_custkey // 60) % 60 AS VARCHAR), 2, '0') || 'm' AS eta FROM customer""")
def eta_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.duration(F.col("c_custkey")).alias("eta"))


@R.add("""WITH o AS (SELECT o_custkey, list(o_orderpriority || '-' || lpad(CAST(o_orderkey AS VARCHAR), 30, '0') ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_transform(l[1:5], lambda x: substr(x, 1, 28)), ' | ') AS label FROM o""")
def members_label(spark, sf_dir):
    """The first five names, cut and joined."""
    name = F.concat_ws("-", "o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 30, "0"))
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", name.alias("n")))).alias("l"))
    return held.select("o_custkey", text.clipped_names(F.col("l.n")).alias("label"))


@R.add("""SELECT doc_id, replace(replace('Zeta Corp and Zeta sold 12/24/2023 to Al, ' || lang, 'Zeta Corp', '[ENT0]'), 'Zeta', '[ENT1]').replace('12/24/2023', '[DATE]') AS masked FROM documents WHERE lang IS NOT NULL""")
def mask_entities(spark, sf_dir):
    """Entities longest first to numbered slots, then dates."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    body = F.concat(F.lit("Zeta Corp and Zeta sold 12/24/2023 to Al, "), "lang")
    return docs.select("doc_id", text.mask_entities(body, F.array(F.lit("Zeta"), F.lit("Zeta Corp"), F.lit("Al"))).alias("masked"))


# -- detections
@R.add(f"""WITH {_LINES_SQL}, {_GOLD_SQL}, near AS (SELECT mt.name, event, min(birth) AS birth FROM mt JOIN ev ON ev.name = mt.name AND birth BETWEEN event - 91 AND event + 56 GROUP BY ALL),
l AS (SELECT CAST(trunc((birth - event) / 7) AS INTEGER) AS lead FROM near)
SELECT count(*) AS hits, round(median(lead), 6) AS median_lead, round(avg((lead <= 0)::INT), 6) AS early FROM l""")
def detection_summary(spark, sf_dir):
    """Hits, median lead and share of detections no later than the event."""
    matched, _, events = _gold(spark, sf_dir)
    return rounded(themes.detection_summary(themes.gold_matches(matched, events)), "median_lead", "early")


@R.add("""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, (n_nationkey % 7 + 1) / 10.0::DOUBLE AS p FROM nation),
s(k, d) AS (SELECT 0::BIGINT, [1.0::DOUBLE] UNION ALL
SELECT s.k + 1, list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - p) + CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END * p) FROM s JOIN c ON c.k = s.k + 1)
SELECT 12 AS observed, round(list_sum(d[13:]), 9) AS tail FROM s WHERE k = (SELECT count(*) FROM c)""")
def detection_chance(spark, sf_dir):
    """Chance of 12 or more detections when each nation has its own chance of one."""
    rows = table(spark, sf_dir, "nation").select(((F.col("n_nationkey") % 7 + 1) / 10.0).alias("p"))
    chances = [r["p"] for r in rows.orderBy("p").collect()]
    return spark.createDataFrame([(12, round(stats.detection_tail(chances, 12), 9))], "observed int, tail double")
