"""The temporal graph that the driver tables stand for.

An order is an article, a line of it a mention: customer -priority-> supplier, at the order's date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article, ts, head, relation, tail."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("article"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("head"),
        F.col("o_orderpriority").alias("relation"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tail"),
    )


MENTIONS_SQL = """
mentions AS (SELECT o_orderkey AS article, o_orderdate AS ts, 'C' || o_custkey AS head, o_orderpriority AS relation,
                    'S' || l_suppkey AS tail
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: times(bucket, time), edges(subj, rel, obj, time, weight), span(t), forms(subj, rel, obj, time), both(ent, time, n)
GRAPH_SQL = f"""{MENTIONS_SQL},
bucketed AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS bucket FROM mentions),
times AS (SELECT bucket, CAST(row_number() OVER (ORDER BY bucket) - 1 AS INTEGER) AS time
          FROM (SELECT DISTINCT bucket FROM bucketed)),
edges AS (SELECT head AS subj, relation AS rel, tail AS obj, time, count(*) AS weight
          FROM bucketed JOIN times USING (bucket) GROUP BY ALL),
span AS (SELECT CAST(max(time) + 1 AS INTEGER) AS t FROM times),
forms AS (SELECT subj, rel, obj, min(time) AS time FROM edges GROUP BY ALL),
both_ends AS (SELECT ent, time, count(*) AS n
              FROM (SELECT subj AS ent, time FROM forms UNION ALL SELECT obj, time FROM forms) GROUP BY ALL)"""
