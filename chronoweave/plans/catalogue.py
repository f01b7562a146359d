"""All queries of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.plans import graph_queries, linkpred_queries, source_queries, stats_queries, temporal_queries, text_queries
from chronoweave.plans.registry import Query

PARTS = (graph_queries, temporal_queries, linkpred_queries, text_queries, stats_queries, source_queries)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.R.sql.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["formation_surprise"](spark, sf_dir)
