"""Compositions: event recovery against detectors, and the pipeline with and without some relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import bursts, canonical, linkpred, temporal
from chronoweave.operators.graph import endpoints, without_relations


def event_recovery(events: DataFrame, found: DataFrame, series: DataFrame, n_times: int, pad: int = 3, near: int = 8) -> DataFrame:
    """events (key, week) with hit (a burst within ``pad`` weeks), chance (share of weeks that would hit) and error: weeks
    from the event to the largest count within ``near`` weeks, the first of ties."""
    hit = events.join(found, "key", "left").groupBy("key", "week").agg(
        F.coalesce(F.max((F.col("week") >= F.col("start") - pad) & (F.col("week") <= F.col("end") + pad)), F.lit(False)).alias("hit")
    )
    chance = bursts.coverage(found, n_times, pad).withColumnRenamed("share", "chance")
    local = events.join(series, "key").where(F.abs(F.col("time") - F.col("week")) <= near)
    onset = local.groupBy("key", "week").agg(F.max_by("time", F.struct("n", -F.col("time"))).alias("onset"))
    return hit.join(chance, "key", "left").join(onset, ["key", "week"], "left").select(
        "key", "week", "hit", F.coalesce("chance", F.lit(0.0)).alias("chance"), (F.col("onset") - F.col("week")).alias("error")
    )


def recovery_summary(recovered: DataFrame) -> DataFrame:
    """events, hits, recall, chance, excess."""
    return recovered.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("recall"),
        F.avg("chance").alias("chance"),
    ).withColumn("excess", F.col("recall") - F.col("chance"))


def without_and_with(edges: DataFrame, relations: list[str]) -> DataFrame:
    """time, all_formations, kept_formations: formations of the graph and of the graph without some relations."""
    one = temporal.formations(edges).groupBy("time").agg(F.count(F.lit(1)).alias("all_formations"))
    two = temporal.formations(without_relations(edges, relations)).groupBy("time").agg(F.count(F.lit(1)).alias("kept_formations"))
    return temporal.calendar(edges).join(one, "time", "left").join(two, "time", "left").fillna(0, ["all_formations", "kept_formations"])


def merge_effect(edges: DataFrame, mapping: DataFrame, first_test: int) -> DataFrame:
    """graph (plain, merged), n_edges, novelty, mrr of recurrence, before and after a merge."""
    out = None
    for name, rows in (("plain", edges), ("merged", canonical.merged_for_evaluation(edges, mapping))):
        pool = endpoints(rows).distinct().count()
        ranks = linkpred.recurrence_ranks(rows, first_test, pool)
        part = ranks.agg(
            F.lit(name).alias("graph"),
            F.count(F.lit(1)).alias("n_ranks"),
            F.avg((F.col("seen") == 0).cast("double")).alias("novelty"),
            F.avg(1 / F.col("rank")).alias("mrr"),
        )
        out = part if out is None else out.unionAll(part)
    return out
