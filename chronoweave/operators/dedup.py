"""Exact duplicates and templated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import lede, slot_norm

RECURRENCES, ENTITY_SHARE, ENTITY_LEAST = 25, 0.60, 50


def fingerprint(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)


def keep_first(rows: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """One row of each body, that with the smallest key: a minimum by hash, then a join on the keys that stay."""
    first = rows.groupBy(fingerprint(F.col(body)).alias("__h")).agg(F.min(key).alias(key)).select(key)
    return rows.join(first, key, "left_semi")


def dropped(rows: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """Keys of the rows that keep_first leaves out."""
    return rows.select(key).join(keep_first(rows, body, key).select(key), key, "left_anti")


def duplicate_rate(rows: DataFrame, body: str = "body") -> DataFrame:
    """n, distinct_bodies, rate."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fingerprint(F.col(body))).alias("distinct_bodies"))
    return out.withColumn("rate", 1 - F.col("distinct_bodies") / F.col("n"))


def duplicate_groups(rows: DataFrame, body: str, tag: str, week: str) -> DataFrame:
    """h, copies, tags, span: groups of equal bodies, how many tags they have and how many weeks they span."""
    return (
        rows.groupBy(fingerprint(F.col(body)).alias("h"))
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_distinct(tag).alias("tags"),
            (F.max(week) - F.min(week)).alias("span"),
        )
        .where("copies > 1")
    )


def templated(rows: DataFrame, title: str, body: str, least: int = RECURRENCES) -> DataFrame:
    """rows with ``templated``: the skeleton of the title, or of the body's first 120 characters, occurs ``least`` times."""
    keyed = rows.withColumn("__t", slot_norm(F.col(title))).withColumn("__b", slot_norm(lede(F.col(body))))

    def frequent(c: str) -> DataFrame:
        return keyed.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(c, F.lit(True).alias(f"{c}_hit"))

    joined = keyed.join(frequent("__t"), "__t", "left").join(frequent("__b"), "__b", "left")
    flag = F.coalesce("__t_hit", F.lit(False)) | F.coalesce("__b_hit", F.lit(False))
    return joined.select(*rows.columns, flag.alias("templated"))


def template_entities(mentions: DataFrame, flagged: DataFrame, least: int = ENTITY_LEAST, share: float = ENTITY_SHARE) -> DataFrame:
    """ent, n, share of entities that mostly occur in templated articles. mentions: article, head, tail; flagged: article."""
    known = mentions.join(flagged.select("article", F.lit(1).alias("__t")).distinct(), "article", "left")
    ends = known.select("__t", F.explode(F.array("head", "tail")).alias("ent"))
    rows = ends.groupBy("ent").agg(F.count(F.lit(1)).alias("n"), F.count("__t").alias("t"))
    return rows.select("ent", "n", (F.col("t") / F.col("n")).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))
