"""Samples, shards and resumption, all deterministic in the rows' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions.text import word_count
from chronoweave.operators.runtime import indexed


def hash_order(key: str, seed: int) -> Column:
    """md5 of seed and key: the same order in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def per_group_sample(rows: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group, those with the smallest hash of their key.

    Only (group, hash, key) is ranked. A task keeps its own k best before the shuffle, so a group as large as the input
    costs k rows a task.
    """
    keyed = rows.select(group, hash_order(key, seed).alias("h"), key)
    near = F.row_number().over(Window.partitionBy("__task", group).orderBy("h", key))
    own = keyed.withColumn("__task", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("r", near).where(F.col("r") <= k)
    best = F.row_number().over(Window.partitionBy(group).orderBy("h", key))
    chosen = own.withColumn("r", best).where(F.col("r") <= k).select(group, key)
    return rows.join(chosen, [group, key], "left_semi")


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those with the smallest hash of their key (a top-n, no full sort)."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def group_counts(rows: DataFrame, sample: DataFrame, group: str) -> DataFrame:
    """group, available, selected."""
    a = rows.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    s = sample.groupBy(group).agg(F.count(F.lit(1)).alias("selected"))
    return a.join(s, group, "left").fillna(0, ["selected"])


def with_ids(rows: DataFrame, order: list, prefix: str = "a", name: str = "id") -> DataFrame:
    """Adds a0000000, a0000001, ... in the given total order."""
    return indexed(rows, order, "__n").withColumn(name, F.format_string(f"{prefix}%07d", "__n")).drop("__n")


def shard(rows: DataFrame, order: list, n: int, i: int) -> DataFrame:
    """Every n-th row from the i-th on, in a total order."""
    return indexed(rows, order, "__n").where(F.pmod("__n", F.lit(n)) == i).drop("__n")


def remaining(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def valid_articles(rows: DataFrame, first_year: int, last_year: int, min_words: int = 0, min_chars: int = 0) -> DataFrame:
    """Rows (date, body) with a date of seven characters or more that starts with a year in the range, and a long
    enough body."""
    dated = F.col("date").rlike(r"(?s)^\d{4}.{3}")
    year = F.when(dated, F.substring("date", 1, 4)).try_cast("int")
    return rows.where(
        dated
        & year.between(first_year, last_year)
        & (word_count(F.col("body")) >= min_words)
        & (F.coalesce(F.length("body"), F.lit(0)) >= min_chars)
    )
