"""Tables in the shared folder that cut lineage, and distributed numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where tables go if the session names no folder, as in local runs.
LOCAL_SCRATCH = "/tmp/chronoweave-scratch"


def scratch(spark: SparkSession, what: str) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    base = base or context.getCheckpointDir()
    return f"{(base or LOCAL_SCRATCH).rstrip('/')}/chronoweave-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the folder that spark.checkpoint.dir names and read it back: lineage ends there, and a lost executor
    costs only what it was working on."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows_per_task: int) -> int:
    """Tasks of about ``rows_per_task`` rows of df, a stored table or a projection of one; adaptive execution sizes tasks
    by compressed bytes, which says little of what rows grow to when they are spread."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def indexed(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: first, first + 1, ... in a total order, without gathering rows in one task.

    A range-partitioned sort gives each row its partition and place; the partitions' sizes (one row a partition, so a
    bounded broadcast) give the offsets.
    """
    at, part = f"__at_{name}", f"__part_{name}"
    rows = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "indexed")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    running = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(part, F.coalesce(running, F.lit(0)).alias("before"))
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.join(F.broadcast(before), part)
    return joined.select(*df.columns, (F.col("before") + place + first).cast("long").alias(name))


def fixpoint(df: DataFrame, step, most: int = 1000) -> DataFrame:
    """Applies ``step`` (rows only leave) until a round keeps as many rows as it got; each round is a written table."""
    df = written(df, "fixpoint")
    size = df.count()
    for _ in range(most):
        df = written(step(df), "fixpoint")
        now = df.count()
        if now == size:
            return df
        size = now
    raise RuntimeError(f"no fixpoint after {most} rounds")
