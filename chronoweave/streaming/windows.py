"""Structured Streaming forms of the windowed operators: a stream of mentions or events, event time, a watermark.

Late rows: a row counts in the window of its own time as long as the watermark has not passed that window's end; later
ones are dropped by the engine. ``run_available`` drives a stream over all there is, for batch parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.runtime import scratch

#: Weeks start on Mondays; the first Monday after the epoch is its fifth day.
MONDAY = "4 days"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's parquet files as a stream; one file a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def tumbling_counts(rows: DataFrame, time: str, *keys: str, width: str = "7 days", offset: str = MONDAY, late: str = "7 days") -> DataFrame:
    """window start, keys, n."""
    timed = rows.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width, width, offset).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("date").alias("bucket"), *keys, "n"
    )


def sliding_counts(rows: DataFrame, time: str, *keys: str, width: str = "28 days", slide: str = "7 days", late: str = "7 days") -> DataFrame:
    """Last bucket's start of each sliding window, keys, n: the trailing observed count."""
    timed = rows.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    counted = timed.groupBy(F.window("__ts", width, slide, MONDAY).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_sub(F.col("w.end").cast("date"), 7).alias("bucket"), *keys, "n")


def run_available(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Runs the stream over all available files and returns its result table.

    Complete results go to the shared folder from the last micro-batch, append results as a file sink; nothing is held
    on the driver.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch(spark, f"{name}-state"))
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        put = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
