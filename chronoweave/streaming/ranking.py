"""Point-in-time ranking as a stream: score a week against the tables of earlier weeks, then add it to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.linkpred import recurrence_ranks
from chronoweave.operators.runtime import scratch


class RankSweep:
    """History and ranks as folders of parquet; ``put`` is a foreachBatch function over edges in week order."""

    def __init__(self, spark: SparkSession, n_entities: int, schema):
        self.spark, self.n, self.schema = spark, n_entities, schema
        self.history, self.ranks = scratch(spark, "history"), scratch(spark, "ranks")
        spark.createDataFrame([], schema).write.parquet(f"{self.history}/batch=-1")

    def put(self, batch: DataFrame, batch_id: int) -> None:
        first = batch.agg(F.min("time")).first()[0]
        if first is None:
            return
        known = self.spark.read.schema(self.schema).parquet(self.history)
        both = known.where(F.col("time") < first).select(*batch.columns).unionAll(batch)
        recurrence_ranks(both, first, self.n).write.mode("overwrite").parquet(f"{self.ranks}/batch={batch_id}")
        # a batch that is tried again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{self.history}/batch={batch_id}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Ranks of every edge of the stream."""
        query = (
            stream.writeStream.trigger(availableNow=True)
            .option("checkpointLocation", scratch(self.spark, "sweep"))
            .foreachBatch(self.put)
            .start()
        )
        query.awaitTermination()
        return self.spark.read.parquet(self.ranks).drop("batch")
