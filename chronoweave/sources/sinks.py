"""Writers: appended tables with resumption, JSON lines, single lists, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.runtime import written
from chronoweave.operators.sampling import remaining

#: A noncharacter, for options whose defaults would take a NUL of a text for something else.
NEVER = "\uffff"


def append_csv(df: DataFrame, path: str) -> None:
    """Adds part files with a header each; the readers take a folder as one table. White space around a text is its own."""
    writer = df.write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "")
    writer = writer.option("charToEscapeQuoteEscaping", NEVER)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def list_file(df: DataFrame, column: str, path: str) -> None:
    """One value a line, in one file: for lists that one machine reads."""
    df.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Each row, nested as it is, as a JSON line; nulls are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def upsert(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """current with the rows of the same key replaced."""
    return current.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def resumable(spark: SparkSession, todo: DataFrame, path: str, process, batch_rows: int = 10_000, key: str = "id") -> int:
    """Processes what ``path`` has not got yet, a batch of rows at a time, appending parquet; returns the rows done.

    A batch is on disk before the next one starts, so a run that was cut off goes on where it stopped.
    """
    done = 0
    while True:
        try:
            left = remaining(todo, spark.read.parquet(path), key)
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            left = todo
        batch = written(left.orderBy(key).limit(batch_rows), "batch")
        n = batch.count()
        if not n:
            return done
        process(batch).write.mode("append").parquet(path)
        done += n
