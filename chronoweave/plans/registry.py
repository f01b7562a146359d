"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers the function under its name, with the SQL that gives the same rows."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql.strip()
            return f

        return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """The columns rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, places).alias(c) if c in columns else c for c in df.columns])
