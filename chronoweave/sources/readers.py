"""Readers with explicit schemas: article tables, packs, dictionaries, lists. Text is never taken for null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.sinks import NEVER

RAW_NEWS = ["Date", "Article_title", "Stock_symbol", "Publisher", "Article", "Url", "Author"]
ARTICLE_DEFAULTS = ("ticker", "publisher")
ARTICLE_REQUIRED = ("id", "date", "body")
PACK = (
    "theme int, birth_month string, n_members_total int, members array<struct<name string, excess double>>,"
    " headlines array<struct<date string, ticker string, members_hit array<string>, title string, body_lede string>>"
)
MENTION = "id string, date string, ticker string, publisher string, h string, h_type string, r string, o string, o_type string, valid string"


def csv(spark: SparkSession, path, schema: str | None = None, sep: str = ",", header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with quoted, multi-line fields; bad bytes are replaced, ragged rows filled up or cut; an unquoted empty field
    is the only null. Paths may be a list."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", multi_line)
    reader = reader.option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", NEVER * 2)
    reader = reader.option("charToEscapeQuoteEscaping", NEVER)
    reader = reader.option("emptyValue", "").option("maxCharsPerColumn", -1).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def raw_news(spark: SparkSession, path, text_column: str = "Article") -> DataFrame:
    """row, date, title, ticker, publisher, body of a news CSV whose first column numbers the rows; rows without a body
    go. Columns are found by name; those that the file lacks are empty."""
    rows = csv(spark, path)
    first = rows.columns[0]
    get = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.where(F.col(f"`{text_column}`").isNotNull()).select(
        F.coalesce(F.col(f"`{first}`"), F.lit("")).alias("row"),
        get("Date").alias("date"),
        get("Article_title").alias("title"),
        get("Stock_symbol").alias("ticker"),
        get("Publisher").alias("publisher"),
        get(text_column).alias("body"),
    )


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from parquet, JSON lines or a JSON array, by suffix; missing optional columns are empty."""
    low = path.lower()
    if low.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif low.endswith((".jsonl", ".ndjson")):
        rows = spark.read.json(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
    missing = [c for c in ARTICLE_REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    for c in ARTICLE_DEFAULTS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    return rows


def mentions(spark: SparkSession, paths) -> DataFrame:
    """Mention rows of one or more CSV files; ``valid`` is read as a boolean in any spelling of case."""
    rows = csv(spark, paths, MENTION, multi_line=False)
    return rows.withColumn("valid", F.lower("valid") == "true")


def usable(rows: DataFrame) -> DataFrame:
    """Valid mentions with both ends, types and relation."""
    filled = (F.col("h") != "") & (F.col("o") != "")
    return rows.where(F.col("valid") & filled).dropna(subset=["h", "o", "h_type", "o_type", "r"])


def parsed_dates(rows: DataFrame, column: str = "date") -> DataFrame:
    """Adds ts; a `` UTC`` suffix is ignored and rows that don't parse go."""
    ts = F.try_to_timestamp(F.regexp_replace(column, " UTC", ""))
    return rows.withColumn("ts", ts.cast("timestamp_ntz")).where("ts is not null")


def packs(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(PACK).json(path)


def done_ids(spark: SparkSession, path) -> DataFrame:
    """ids of a JSON-lines checkpoint; a cut last line is left out."""
    return spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path).where("id is not null").distinct()


def lines(spark: SparkSession, path) -> DataFrame:
    """First tab-separated field of each non-blank line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(F.split("value", "\t"), 1).alias("name"))


def records(spark: SparkSession, path, item: str) -> DataFrame:
    """Rows of a JSON object of records, with the key's place; ``item`` is the records' schema."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string, struct<{item}>>")
    return whole.select(F.posexplode(F.map_entries(parsed)).alias("place", "e")).select("place", "e.key", "e.value.*")


def json_any(spark: SparkSession, path, schema: str) -> DataFrame:
    """Rows of a JSON array or of JSON lines, whichever the file holds."""
    whole = spark.read.text(path, wholetext=True)
    is_array = F.ltrim("value").startswith("[")
    arrays = whole.where(is_array).select(F.inline(F.from_json("value", f"array<struct<{schema}>>")))
    each = whole.where(~is_array).select(F.explode(F.split("value", "\r?\n")).alias("line")).where(F.trim("line") != "")
    return arrays.unionAll(each.select(F.from_json("line", schema).alias("r")).select("r.*"))


def vectors(spark: SparkSession, path, name: str = "embedding") -> DataFrame:
    """id and ``name`` (array of float) of a parquet table; the place of stored matrices."""
    return spark.read.parquet(path).withColumn(name, F.col(name).cast("array<float>"))
