"""From mentions to the temporal graph: time buckets, dictionaries, edge-weeks, splits, core pruning.

mentions: article, ts, head, relation, tail. edges: subj, rel, obj, time, weight; one row a distinct quadruple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.runtime import fixpoint, indexed

#: Columns of a quadruple.
QUAD = "subj rel obj time".split()
TRAIN, VALID = 0.70, 0.15


# -- time
def week_bucket(ts: Column) -> Column:
    """The Monday on or before."""
    return F.date_trunc("week", ts).cast("date")


def month_bucket(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("date")


def fortnight_bucket(ts: Column, anchor: Column) -> Column:
    """Starts of 14-day periods counted from the anchor date."""
    return F.date_add(anchor, (F.floor(F.datediff(ts.cast("date"), anchor) / 14) * 14).cast("int"))


def bucketed(mentions: DataFrame, resolution: str = "week") -> DataFrame:
    """Adds ``bucket``. A fortnight is anchored at the earliest date of all mentions."""
    if resolution == "week":
        return mentions.withColumn("bucket", week_bucket(F.col("ts")))
    if resolution == "month":
        return mentions.withColumn("bucket", month_bucket(F.col("ts")))
    if resolution == "fortnight":
        anchor = mentions.agg(F.min(F.col("ts").cast("date")).alias("anchor"))
        joined = mentions.crossJoin(F.broadcast(anchor))  # one row
        return joined.withColumn("bucket", fortnight_bucket(F.col("ts"), F.col("anchor"))).drop("anchor")
    raise ValueError(f"unknown resolution {resolution!r}")


def time_dictionary(with_buckets: DataFrame) -> DataFrame:
    """bucket, time: dense ids of the buckets that occur; a missing week takes no id. One row a bucket."""
    place = F.row_number().over(Window.orderBy("bucket")) - 1
    return with_buckets.select("bucket").distinct().select("bucket", place.cast("int").alias("time"))


# -- edges and dictionaries
def assemble(mentions: DataFrame, resolution: str = "week") -> DataFrame:
    """Edges with their mention counts; names stay names. The calendar is small and broadcast."""
    rows = bucketed(mentions, resolution)
    counted = rows.groupBy("head", "relation", "tail", "bucket").agg(F.count(F.lit(1)).alias("weight"))
    times = time_dictionary(rows)
    return counted.join(F.broadcast(times), "bucket").select(
        F.col("head").alias("subj"), F.col("relation").alias("rel"), F.col("tail").alias("obj"), "time", "weight"
    )


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """ent and ``keep``: each edge twice, once for each end; a self-loop counts twice."""
    return edges.select(F.col("subj").alias("ent"), *keep).unionAll(edges.select(F.col("obj").alias("ent"), *keep))


def entity_dictionary(mentions: DataFrame) -> DataFrame:
    """name, n, id: id 0 is the most frequent; ties by name."""
    names = mentions.select(F.col("head").alias("name")).unionAll(mentions.select(F.col("tail").alias("name")))
    counted = names.where("name is not null and name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return indexed(counted, [F.desc("n"), F.asc("name")], "id")


def encode(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names of both ends to ids; edges of unknown names go."""
    ids = dictionary.select("name", "id")
    return (
        edges.join(ids.select(F.col("name").alias("subj"), F.col("id").alias("s")), "subj")
        .join(ids.select(F.col("name").alias("obj"), F.col("id").alias("o")), "obj")
        .select(F.col("s").alias("subj"), "rel", F.col("o").alias("obj"), "time", "weight")
    )


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties by the value; counts are combined before the shuffle by key."""
    counted = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("best")
    return counted.groupBy(key).agg(best).select(key, F.col("best.v").alias(value), (-F.col("best.m")).alias("votes"))


# -- splits
def split_bounds(n_times: Column, train: float = TRAIN, valid: float = VALID) -> tuple[Column, Column]:
    """First validation and first test bucket, truncated as IEEE doubles are."""
    return (
        F.floor(n_times.cast("double") * F.lit(train)).cast("int"),
        F.floor(n_times.cast("double") * F.lit(train + valid)).cast("int"),
    )


def with_split(edges: DataFrame, train: float = TRAIN, valid: float = VALID) -> DataFrame:
    """Adds split: train, valid or test, by the number of buckets."""
    first_valid, first_test = split_bounds(F.col("n_times"), train, valid)
    span = edges.agg((F.max("time") + 1).alias("n_times"))  # one row
    label = F.when(F.col("time") < first_valid, "train").when(F.col("time") < first_test, "valid").otherwise("test")
    return edges.crossJoin(F.broadcast(span)).withColumn("split", label).drop("n_times")


def split_index(edges: DataFrame) -> DataFrame:
    """Adds idx: the place of each edge in its split's file order, time, subj, rel, obj."""
    numbered = indexed(with_split(edges), ["split", "time", "subj", "rel", "obj"], "place")
    first = numbered.groupBy("split").agg(F.min("place").alias("first"))  # three rows
    return numbered.join(F.broadcast(first), "split").select(
        *QUAD, "weight", "split", (F.col("place") - F.col("first")).alias("idx")
    )


# -- core
def degrees(edges: DataFrame) -> DataFrame:
    """ent, degree: incident edge-weeks, not distinct neighbours."""
    return endpoints(edges).groupBy("ent").agg(F.count(F.lit(1)).alias("degree"))


def degree_core(edges: DataFrame, min_weight: int = 2, min_degree: int = 2) -> DataFrame:
    """Edges of weight at least ``min_weight`` whose ends both have degree at least ``min_degree`` among what is left,
    to the fixpoint. A round is one count and two semi-joins."""

    def step(e: DataFrame) -> DataFrame:
        keep = degrees(e).where(F.col("degree") >= min_degree).select("ent")
        return e.join(keep.withColumnRenamed("ent", "subj"), "subj", "left_semi").join(
            keep.withColumnRenamed("ent", "obj"), "obj", "left_semi"
        )

    return fixpoint(edges.where(F.col("weight") >= min_weight), step).select(*edges.columns)


def reindexed(edges: DataFrame) -> DataFrame:
    """ent, degree, id of the survivors, id 0 the highest degree; ties by name."""
    return indexed(degrees(edges), [F.desc("degree"), F.asc("ent")], "id")


def without_entities(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with neither end in names (ent)."""
    out = names.select("ent").distinct()
    return edges.join(out.withColumnRenamed("ent", "subj"), "subj", "left_anti").join(
        out.withColumnRenamed("ent", "obj"), "obj", "left_anti"
    )


def without_relations(edges: DataFrame, relations: list[str]) -> DataFrame:
    return edges.where(~F.col("rel").isin(relations))


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("subj") != F.col("obj"))


# -- connected components
def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links (a, b) reach. Rounds of large stars and small stars: every node
    passes its least neighbour on, by a minimum and a join; no neighbourhood is ever gathered."""
    from chronoweave.operators.runtime import written

    now = written(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst"), "links")
    seen = None
    while True:
        both = now.select("src", "dst").unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        now = written(small.unionAll(low.select("src", F.col("m").alias("dst"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == seen:
            break
        seen = state
    return nodes.select("node").distinct().join(now.withColumnRenamed("src", "node"), "node", "left").select(
        "node", F.coalesce("dst", "node").alias("component")
    )
