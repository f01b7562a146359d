"""A stored graph ("core"): tab-separated dictionaries, split files and weighted edges in one folder, or parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.ontology import TYPE_IDS, type_id
from chronoweave.functions.text import is_brand
from chronoweave.operators.graph import QUAD, split_bounds, split_index, without_entities, without_relations

ENTITIES, RELATIONS, TIMES = "entity2id.txt", "relation2id.txt", "time2date.txt"
EDGES, STAT = "edges_weighted.tsv", "stat.txt"
SPLITS = "train valid test".split()
EDGE_SCHEMA = "subj int, rel int, obj int, time_id int, weight int"


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "")
    return reader.option("nullValue", "\0").option("emptyValue", "").csv(path)


@dataclass
class TemporalGraph:
    """A core as lazy tables. edges: subj, rel, obj, time, weight; dictionaries by id; n_entities counts every stored
    entity, also those whose edges a filter took."""

    edges: DataFrame
    entities: DataFrame
    relations: DataFrame
    times: DataFrame
    n_entities: int
    n_relations: int
    n_times: int

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, drop_brands: bool = False, drop_relations: tuple[str, ...] = ()
    ) -> TemporalGraph:
        entities = _tsv(spark, f"{path}/{ENTITIES}", "name string, id int, type string, tid int")
        relations = _tsv(spark, f"{path}/{RELATIONS}", "name string, id int")
        times = _tsv(spark, f"{path}/{TIMES}", "tid int, date date")
        edges = _tsv(spark, f"{path}/{EDGES}", EDGE_SCHEMA, header=True).withColumnRenamed("time_id", "time")
        if drop_brands:
            edges = without_entities(edges, entities.where(is_brand(F.col("name"))).select(F.col("id").alias("ent")))
        if drop_relations:
            known = [r["id"] for r in relations.where(F.col("name").isin(*drop_relations)).select("id").collect()]
            edges = without_relations(edges, known)
        sizes = spark.read.text(f"{path}/{STAT}").first()[0].split()
        return cls(edges, entities, relations, times, *[int(x) for x in sizes[:3]])

    def named(self) -> DataFrame:
        """Edges with names and types of both ends, the relation's name and the week's date."""
        one = self.entities.select(F.col("id").alias("subj"), F.col("name").alias("subj_name"), F.col("type").alias("subj_type"))
        two = self.entities.select(F.col("id").alias("obj"), F.col("name").alias("obj_name"), F.col("type").alias("obj_type"))
        rel = self.relations.select(F.col("id").alias("rel"), F.col("name").alias("rel_name"))
        when = self.times.select(F.col("tid").alias("time"), "date")
        return self.edges.join(one, "subj").join(two, "obj").join(F.broadcast(rel), "rel").join(F.broadcast(when), "time")

    def bounds(self) -> tuple[int, int]:
        """First validation and test week."""
        row = self.edges.sparkSession.range(1).select(*split_bounds(F.lit(self.n_times))).first()
        return row[0], row[1]


def store(entities: DataFrame, relations: DataFrame, times: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a core: entities (name, id, type), relations (name, id), times (time, bucket), edges by ids.

    Each file name is a folder of part files, which ``load`` reads as one.
    """

    def put(df: DataFrame, name: str, header: bool = False) -> None:
        df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option(
            "emptyValue", ""
        ).csv(f"{path}/{name}")

    n = [df.count() for df in (entities, relations, times)]
    put(entities.select("name", "id", "type", type_id(F.col("type")).alias("tid")), ENTITIES)
    put(relations.select("name", "id"), RELATIONS)
    put(times.select(F.col("time"), F.col("bucket").cast("date")), TIMES)
    put(edges.select("subj", "rel", "obj", F.col("time").alias("time_id"), "weight"), EDGES, header=True)
    placed = split_index(edges)
    for split in SPLITS:
        put(placed.where(F.col("split") == split).select(*QUAD, "idx"), f"{split}.txt")
    spark = edges.sparkSession
    spark.createDataFrame([(" ".join(map(str, n)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{STAT}")


def check(spark: SparkSession, path: str) -> DataFrame:
    """check, ok: ids in range, weights positive, splits disjoint and ordered, sizes as stated."""
    kg = TemporalGraph.load(spark, path)
    first_valid, first_test = kg.bounds()
    parts = {s: _tsv(spark, f"{path}/{s}.txt", "subj int, rel int, obj int, time int, idx long") for s in SPLITS}
    union = None
    for name, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi")).withColumn("split", F.lit(name))
        union = row if union is None else union.unionAll(row)
    got = {r["split"]: r for r in union.collect()}
    edge = kg.edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.greatest("subj", "obj")).alias("top"),
        F.max("rel").alias("rel"),
        F.max("time").alias("time"),
        F.min("weight").alias("weight"),
    ).first()
    inside = lambda s, lo, hi: got[s]["n"] == 0 or lo <= got[s]["lo"] and got[s]["hi"] < hi
    rows = [
        ("rows of the splits make up the edges", sum(r["n"] for r in got.values()) == edge["n"]),
        ("ids are in range", (edge["top"] or 0) < kg.n_entities and (edge["rel"] or 0) < kg.n_relations),
        ("times are in range", (edge["time"] or 0) < kg.n_times),
        ("weights are positive", (edge["weight"] or 1) >= 1),
        ("splits are ordered", inside("train", 0, first_valid) and inside("valid", first_valid, first_test)
         and inside("test", first_test, kg.n_times)),
        ("twelve types", len(TYPE_IDS) == 12),
    ]
    return spark.createDataFrame(rows, "check string, ok boolean")
