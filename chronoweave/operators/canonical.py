"""Entity canonicalisation: name keys, dominant tags, merge rules by connected components, merged graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from chronoweave.functions.text import key_norm
from chronoweave.operators.graph import QUAD, connected_components, endpoints
from chronoweave.operators.runtime import indexed, written

CORPORATE = tuple("COMP ORG ORG/GOV ORG/REG".split())
DOMINANCE, LEAST_MENTIONS = 0.60, 10


def dominant_tag(mentions: DataFrame, least: int = LEAST_MENTIONS, share: float = DOMINANCE) -> DataFrame:
    """name, type, tag, total, top: the tag with at least ``share`` of an entity's tagged mentions; ties by tag."""
    counted = mentions.groupBy("name", "type", "tag").agg(F.count(F.lit(1)).alias("n"))
    by = counted.groupBy("name", "type").agg(
        F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("tag").alias("t"))).alias("best")
    )
    top = -F.col("best.m")
    return by.where((F.col("total") >= least) & (top / F.col("total") >= share)).select(
        "name", "type", F.col("best.t").alias("tag"), "total", top.alias("top")
    )


def title_anchors(titles: DataFrame) -> DataFrame:
    """key, tag of a register (place, title, tag); the first title with a key gives it."""
    keyed = titles.select(key_norm(F.col("title")).alias("key"), "tag", "place")
    return keyed.groupBy("key").agg(F.min_by("tag", "place").alias("tag"))


def alias_table(entities: DataFrame, dominant: DataFrame, titles: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """id, name, type, key, mergeable, tag, group (the smallest id merged with) of entities (id, name, type).

    Same type and key merge, unless the key's anchors conflict: then only within each anchor. Anchored companies also
    merge by anchor and first word. An exact title wins over a dominant tag. ``blocked`` (name) never merges.
    """
    rows = entities.select("id", "name", "type", key_norm(F.col("name")).alias("key"))
    free = F.col("type").isin(*CORPORATE) & (F.length("key") > 2)
    if blocked is not None:
        rows = rows.join(blocked.select("name", F.lit(True).alias("__blocked")).distinct(), "name", "left")
        free = free & F.col("__blocked").isNull()
    rows = rows.withColumn("mergeable", free)
    by_title = title_anchors(titles).withColumnRenamed("tag", "__title")
    by_mention = dominant.where("type = 'COMP'").select("name", F.col("tag").alias("__mention"))
    anchor = F.when(F.col("mergeable") & (F.col("type") == "COMP"), F.coalesce("__title", "__mention"))
    rows = rows.join(by_title, "key", "left").join(by_mention, "name", "left").select(
        "id", "name", "type", "key", "mergeable", anchor.alias("tag")
    )
    can = rows.where("mergeable")
    anchors = can.groupBy("type", "key").agg(F.count_distinct("tag").alias("anchors"))
    can = can.join(anchors, ["type", "key"])
    # a group's first id stands for it; links are a star, one for each other member
    plain = can.where("anchors <= 1").select("id", F.concat_ws("\0", F.lit("k"), "type", "key").alias("g"))
    split = can.where("anchors > 1 and tag is not null").select("id", F.concat_ws("\0", F.lit("s"), "type", "key", "tag").alias("g"))
    company = can.where("tag is not null and type = 'COMP'").select(
        "id", F.concat_ws("\0", F.lit("t"), "tag", F.element_at(F.split("key", " "), 1)).alias("g")
    )
    groups = plain.unionAll(split).unionAll(company)
    first = groups.groupBy("g").agg(F.min("id").alias("first"))
    links = groups.join(first, "g").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = connected_components(can.select(F.col("id").alias("node")), links)
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "name", "type", "key", "mergeable", "tag", F.coalesce("component", "id").alias("group")
    )


def entity_weights(edges: DataFrame) -> DataFrame:
    """ent, weight: summed mention weights at both ends."""
    return endpoints(edges, "weight").groupBy("ent").agg(F.sum("weight").alias("weight"))


def representatives(groups: DataFrame, weights: DataFrame) -> DataFrame:
    """group, rep: the heaviest member, then the smallest, of groups (ent, group)."""
    joined = groups.join(weights, "ent", "left").withColumn("w", F.coalesce("weight", F.lit(0)))
    best = F.min(F.struct((-F.col("w")).alias("m"), F.col("ent").alias("e"))).alias("best")
    return joined.groupBy("group").agg(best).select("group", F.col("best.e").alias("rep"))


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends replaced by mapping (ent, to); self-loops that come about go."""
    return (
        edges.join(mapping.select(F.col("ent").alias("subj"), F.col("to").alias("s")), "subj", "left")
        .join(mapping.select(F.col("ent").alias("obj"), F.col("to").alias("o")), "obj", "left")
        .select(
            F.coalesce("s", "subj").alias("subj"), "rel", F.coalesce("o", "obj").alias("obj"), "time", "weight"
        )
        .where("subj <> obj")
    )


def merged_core(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The merged graph as it is stored: weights of equal quadruples add up."""
    return remapped(edges, mapping).groupBy(*QUAD).agg(F.sum("weight").alias("weight"))


def merged_for_evaluation(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The merged graph as it is evaluated: equal quadruples once, without weights."""
    return remapped(edges, mapping).select(*QUAD).distinct()


def merge_groups(table: DataFrame, weights: DataFrame) -> DataFrame:
    """group, size, type, tag, members (names by weight, then name) of groups of two or more; type and tag are the
    heaviest member's, the tag that of the heaviest that has one."""
    rows = table.join(weights.withColumnRenamed("ent", "id"), "id", "left").withColumn("w", F.coalesce("weight", F.lit(0)))
    order = F.struct((-F.col("w")).alias("m"), F.col("name").alias("n"))
    tagged = F.when(F.col("tag").isNotNull(), order)
    names = F.array_sort(F.collect_list(order))
    return (
        rows.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min_by("type", order).alias("type"),
            F.min_by("tag", tagged).alias("tag"),
            F.array_join(F.transform(names, lambda x: x["n"]), " | ").alias("members"),
        )
        .where("size > 1")
    )


# -- similarity groups
#: Sets of a block; two blocks are one task. Members and sets that a worker spells out at once.
BLOCK, TILE, MEMBERS = 4096, 1024, 4096
#: Pairs of sets by shared members, for each pair of any sets, from which blocks cost less than a join.
DENSE = 0.02


def jaccard_pairs(sets: DataFrame, least: float = 0.3) -> DataFrame:
    """a, b, jaccard of sets (id, member) that overlap that much: pairs only come from shared members.

    A join meets each shared member of each pair. Where sets share so much that this is of the order of all pairs, blocks
    of sets are multiplied instead: exact as well, and only pairs that are returned leave a task.
    """
    rows = sets.select("id", "member").where("id is not null").distinct()
    held = written(rows, "sets")
    n = held.select("id").distinct().count()
    sharing = held.where("member is not null").groupBy("member").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    if n > TILE and sharing > DENSE * n * (n - 1):
        return _block_pairs(held, n, least)
    return _joined_pairs(held, least)


def _joined_pairs(rows: DataFrame, least: float) -> DataFrame:
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    both = left.join(right, "member").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(
        sizes.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b"
    )
    share = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return out.select("a", "b", share.alias("jaccard")).where(F.col("jaccard") >= least)


def _block_pairs(rows: DataFrame, n: int, least: float) -> DataFrame:
    """Every two blocks of sets meet in one task, as products of membership matrices a tile at a time."""
    kind, blocks = rows.schema["id"].dataType, -(-n // BLOCK)
    codes = indexed(rows.where("member is not null").select("member").distinct(), ["member"], "code")
    # a null member counts and is shared with none
    sets = rows.join(codes, "member", "left").groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.col("code").cast("int")).alias("codes"))
    sets = written(sets.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "sets")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = sets.select("id", "size", "codes", "block", F.explode(every).alias("other")).select(
        "id", "size", "codes", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block"
    )
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("jaccard", DoubleType())])
    found = sent.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q").applyInArrow(_block_run(least, TILE, MEMBERS), schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def _block_run(least: float, tile: int, members: int):
    def matrix(lists, lo, hi):
        """Rows of the sets by members lo to hi."""
        each, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
        at = np.repeat(np.arange(len(lists)), each)
        inside = (flat >= lo) & (flat < hi)
        out = np.zeros((len(lists), hi - lo), np.float32)
        out[at[inside], flat[inside] - lo] = 1
        return out

    def run(key, table):
        p, q = (k.as_py() for k in key)
        side = lambda k: table.filter(pc.equal(table["block"], k)).combine_chunks()
        left, right = side(p), side(q)
        size = lambda t: t["size"].to_numpy()
        for i in range(0, left.num_rows, tile):
            x = left.slice(i, tile)
            for j in range(i if p == q else 0, right.num_rows, tile):
                y = right.slice(j, tile)
                xs, ys = (t["codes"].combine_chunks() for t in (x, y))
                top = int(min(c.flatten().to_numpy().max(initial=-1) for c in (xs, ys))) + 1
                both = np.zeros((x.num_rows, y.num_rows))
                for lo in range(0, top, members):
                    both += matrix(xs, lo, min(lo + members, top)) @ matrix(ys, lo, min(lo + members, top)).T
                share = both / (size(x)[:, None] + size(y)[None] - both)
                hit = (both > 0) & (share >= least)
                if p == q and i == j:
                    hit &= np.arange(x.num_rows)[:, None] < np.arange(y.num_rows)[None]
                a, b = np.nonzero(hit)
                ends = [t["id"].combine_chunks().take(pa.array(k)) for t, k in ((x, a), (y, b))]
                batch = pa.RecordBatch.from_arrays([*ends, pa.array(share[a, b])], names=["a", "b", "jaccard"])
                yield batch

    # what two blocks find is at most the pairs of both
    def whole(key, table):
        return pa.Table.from_batches(run(key, table), pa.schema([("a", table["id"].type), ("b", table["id"].type), ("jaccard", pa.float64())]))

    return whole


def whole_groups_to_test(rows: DataFrame) -> DataFrame:
    """Rows (group, is_test, ...): a group with any test row is test as a whole."""
    return rows.withColumn("is_test", F.max("is_test").over(Window.partitionBy("group")))
