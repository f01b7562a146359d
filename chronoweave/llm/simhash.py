"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: whole texts, A-Z lower-cased, words outside white space, ``shingle``-word shingles with repeats, XXH64
(seed 42) of the space-joined shingle; a bit is set if it is set in over half of the hashes. A text with fewer words is
one shingle; a text without words has fingerprint zero and links like any other.

Linking: equal fingerprints are folded into one row first, so a group of exact copies, however large, costs one row.
Fingerprints within ``radius`` bits agree under one of a few bit masks (``key_masks``), so each goes once to each masked
value.
Inside a partition the rows of a masked value are sorted by Gray rank and indexed by two levels of nodes that keep the
bits all members share (mask, pattern); a query descends only where the shared bits differ in at most ``radius`` places.
Only a spanning forest of what is found leaves a masked value, never all its pairs. Values with more than
``bucket_rows`` rows are cut into slices, each pair of slices a group of its own, so no task holds more than two slices.
Components come from large-star/small-star rounds, each cut by a table in the shared folder.

Defined cases: null or empty text: fingerprint zero. Null doc_id: carried, never a component's name unless alone with
other null ids (then component_id is null). Repeated rows stay repeated and share a component. Very long texts are hashed
whole, one at a time. Empty table: empty result. Other columns aren't read; ``survivors`` passes them through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import LOWER, buffers, lean, numbered, place, table, written

#: Contract of the query: words of a shingle, most differing bits.
SHINGLE, RADIUS = 4, 4
_ROW = "row"
#: Rows of one masked value that one group may hold; larger ones are cut into slices of this size.
BUCKET_ROWS = 20_000
#: Rows that share a masked value, on average, up to which masks need not be longer.
KEY_ROWS = 2048
#: Members of a leaf, and leaves of an upper node, of the Gray-order index.
LEAF, FAN = 16, 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 100_000):
        ones += np.unpackbits(raw[at : at + 100_000], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(raw), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of docs but for the last, text, with fp: the unsigned fingerprint in a signed long."""
    source = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    kept = source.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(len(kept)))
            whole = data.tobytes()
            fps = [fingerprint(whole[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=[*batch.schema.names[:-1], "fp"],
            )

    return source.mapInArrow(lean(run), T.StructType([*kept, T.StructField("fp", T.LongType())]))


def key_masks(rows: int, radius: int) -> list[int]:
    """Bit masks such that any two fingerprints within ``radius`` bits agree under one of them.

    64 bits are cut into n blocks, a mask for each choice of n - radius of them. n starts at radius + 1 and rises with
    the number of fingerprints, up to radius + 4, until a masked value has about ``KEY_ROWS`` rows on average: longer
    masks for more rows. What is linked doesn't depend on n.
    """
    n = radius + 1
    while n < radius + 4 and rows / 2 ** (64 * (n - radius) / n) > KEY_ROWS:
        n += 1
    cuts = [round(64 * k / n) for k in range(n + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(parts, n - radius)]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


def shared(fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that each run of ``size`` fingerprints shares, and their pattern."""
    at = np.arange(0, len(fp), size)
    both, some = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
    return ~(both ^ some), both


def find(parent: np.ndarray, x: int) -> int:
    root = x
    while parent[root] != root:
        root = int(parent[root])
    while parent[x] != root:
        parent[x], x = root, int(parent[x])
    return root


def forest(fp: np.ndarray, radius: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the pairs within ``radius`` among distinct fingerprints in Gray order.

    An upper node is pruned if its shared bits alone differ from the query in more than ``radius`` places, then a leaf
    likewise, where the bits shared by the leaf include those of its node; members of what is left are compared.
    ``side`` limits pairs to different sides.
    """
    n = len(fp)
    parent = np.arange(n)
    edges: list[tuple[int, int]] = []
    leaf_mask, leaf_bits = shared(fp, LEAF)
    node_mask, node_bits = shared(fp, LEAF * FAN)
    for at in range(0, n, 4096):
        q = fp[at : at + 4096]
        first_node = at // (LEAF * FAN)
        far = np.bitwise_count((q[:, None] ^ node_bits[None, first_node:]) & node_mask[None, first_node:]) > radius
        qi, node = np.nonzero(~far)
        node += first_node
        for cut in range(0, len(qi), 65_536):
            a, nodes = qi[cut : cut + 65_536], node[cut : cut + 65_536]
            leaves = nodes[:, None] * FAN + np.arange(FAN)[None]
            inside = leaves < len(leaf_bits)
            leaves = np.minimum(leaves, len(leaf_bits) - 1)
            near = np.bitwise_count((q[a][:, None] ^ leaf_bits[leaves]) & leaf_mask[leaves]) <= radius
            row, col = np.nonzero(near & inside)
            a2, leaf = a[row], leaves[row, col]
            for deep in range(0, len(a2), 65_536):
                b, members = a2[deep : deep + 65_536], leaf[deep : deep + 65_536][:, None] * LEAF + np.arange(LEAF)[None]
                ok = (members < n) & (members > (b + at)[:, None])
                members = np.minimum(members, n - 1)
                ok &= np.bitwise_count(q[b][:, None] ^ fp[members]) <= radius
                if side is not None:
                    ok &= side[b + at][:, None] != side[members]
                x, y = np.nonzero(ok)
                for i, j in zip((b[x] + at).tolist(), members[x, y].tolist()):
                    u, v = find(parent, i), find(parent, j)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        edges.append((i, j))
    return edges


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """src, dst: links between distinct fingerprints ``fp`` that connect exactly what is within ``radius`` of another."""
    masks = key_masks(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    keyed = fps.select("fp", F.posexplode(values).alias("block", "value"))
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > bucket_rows).withColumn("slices", F.ceil(F.col("n") / bucket_rows).cast("int"))
    # at most (rows * blocks / bucket_rows) values are large; only they are cut into pairs of slices
    keyed = keyed.join(large.select("block", "value", "slices"), ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int")
    pairs = (
        keyed.withColumn("slice", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .select(
            "fp",
            "block",
            "value",
            "slice",
            F.least("slice", "other").alias("lo"),
            F.greatest("slice", "other").alias("hi"),
        )
    )
    key = ["block", "value", "lo", "hi"]

    def run(batches):
        held, carry = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            cols = [t.column(c).to_numpy() for c in key]
            n = len(t)
            if not n:
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            carry = t.slice(last)
            held = t.slice(0, last)
            if last:
                yield from emit(held, new[:-1])
        if carry is not None:
            yield from emit(carry, np.empty(0, int))

    def emit(t, cuts):
        fp, sl = t.column("fp").to_numpy().view(np.uint64), t.column("slice").to_numpy()
        bounds = np.concatenate(([0], cuts, [len(fp)]))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((gray_rank(fp), group))
        fp, sl, size = fp[order], sl[order], np.diff(bounds)
        out: list[np.ndarray] = []
        small = size <= 4 * LEAF
        # small groups: all together, neighbours at distance d
        inner = np.repeat(small, size)
        pos = np.arange(len(fp)) - np.repeat(bounds[:-1], size)
        left = np.repeat(size, size) - pos - 1
        for d in range(1, int(size[small].max(initial=0))):
            i = np.flatnonzero(inner & (left >= d))
            near = np.bitwise_count(fp[i] ^ fp[i + d]) <= radius
            out.append(np.stack([fp[i[near]], fp[i[near] + d]], 1))
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        for g in np.flatnonzero(~small).tolist():
            a, b = int(bounds[g]), int(bounds[g + 1])
            part = fp[a:b]
            edges = forest(part, radius, sl[a:b] if lo[a] != hi[a] else None)
            if edges:
                e = np.array(edges)
                out.append(np.stack([part[e[:, 0]], part[e[:, 1]]], 1))
        if out:
            e = np.concatenate(out)
            e = np.unique(np.sort(e.view(np.int64), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["src", "dst"])

    dealt = pairs.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(lean(run), "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes that edges touch.

    Alternating large-star and small-star rounds; a round's table is written to the shared folder and the loop ends
    when a round changes nothing. Neighbours are never gathered: each star is a minimum and a join.
    """
    now = written(edges.select("src", "dst").where("src <> dst"), "edges")
    seen = None
    while True:
        both = now.select("src", "dst").unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        large = (
            both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        )
        large = large.where("src <> dst")
        low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(low2, "src")
        small = (
            joined.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .where("src <> dst")
            .unionAll(low2.select("src", F.col("m").alias("dst")))
            .distinct()
        )
        now = written(small, "stars")
        state = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
            F.sum(F.pmod(F.xxhash64("dst", "src"), F.lit(1 << 20))).alias("s"),
        ).first()
        if state == seen:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        seen = state


def roots(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fp, root for distinct fingerprints: equal roots are one component."""
    found = components(links(fps, radius, bucket_rows)).withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _named(classes: DataFrame, radius: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """fp, root of each class (fp, least), and root, least of each component. Both are tables, so that a join of them
    has its shuffle to itself and a component with very many fingerprints can be split."""
    member = written(classes.join(roots(classes.select("fp"), radius, bucket_rows), "fp"), "members")
    return member.select("fp", "root"), written(member.groupBy("root").agg(F.min("least").alias("least")), "names")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links, its own included) of every row of docs."""
    fps = written(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member, names = _named(classes, radius, bucket_rows)
    by_fp = written(member.join(names, "root").select("fp", F.col("least").alias("component_id")), "by-fingerprint")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of one row of each component of docs: the smallest doc_id (null first), then the first row."""
    base = numbered(docs)
    columns = base.columns[:-1]
    own = base.select(_ROW, F.col(columns[place(docs, "doc_id")]).alias("doc_id"), F.col(columns[place(docs, "text")]).alias("text"))
    fps = written(fingerprints(own, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(F.struct("doc_id", _ROW)).alias("least")), "classes")
    _, names = _named(classes, radius, bucket_rows)
    # texts are shuffled once and never sorted; the other side is row numbers
    kept = names.select(F.col(f"least.{_ROW}").alias(_ROW))
    return base.join(kept.hint("shuffle_hash"), _ROW, "left_semi").select(*columns).toDF(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
