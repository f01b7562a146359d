"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A document is contaminated by an item if some window of as many words as the item has a weighted Jaccard similarity of at
least ``SIMILARITY`` with it (a text shorter than the item is one window): five-word shingles, each weighted by how often it occurs (sum of minima by sum of maxima).

1. Such a window has at least SIMILARITY of its shingles among the benchmark's, so windows with fewer are passed over
   (this loses nothing); the benchmark's shingles are one sorted array behind a bit table.
2. The other windows of each item size get a SimHash fingerprint. Fingerprints are looked up in four 16-bit blocks: of
   two within ``RADIUS`` = 19 bits, one block differs in at most 4, and every item is stored under all such values.
3. Pairs within the radius are verified by the exact similarity.

The index holds some 50 bytes a shingle of the benchmark: each block's values with their items, looked up under all 2,517
values within 4 bits. Up to ``GROUP_BYTES`` of items' text are one index and one scan of the documents, without a
shuffle; a larger benchmark is dealt into groups of that size, each a scan of its own whose finds are written, so what a
worker holds has a bound whatever the benchmark's size.

Defined cases: items with fewer than five words, or null, take no part; two items with the same text both count. Null
texts have no windows. Very long texts are searched whole. Repeated rows are judged one by one. Empty tables: no rows.
``clean`` passes other columns through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import buffers, grams, lean, place, runs, table, words, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS, BLOCK_RADIUS = 4, 4
#: Bytes of items' text that one index holds: 80,000 items of 400 bytes.
GROUP_BYTES = 32_000_000
_BITS = 20

_FLIPS = np.array(
    [sum(1 << b for b in some) for r in range(BLOCK_RADIUS + 1) for some in combinations(range(16), r)], np.uint16
)


def blocks(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(16 * b)).astype(np.uint16) for b in range(BLOCKS)]


def simhash(bits: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Fingerprints from how many of n shingle hashes have each bit."""
    return np.packbits(bits * 2 > n, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> float:
    """a: sorted distinct shingles and their counts; b: shingles."""
    shingle, count = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(a[0], shingle), len(a[0]) - 1)
    both = np.where(a[0][at] == shingle, np.minimum(a[1][at], count), 0).sum()
    return float(both / (a[1].sum() + count.sum() - both))


class Hamming:
    """Multi-index of the fingerprints of the items of one size: items by the value of each block."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.tables = []
        for value in blocks(fps):
            order = np.argsort(value, kind="stable")
            known, first = np.unique(value[order], return_index=True)
            self.tables.append((known, np.append(first, len(fps)), order))

    def within(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within RADIUS, each once."""
        found = [np.empty(0, np.int64)]
        for value, (known, first, order) in zip(blocks(q), self.tables):
            if len(known) > len(_FLIPS):
                # the query's neighbours are looked up among the values
                near = value[:, None] ^ _FLIPS[None]
                at = np.minimum(np.searchsorted(known, near), len(known) - 1)
                query, flip = np.nonzero(known[at] == near)
                at = at[query, flip]
            else:
                query, at = np.nonzero(np.bitwise_count(value[:, None] ^ known[None]) <= BLOCK_RADIUS)
            n = first[at + 1] - first[at]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
            found.append(np.repeat(query, n) * len(self.fps) + order[place])
        query, item = np.divmod(np.unique(np.concatenate(found)), len(self.fps))
        close = np.bitwise_count(q[query] ^ self.fps[item]) <= RADIUS
        return query[close], item[close]


class Benchmark:
    """Index of a group of items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_size: dict[int, tuple[list, Hamming]] = {}
        sizes: dict[int, list] = {}
        every = []
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, _, _ = words(raw, np.array([0, len(raw)]))
            if len(hashes) >= SHINGLE:
                g = grams(hashes, SHINGLE)
                every.append(g)
                sizes.setdefault(len(g), []).append((item, np.unique(g, return_counts=True), g))
        self.seeds = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.seeds & np.uint64((1 << _BITS) - 1)] = True
        for n, own in sizes.items():
            bits = np.stack([_ones(g).sum(0, dtype=np.int64) for _, _, g in own])
            self.by_size[n] = own, Hamming(simhash(bits, n))
        self.longest = max(sizes, default=0)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item_id, first word, words, similarity) of the best window of each text and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in runs(offsets):
            if len(self.seeds):
                self._run(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, best)
        return [(t, i, -at, n + SHINGLE - 1, s) for (t, i), (s, at, n) in sorted(best.items())]

    def _run(self, data: np.ndarray, offsets: np.ndarray, base: int, best: dict) -> None:
        hashes, first, _ = words(data, offsets)
        if len(hashes) < SHINGLE:
            return
        g = grams(hashes, SHINGLE)
        at = np.flatnonzero(self.table[g & np.uint64((1 << _BITS) - 1)])
        at = at[self.seeds[np.minimum(np.searchsorted(self.seeds, g[at]), len(self.seeds) - 1)] == g[at]]
        if not len(at):
            return
        flags = np.zeros(len(g) + 1, np.int64)
        flags[at + 1] = 1
        seen = np.cumsum(flags)
        # starts of windows with a seed, and all shingles of such windows
        mark = np.zeros(len(g) + 2 * self.longest + 2, np.int64)
        np.add.at(mark, np.maximum(at - self.longest + 1, 0), 1)
        np.add.at(mark, at + self.longest, -1)
        region = np.flatnonzero(np.cumsum(mark)[: len(g)] > 0)
        place = np.full(len(g), -1, np.int64)
        place[region] = np.arange(len(region))
        text = np.searchsorted(first, region, "right") - 1
        room = first[text + 1] - region - SHINGLE + 1  # shingles from here to the text's end
        size = np.diff(first) - SHINGLE + 1  # shingles of each text
        ones = None
        for n, (items, index) in self.by_size.items():
            fits = region[room >= n]
            # a text that is shorter than the item, but not by too much, is one window
            whole = np.flatnonzero((size < n) & (size >= SIMILARITY * n - 1e-9))
            length = np.concatenate((np.full(len(fits), n), size[whole]))
            fits = np.concatenate((fits, first[whole]))
            enough = (seen[fits + length] - seen[fits]) >= SIMILARITY * n - 1e-9
            fits, length = fits[enough], length[enough]
            if not len(fits):
                continue
            if ones is None:
                ones = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_ones(g[region]), 0, dtype=np.int32)))
            start = place[fits]
            for cut in range(0, len(fits), 2000):
                s, long = start[cut : cut + 2000], length[cut : cut + 2000]
                query, item = index.within(simhash(ones[s + long] - ones[s], long[:, None]))
                for q, i in zip((query + cut).tolist(), item.tolist()):
                    where, some = int(fits[q]), int(length[q])
                    own = int(np.searchsorted(first, where, "right")) - 1
                    similarity = weighted_jaccard(items[i][1], g[where : where + some])
                    if similarity >= SIMILARITY:
                        key = own + base, items[i][0]
                        best[key] = max(best.get(key, (0.0, 0, 0)), (similarity, -(where - int(first[own])), some))


def _ones(g: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(g).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def groups(items: DataFrame, size: int | None = None):
    """The benchmark's items in lists of about ``size`` bytes; only one list is on the driver at a time."""
    size, held, bytes_ = size or GROUP_BYTES, [], 0
    for row in items.where("text is not null").select("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        bytes_ += len(row[1])
        if bytes_ >= size:
            yield held
            held, bytes_ = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document row and item."""
    schema = "doc_id long, item_id long, first_word int, n_words int, similarity double"
    spark = docs.sparkSession
    source, out = docs.select(F.col("doc_id").cast("long"), "text"), []
    for group in groups(items):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            index = Benchmark(shared.value)
            for batch in batches:
                found = index.hits(*buffers(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                        *[
                            pa.array([f[k] for f in found], t)
                            for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.float64()))
                        ],
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"],
                )

        # the finds of a group are written before the next one is indexed
        out = [*out[:-1], *[written(x, "finds") for x in out[-1:]], source.mapInArrow(lean(run), schema)]
    return reduce(DataFrame.unionAll, out) if out else source.limit(0).selectExpr(
        "doc_id", "0L as item_id", "0 as first_word", "0 as n_words", "0D as similarity"
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark passage, all columns."""
    at = place(docs, "text")
    for nth, group in enumerate(groups(items)):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        docs = written(docs, "clean") if nth else docs

        def run(batches, shared=shared):
            index = Benchmark(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in index.hits(*buffers(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), T.StructType(docs.schema.fields))
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
