"""Near-duplicates by SimHash and exact similarity of word shingles: the pipeline's rule, five words and 0.8.

Similarity is the weighted Jaccard of ``SHINGLE``-word shingles, each weighted by how often it occurs (sum of minima by
sum of maxima). The kth occurrence of a shingle counts as a token of its own, so it is the plain Jaccard of token sets.

1. Texts with the same tokens are folded: first within a scan task, then between tasks, so a group of exact copies costs
   a row a task at most, and one row of prefixes.
2. Of two texts with n and m tokens at 0.8 or more, in any total order of tokens, the first n - ceil(0.8 n) + 1 of the
   one and the first m - ceil(0.8 m) + 1 of the other share a token (prefix filter). All prefix tokens are shuffled once;
   those of one text only, most of them, go no further. Texts that share one are candidates unless their sizes, or what
   is left behind the shared token, rule the similarity out. This loses nothing.
3. SimHash fingerprints of the same five words go through the Gray-order index of op6. What it links, within ``radius``
   bits, are the first candidates. It can't find all texts at 0.8 or more, which differ in ten bits or so, and some that
   it links are less alike; so its pairs are verified like all others, and the prefix filter finds the rest.
4. Candidates whose counts of tokens by bin allow the similarity are verified by their tokens. The first round takes the
   index's pairs and, of the prefix filter's, neighbours by size only; the second takes all candidates that verified
   links don't connect yet, so a cluster of near copies doesn't cost all its pairs.

Rare shingles come first in the order: those that many texts of a task hold are counted, and up to ``HOT_ROWS`` of them
go to the end. The order decides the cost, never the result. Tokens of more than ``bucket_rows`` texts are cut into
slices that meet in pairs; ``frequent`` finds every token with 8 in a million of all prefix tokens before the shuffle.

Defined cases: a text with fewer than five words is one shingle; texts without words, or null, are equal. Very long texts
are one row of tokens each. Repeated rows: one stays. Null doc_id: comes first. Empty table: empty result. Other columns
pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import simhash
from chronoweave.llm.common import buffers, dropped, grams, lean, mix, numbered, place, runs, words, written
from chronoweave.llm.simhash import components

#: Words of a shingle. The least similarity is 4/5, in whole numbers below.
SHINGLE = 5
#: Texts of a task that hold a shingle, from which it is counted; counted shingles that are kept.
HOT_TEXTS, HOT_ROWS = 8, 100_000
#: Tokens a bin, about; a text's bins are a power of two, and each counts up to 255.
BIN_TOKENS, LEAST_BINS, MOST_BINS = 4, 16, 1 << 14
#: Texts of one token that one group may hold; larger ones are cut into slices of this size.
BUCKET_ROWS = 20_000
#: Candidate rows up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Prefix tokens that are counted together, and their count among these from which a token may be frequent.
CHUNK_TOKENS, CHUNK_COUNT = 2_000_000, 16
_ROW = "row"
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of consecutive texts, sorted by text and hash, and the text of each."""
    hashes, first, _ = words(data, offsets)
    size = np.diff(first)
    g = grams(hashes, SHINGLE)
    text = np.searchsorted(first, np.arange(len(g)), "right") - 1
    inside = np.arange(len(g)) + SHINGLE <= first[text + 1]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    whole = [grams(hashes[first[t] : first[t + 1]], int(size[t])) for t in short]
    g, text = np.concatenate([g[inside], *whole]), np.concatenate([text[inside], short])
    order = np.lexsort((g, text))
    return g[order], text[order]


def tokens(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of consecutive texts in order, rare ones first, and each text's first one (n + 1).

    hot: sorted shingles; rank: the place of each in the order, from 1.
    """
    g, text = shingles(data, offsets)
    at = np.arange(len(g))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    again = at - np.maximum.accumulate(np.where(new, at, 0)) if len(g) else at
    token = mix(g + again.astype(np.uint64) * _AGAIN)
    late = np.zeros(len(g), np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        late = np.where(hot[place] == g, rank[place], 0)
    order = np.lexsort((token, late, text))
    return token[order], np.searchsorted(text, np.arange(len(offsets)))


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts of docs (text) hold, and the rank of each from rare to frequent."""

    def run(batches):
        held, waiting = [], 0

        def counted():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            own = n >= HOT_TEXTS
            return pa.RecordBatch.from_arrays([pa.array(g[own].view(np.int64)), pa.array(n[own])], names=["g", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in runs(offsets):
                g, text = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
                held.append(g[new])
                waiting += len(held[-1])
                if waiting > 2_000_000:
                    yield counted()
                    held, waiting = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "g").limit(HOT_ROWS).toArrow()
    g, n = got.column("g").to_numpy().view(np.uint64), got.column("n").to_numpy()
    rank = np.empty(len(g), np.int64)
    rank[np.lexsort((g, n))] = np.arange(1, len(g) + 1)
    order = np.argsort(g)
    return g[order], rank[order]


def signed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(rows: DataFrame, order) -> DataFrame:
    """row and doc_id of rows (row, doc_id, text), the first row of the task with the same tokens if it is another one,
    and else n, two hashes of all tokens, counts by bin, and the prefix."""

    def run(batches):
        hot, rank = order.value
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for a, b in runs(offsets):
                token, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hot, rank)
                n = np.diff(at)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(t, dtype=np.uint64))) for t in (token, mix(token))]
                one, two = (s[at[1:]] - s[at[:-1]] for s in sums)
                row = batch.column(0).slice(a, b - a)
                keys = zip(n.tolist(), one.tolist(), two.tolist())
                first = np.array([seen.setdefault(key, r) for key, r in zip(keys, row.to_pylist())], np.int64)
                again = first != row.to_numpy()
                most = np.where((n > 0) & ~again, n - (4 * n + 4) // 5 + 1, 0)
                inside = np.arange(len(token)) - np.repeat(at[:-1], n) < np.repeat(most, n)
                count = bin_count(n)
                base = np.concatenate(([0], np.cumsum(count)))
                bins = np.repeat(base[:-1], n) + (token & np.repeat(count - 1, n).astype(np.uint64)).astype(np.int64)
                bins = np.minimum(np.bincount(bins, minlength=base[-1]), 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        row,
                        batch.column(1).slice(a, b - a),
                        pa.array(first, mask=~again),
                        pa.array(n.astype(np.int64)),
                        *[pa.array(s.view(np.int64)) for s in (one, two)],
                        pa.array([None if x else bins[u:v] for x, u, v in zip(again, base, base[1:])], pa.binary()),
                        signed(token[inside], np.concatenate(([0], np.cumsum(most)))),
                    ],
                    names=[_ROW, "doc_id", "first", "n", "one", "two", "bins", "prefix"],
                )

    schema = f"{_ROW} long, doc_id long, first long, n long, one long, two long, bins binary, prefix array<long>"
    return rows.mapInArrow(lean(run), schema)


def frequent(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """token, slices: the prefix tokens that are known to occur in more than ``bucket_rows`` rows.

    Tokens are counted in chunks of ``CHUNK_TOKENS``, and counts of ``CHUNK_COUNT`` or more are added up. What is missed
    has fewer in each chunk, so 8 in a million of all tokens at most, which is less than a partition of the shuffle.
    """

    def run(batches):
        held, waiting = [], 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            own = n >= min(CHUNK_COUNT, bucket_rows)
            return pa.RecordBatch.from_arrays([pa.array(token[own]), pa.array(n[own])], names=["token", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            waiting += len(held[-1])
            if waiting > CHUNK_TOKENS:
                yield counted()
                held, waiting = [], 0
        if held:
            yield counted()

    found = rows.select("prefix").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") > bucket_rows).select("token", F.ceil(F.col("n") / bucket_rows).cast("int").alias("slices"))


_KEY = ["token", "pair"]
_GROUPED = f"token long, pair long, slice int, {_ROW} long, n long, pos int, root long"


def _grouped(rows: DataFrame, emit, schema: str) -> DataFrame:
    """emit(columns, bounds) for runs of whole groups (token, pair) of rows."""

    def run(batches):
        carry = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            if not len(t):
                continue
            cols = [t.column(c).to_numpy() for c in _KEY]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            carry = t.slice(last)
            if last:
                yield from emit(t.slice(0, last), np.concatenate(([0], new)))
        if carry is not None:
            yield from emit(carry, np.array([0, len(carry)]))

    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(lean(run), schema)


def _ordered(t: pa.Table, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of whole groups, each group by size and row, and where the group of each place ends."""
    size = np.diff(bounds)
    group = np.repeat(np.arange(len(size)), size)
    cols = {c: t.column(c).to_numpy() for c in t.column_names}
    order = np.lexsort((cols[_ROW], cols["n"], group))
    return {c: x[order] for c, x in cols.items()}, bounds[1:][group]


def _may(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of places (i the smaller text) may be similar, by sizes and what is left behind the token."""
    n, m = c["n"][i], c["n"][j]
    ok = (9 * np.minimum(n - c["pos"][i], m - c["pos"][j]) >= 4 * (n + m)) & (4 * m <= 5 * n)
    # slices meet other slices only where a pair of two is dealt
    return ok & (c[_ROW][i] != c[_ROW][j]) & (((c["pair"][i] >> 31) == (c["pair"][i] & 0x7FFFFFFF)) | (c["slice"][i] != c["slice"][j]))


def repeated(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """The prefix tokens that two or more rows (row, n, prefix) share: token, pair of slices, slice, row, n, pos; root is
    the neighbour by size in the group if it may be similar, else null."""
    large = written(frequent(rows, bucket_rows), "frequent")
    few = large.count() <= BROADCAST_ROWS
    keyed = rows.select(_ROW, "n", F.posexplode("prefix").alias("pos", "token"))
    keyed = keyed.join(F.broadcast(large) if few else large, "token", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = keyed.withColumn("slice", F.pmod(F.xxhash64(_ROW), F.col("slices")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    pair = F.shiftleft(F.least("slice", "other").cast("long"), 31) + F.greatest("slice", "other")
    dealt = other.select("token", pair.alias("pair"), "slice", _ROW, "n", "pos")

    def emit(t, bounds):
        single = np.diff(bounds) == 1
        keep = np.ones(len(t), bool)
        keep[bounds[:-1][single]] = False
        t, size = t.filter(pa.array(keep)), np.diff(bounds)[~single]
        if not len(t):
            return
        c, end = _ordered(t, np.concatenate(([0], np.cumsum(size))))
        i = np.arange(len(t) - 1)
        i = i[i + 1 < end[i]]
        near = i[_may(c, i, i + 1)]
        root = np.zeros(len(t), np.int64)
        root[near + 1] = c[_ROW][near]
        none = np.ones(len(t), bool)
        none[near + 1] = False
        cols = [pa.array(c[x]) for x in ("token", "pair", "slice", _ROW, "n", "pos")]
        yield from pa.table([*cols, pa.array(root, mask=none)], names=["token", "pair", "slice", _ROW, "n", "pos", "root"]).to_batches(100_000)

    return _grouped(dealt, emit, _GROUPED)


def candidates(groups: DataFrame) -> DataFrame:
    """src < dst: pairs of rows of a group (token, pair, slice, row, n, pos, root) that may be similar, of different roots."""

    def emit(t, bounds):
        c, end = _ordered(t, bounds)
        i = np.arange(len(t))
        for d in range(1, int(np.diff(bounds).max(initial=0))):
            i = i[i + d < end[i]]
            # sizes ascend, so a text too large for i is followed by larger ones only
            i = i[4 * c["n"][i + d] <= 5 * c["n"][i]]
            if not len(i):
                break
            ok = _may(c, i, i + d) & (c["root"][i] != c["root"][i + d])
            a, b = c[_ROW][i[ok]], c[_ROW][i[ok] + d]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    return _grouped(groups, emit, "src long, dst long").distinct()


def indexed(rows: DataFrame, lone: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """src < dst: pairs of those rows (row, doc_id, text) that lone (row) names, which connect exactly what op6's index
    links: the first row of each fingerprint with its others, and the first rows of fingerprints within ``radius`` bits."""
    prints = simhash.fingerprints(rows, SHINGLE).select(_ROW, "fp")
    prints = written(prints.join(lone.select(_ROW), _ROW, "left_semi"), "fingerprints")
    # a table of its own, so that the join below has a shuffle to itself and a large fingerprint can be split
    heads = written(prints.groupBy("fp").agg(F.min(_ROW).alias("head")), "heads")
    same = prints.join(heads, "fp").where(f"{_ROW} <> head").select(F.col("head").alias("src"), F.col(_ROW).alias("dst"))
    ends = [heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_row")) for end in ("src", "dst")]
    met = simhash.links(heads.select("fp"), radius).join(ends[0], "src").join(ends[1], "dst")
    near = met.select(F.least("src_row", "dst_row").alias("src"), F.greatest("src_row", "dst_row").alias("dst"))
    out = written(same.unionAll(near).distinct(), "indexed")
    dropped(prints, heads)
    return out


def bin_count(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / BIN_TOKENS)).astype(np.int64).clip(0, 62), LEAST_BINS, MOST_BINS)


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of rows whose counts by bin allow a similarity of 0.8: what they share is at most the sum of minima."""

    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            kind = bin_count(n) * (2 * MOST_BINS) + bin_count(m)
            for k in np.unique(kind):
                own = np.flatnonzero(kind == k)
                # the larger one's bins are added up to the smaller one's
                least = min(divmod(int(k), 2 * MOST_BINS))
                step = max(1, 20_000_000 // max(divmod(int(k), 2 * MOST_BINS)))
                for cut in range(0, len(own), step):
                    some = own[cut : cut + step]
                    a, b = (
                        np.frombuffer(b"".join(batch.column(c).take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1, least)
                        for c in ("a", "b")
                    )
                    both = np.minimum(a.sum(1, dtype=np.int64), b.sum(1, dtype=np.int64)).sum(1)
                    # a full bin may hold more than it says
                    full = (a == 255).any((1, 2)) | (b == 255).any((1, 2))
                    keep[some] = (9 * both >= 4 * (n[some] + m[some])) | full
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    src = rows.select(F.col(_ROW).alias("src"), "n", F.col("bins").alias("a"))
    dst = rows.select(F.col(_ROW).alias("dst"), F.col("n").alias("m"), F.col("bins").alias("b"))
    return pairs.join(src, "src").join(dst, "dst").mapInArrow(lean(run), "src long, dst long")


def verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs of rows of base (row, text) whose similarity is at least 0.8."""
    either = written(pairs.select(F.col("src").alias(_ROW)).unionAll(pairs.select(F.col("dst").alias(_ROW))).distinct(), "either")
    either = either.hint("broadcast" if either.count() <= BROADCAST_ROWS else "shuffle_hash")

    def held(batches):
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in runs(offsets):
                token, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *none)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), signed(token, at)], names=[_ROW, "all"])

    own = base.join(either, _ROW, "left_semi").mapInArrow(lean(held), f"{_ROW} long, all array<long>")
    own = written(own, "tokens")
    src = own.select(F.col(_ROW).alias("src"), F.col("all").alias("a"))
    dst = own.select(F.col(_ROW).alias("dst"), F.col("all").alias("b"))
    met = pairs.join(src, "src").join(dst, "dst")
    enough = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))
    out = written(met.where(enough).select("src", "dst"), "links")
    dropped(own, pairs)
    return out


def survivors(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, radius: int = simhash.RADIUS) -> DataFrame:
    """All columns of one row of each component of docs: the smallest doc_id (null first), then the first row."""
    base = numbered(docs)
    columns = base.columns[:-1]
    text = F.col(columns[place(docs, "text")]).alias("text")
    order = docs.sparkSession.sparkContext.broadcast(hot_shingles(base.select(text)))
    rows = base.select(_ROW, F.col(columns[place(docs, "doc_id")]).cast("long").alias("doc_id"), text)
    signs = written(signatures(rows, order), "signatures")
    # the rows that stand for what their task folded, and among these the ones that stand for all tasks
    firsts = signs.where("first is null")
    classes = firsts.groupBy("n", "one", "two").agg(F.min(_ROW).alias("least"), F.count(F.lit(1)).alias("tasks")).where("tasks > 1")
    extra = firsts.select(_ROW, "n", "one", "two").join(classes, ["n", "one", "two"]).where(f"{_ROW} <> least")
    extra = written(extra.select(_ROW, "least"), "folded")
    hint = "broadcast" if extra.count() <= BROADCAST_ROWS else "shuffle_hash"
    lone = firsts.where("n > 0").select(_ROW, "n", "bins", "prefix").join(extra.select(_ROW).hint(hint), _ROW, "left_anti")
    groups = written(repeated(lone, bucket_rows), "groups")
    bins = lone.select(_ROW, "n", "bins")
    near = groups.where("root is not null").select(F.least(_ROW, "root").alias("src"), F.greatest(_ROW, "root").alias("dst"))
    alike = indexed(rows, lone, radius)
    near = written(possible(near.unionAll(alike).distinct(), bins), "candidates")
    edges = verified(near, rows.select(_ROW, "text"))
    found = written(components(edges).withColumnRenamed("node", _ROW), "roots")
    joined = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rooted = groups.drop("root").join(joined, _ROW, "left").withColumn("root", F.coalesce("root", _ROW))
    near = written(possible(candidates(rooted), bins), "candidates")
    edges = edges.unionAll(verified(near, rows.select(_ROW, "text")))
    found = components(edges).withColumnRenamed("node", "least")
    heads = signs.groupBy(F.coalesce("first", _ROW).alias(_ROW)).agg(F.min(F.struct("doc_id", _ROW)).alias("head"))
    heads = heads.join(extra, _ROW, "left").select("head", F.coalesce("least", _ROW).alias("least"))
    heads = heads.groupBy("least").agg(F.min("head").alias("head"))
    member = heads.join(found, "least", "left").select(F.coalesce("root", "least").alias("root"), "head")
    kept = member.groupBy("root").agg(F.min("head").alias("head")).select(F.col(f"head.{_ROW}").alias(_ROW))
    kept = written(kept, "kept")
    dropped(signs, groups, edges)
    # texts are shuffled once and never sorted; the other side is row numbers
    return base.join(kept.hint("shuffle_hash"), _ROW, "left_semi").select(*columns).toDF(*docs.columns)
