"""Exact top-k inner-product search: a ball tree in each shard, branch and bound with a shared kth score.

Vectors are integers, floor(64 * x). Rows are dealt into shards of about ``SHARD_ROWS`` by a coarse ball tree of a
bounded sample, so that near rows share a shard; a leaf with too many rows, as of equal vectors, is cut by their ids. A
shard builds one ball tree. Queries visit a tree in groups: a node's inner products are at most q.c + |q| r for its
centre c and radius r, and each query goes down the child with the larger bound first and turns back where the bound is
below its kth score so far (equal scores may still win by their id).

The kth score is shared between shards by two passes: first every query searches its own shard; then it goes only to
those other shards whose ball may hold a score as good as the kth one found, in blocks of ``QUERY_BLOCK`` queries. The
queries are a stated set (ids divisible by ``QUERY_STEP``). A shard returns k rows a query at most, fewer the better the
bound. The sample decides how much is pruned, never what is found.

Scores are exact whatever the components: where products may not be exact doubles, doubles with an error bound choose
the rows that may be among the best and whole numbers decide. A score beyond a long is given as the nearest long, and
still ranked by its true value.

Defined cases: null vectors, or with null or non-finite components, and null ids: no part. Vectors shorter than the
longest one: missing components are zero. Rows with the same vec_id: none is another's candidate, each is a candidate of
others, and a repeated query is answered once, for its smallest vector. Ties: smaller vec_id, then each repeated row.
Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.llm.common import table, written

SCALE, K, QUERY_STEP = 64, 20, 20
SHARD_ROWS, QUERY_BLOCK, LEAF_ROWS = 16_384, 32_768, 512
#: Queries that go down a tree together.
TOGETHER = 2048
#: Rows of the sample that the shards are laid out by: for each shard, and in all.
SAMPLE_LEAF, SAMPLE_ROWS = 32, 100_000
#: Leaves, of a few bytes each, and bytes of the shards' balls that may be broadcast.
MOST_LEAVES, BALL_BYTES = 1_000_000, 64_000_000
MOST = (1 << 63) - 1


class BallTree:
    """Nodes in one array, children after their parent; leaves hold runs of the permuted rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._build(vectors, order, 0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]

    def _build(self, x: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        own = x[order[a:b]]
        centre = own.mean(0) if b > a else np.zeros(x.shape[1])
        far = ((own - centre) ** 2).sum(1)
        radius = float(np.sqrt(far.max(initial=0.0)))
        me = len(self.nodes)
        self.nodes.append((a, b, centre, radius, -1, -1))
        if b - a > LEAF_ROWS and radius > 0:
            # the two sides of the line through the farthest row and the row farthest from it
            one = own[far.argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            side = own @ (two - one)
            middle = a + (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, middle - a)]
            left, right = self._build(x, order, a, middle), self._build(x, order, middle, b)
            self.nodes[me] = (a, b, centre, radius, left, right)
        return me

    def search(self, qids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int):
        """Per query the best k (ids, scores), none of them its own id nor with a score below its bound."""
        n = len(qids)
        scores = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        least = bound.copy()
        norms = np.sqrt((queries**2).sum(1))
        slack = 1e-9 * (1 + norms)

        def upper(node: int, who: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _, _ = self.nodes[node]
            return queries[who] @ centre + norms[who] * radius * (1 + 1e-12) + slack[who] * (1 + radius)

        def leaf(a: int, b: int, who: np.ndarray) -> None:
            got = queries[who] @ self.vectors[a:b].T
            got[self.ids[a:b][None] == qids[who][:, None]] = -np.inf
            got[got < least[who][:, None]] = -np.inf
            some = np.flatnonzero((got > -np.inf).any(1))
            if not len(some):
                return
            who, got = who[some], got[some]
            all_scores = np.concatenate((scores[who], got), 1)
            all_ids = np.concatenate((ids[who], np.broadcast_to(self.ids[a:b], got.shape)), 1)
            if all_scores.shape[1] > 4 * k:
                # what is below the kth score can't stay; ties with it are kept and sorted by id
                kth = -np.partition(-all_scores, k - 1, 1)[:, k - 1]
                width = int((all_scores >= kth[:, None]).sum(1).max())
                if width <= all_scores.shape[1] // 2:
                    pick = np.argpartition(-all_scores, width - 1, 1)[:, :width]
                    all_scores = np.take_along_axis(all_scores, pick, 1)
                    all_ids = np.take_along_axis(all_ids, pick, 1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_scores, order, 1)
            ids[who] = np.take_along_axis(all_ids, order, 1)
            least[who] = np.maximum(least[who], scores[who, k - 1])

        def visit(node: int, who: np.ndarray) -> None:
            who = who[upper(node, who) >= least[who]]
            if not len(who):
                return
            a, b, _, _, left, right = self.nodes[node]
            if left < 0:
                for cut in range(0, len(who), 512):
                    for part in range(a, b, 4 * LEAF_ROWS):
                        leaf(part, min(b, part + 4 * LEAF_ROWS), who[cut : cut + 512])
                return
            first = upper(left, who) >= upper(right, who)
            visit(left, who[first])
            visit(right, who[~first])
            visit(right, who[first])
            visit(left, who[~first])

        if len(self.ids):
            visit(0, np.arange(n))
        return ids, scores


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part: floor(64 * x) / 64 of each component, a double without rounding."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # a double of 2**47 or more is a multiple of 1/64, and 64 times it may be no double
    cut = lambda x: F.when(F.abs(x) < 2.0**47, F.floor(x * SCALE) / SCALE).otherwise(x)
    return rows.where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: cut(x.cast("double"))).alias("v")
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, values = np.asarray(column.offsets), column.values.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = values[at[0] : at[-1]]
    return out


# -- exact scores of any size
def sortable(x: int) -> str:
    """A text that sorts as the integer does."""
    digits = str(abs(x))
    if x >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def integer(key: str) -> int:
    if key[0] == "1":
        return int(key[6:])
    return -int(key[6:].translate(str.maketrans("0123456789", "9876543210")))


def _integers(v: np.ndarray) -> list[int]:
    return [int(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in v.tolist()]


def normal(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query divided by a power of two, so that its largest component is about one; and the powers."""
    power = np.frexp(np.abs(q).max(1, initial=0.0))[1]
    return np.ldexp(q, -power[:, None]), power


def wide_search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, bounds: list[str | None], k: int, largest: float):
    """As BallTree.search for components whose products are no exact doubles: (query place, id, exact score) of the best
    k rows of each query. Doubles say which rows may be among them; whole numbers decide."""
    a, b = x * 2.0 ** -np.frexp(largest)[1], normal(q)[0]
    least = (x.shape[1] + 4) * 2.0**-51 * np.sqrt((b**2).sum(1)) * np.sqrt((a**2).sum(1).max(initial=0.0)) + 1e-300
    out, known = [], {}
    for cut in range(0, len(qids), 128):
        got = b[cut : cut + 128] @ a.T
        got[ids[None] == qids[cut : cut + 128, None]] = -np.inf
        for r, row in enumerate(got):
            at = cut + r
            kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            mine, bound = _integers(q[at]), bounds[at]
            found = []
            for j in np.flatnonzero((row >= kth - 2 * least[at]) & (row > -np.inf)).tolist():
                if j not in known:
                    known[j] = _integers(x[j])
                s = sum(map(int.__mul__, mine, known[j]))
                if bound is None or s >= integer(bound):
                    found.append((-s, int(ids[j])))
            out += [(at, i, -s) for s, i in sorted(found)[:k]]
    return out


# -- shards
class Dealer:
    """A coarse ball tree of a sample: each inner node's direction and threshold, by which rows go down to a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._build(sample, leaves)

    def _build(self, x: np.ndarray, leaves: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        far = ((x - x.mean(0)) ** 2).sum(1) if len(x) else np.zeros(0)
        if leaves < 2 or not far.max(initial=0.0) > 0:
            self.nodes[me] = (None, 0.0, self.leaves, -1)
            self.leaves += 1
            return me
        one = x[far.argmax()]
        two = x[((x - one) ** 2).sum(1).argmax()]
        side = x @ (two - one)
        # the widest gap near the middle, so that what lies together stays together
        order = np.sort(side)
        first, last = 3 * len(x) // 10, max(7 * len(x) // 10, 3 * len(x) // 10 + 1)
        at = first + int(np.diff(order[first : last + 1]).argmax()) if len(x) > 2 else 0
        middle = float((order[at] + order[at + 1]) / 2)
        low = side < middle
        some = min(max(1, round(leaves * float(low.mean()))), leaves - 1)
        left = self._build(x[low], some) if low.any() else self._build(x[:1], 1)
        right = self._build(x[~low], leaves - some) if not low.all() else self._build(x[:1], 1)
        self.nodes[me] = (two - one, middle, left, right)
        return me

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, who = todo.pop()
            direction, middle, left, right = self.nodes[node]
            if direction is None:
                out[who] = left
            elif len(who):
                low = x[who] @ direction < middle
                todo += [(left, who[low]), (right, who[~low])]
        return out


def dealt(vectors: DataFrame, n: int, dims: int, scale: float) -> DataFrame:
    """vec_id, v, shard: near rows share a shard. A leaf with too many rows, as of equal vectors, is cut by their ids."""
    leaves = -(-n // SHARD_ROWS)
    if leaves < 2:
        return vectors.withColumn("shard", F.lit(0).cast("long"))
    rows = min(SAMPLE_ROWS, max(SAMPLE_LEAF * leaves, 1000))
    # a sample by hash is fair and the same at every run; only how well shards are pruned depends on it
    some = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < max(1, int(2**30 * min(1.0, 2 * rows / n))))
    some = some.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(rows).toArrow()
    dealer = vectors.sparkSession.sparkContext.broadcast(Dealer(_matrix(some.column("v"), dims) * scale, leaves))

    def run(batches):
        for batch in batches:
            leaf = dealer.value.leaf(_matrix(batch.column(1), dims) * scale)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    placed = written(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, leaf int"), "dealt")
    large = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("slices"))
    # a row a leaf, SHARD_ROWS rows each on average
    slices = F.broadcast(large) if leaves <= MOST_LEAVES else large
    own = F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("long")
    return placed.join(slices, "leaf").select("vec_id", "v", (F.shiftleft(F.col("leaf").cast("long"), 31) + own).alias("shard"))


def top_k(rows: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding)."""
    vectors = written(prepared(rows), "vectors")
    spark = rows.sparkSession
    n, dims, largest = vectors.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    ).first()
    dims, largest = max(dims or 0, 1), largest or 0.0
    wide = largest >= 2.0**20 or (largest * SCALE) ** 2 * dims >= 2**52
    scale = 2.0 ** -np.frexp(largest)[1] if wide else float(SCALE)
    # a group holds a shard's rows and, of all queries, about QUERY_BLOCK
    blocks = -(-n // (step * QUERY_BLOCK)) or 1
    base = written(dealt(vectors, n, dims, scale), "shards")
    queries = base.where(F.col("vec_id") % step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min(F.struct("v", "shard")).alias("one")
    )
    queries = queries.select("query_id", "one.v", F.col("one.shard").alias("at"))
    names = ["query_id", "vec_id", "score", "key", "centre", "radius"]

    def search(left, right, ball):
        """left: vec_id, v of a shard; right: query_id, v, bound of queries. With ``ball``, a row of the shard's ball too."""
        own, x = left.column("vec_id").to_numpy(), _matrix(left.column("v"), dims)
        qid, q = right.column("query_id").to_numpy(), _matrix(right.column("v"), dims)
        bounds = right.column("bound").to_pylist()
        if wide:
            found = wide_search(own, x, qid, q, bounds, k, largest) if len(own) else []
            got = [qid[[f[0] for f in found]], [f[1] for f in found], [max(min(f[2], MOST), -MOST - 1) for f in found]]
            keys = [sortable(f[2]) for f in found]
        else:
            tree, bound = BallTree(own, x * SCALE), np.array([-np.inf if b is None else float(integer(b)) for b in bounds])
            got = [[], [], []]
            for a in range(0, len(qid), TOGETHER):
                i, s = tree.search(qid[a : a + TOGETHER], q[a : a + TOGETHER] * SCALE, bound[a : a + TOGETHER], k)
                who, place = np.nonzero(s > -np.inf)
                for c, values in zip(got, (qid[who + a], i[who, place], s[who, place].astype(np.int64))):
                    c.append(values)
            got = [np.concatenate(c) if c else np.empty(0, np.int64) for c in got]
            keys = [None] * len(got[0])
        cols = [pa.array(c, pa.int64()) for c in got] + [pa.array(keys, pa.string())]
        none = len(got[0])
        centre, radius = pa.nulls(none, pa.list_(pa.float64())), pa.nulls(none, pa.float64())
        out = pa.table([*cols, centre, radius], names=names)
        if ball and len(own):
            middle = (x * scale).mean(0)
            far = float(np.sqrt((((x * scale) - middle) ** 2).sum(1).max()))
            row = [[None], [left.column("shard")[0].as_py()], [None], [None], [middle.tolist()], [far]]
            out = pa.concat_tables([out, pa.table([pa.array(c, t) for c, t in zip(row, out.schema.types)], names=names)])
        return out

    schema = "query_id long, vec_id long, score long, key string, centre array<double>, radius double"
    right = queries.select("query_id", "v", F.col("at").alias("shard"), F.lit(None).cast("string").alias("bound"))
    own = base.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lambda a, b: search(a, b, True), schema)
    own = written(own, "own-shard")
    balls, found = own.where("query_id is null"), own.where("query_id is not null")
    shards = balls.count()
    if shards > 1:
        key = F.coalesce("key", F.when(F.col("score") >= 0, F.concat(F.lit("1"), F.lpad(F.length(F.col("score").cast("string")).cast("string"), 5, "0"), F.col("score").cast("string"))))
        # plain scores below zero bound nothing, which is no loss but of speed
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("bound"), F.min("score").alias("least"))
        kth = kth.where((F.col("n") >= k) & (F.lit(wide) | (F.col("least") >= 0))).select("query_id", "bound")
        asked = queries.join(kth, "query_id", "left").select("query_id", "v", "at", "bound")
        if shards * dims * 8 <= BALL_BYTES:
            others = _reached(asked, balls, dims, scale)
        else:
            # more shards than their balls may be broadcast: each query goes to all
            others = asked.join(balls.select(F.col("vec_id").alias("shard")), F.col("at") != F.col("shard")).drop("at")
        others = others.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        every = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rest = every.groupBy("shard", "block").cogroup(others.groupBy("shard", "block")).applyInArrow(lambda a, b: search(a, b, False), schema)
        found = found.unionAll(rest)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reached(asked: DataFrame, balls: DataFrame, dims: int, scale: float) -> DataFrame:
    """query_id, v, bound, shard: the other shards whose ball may hold a score of a query's bound."""
    held = balls.select("vec_id", "centre", "radius").orderBy("vec_id").toArrow()
    shard, radius = held.column(0).to_numpy(), held.column(2).to_numpy()
    centre = _matrix(held.column(1), dims)
    shared = asked.sparkSession.sparkContext.broadcast((shard, centre, radius, np.sqrt((centre**2).sum(1))))
    # scores are whole numbers of (64 x)(64 y); the balls are of y times scale, the queries of x by a power of two
    power = int(np.log2(scale / SCALE))

    def run(batches):
        ids, c, r, size = shared.value
        for batch in batches:
            for cut in range(0, batch.num_rows, 512):
                part = batch.slice(cut, 512)
                q, own = normal(_matrix(part.column(1), dims))
                norm = np.sqrt((q**2).sum(1))[:, None]
                upper = q @ c.T + norm * r[None] * (1 + 1e-9) + 1e-9 * norm * (size + r + 1e-290)[None]
                bounds = zip(part.column(3).to_pylist(), (power - own - 6).tolist())
                least = np.array([-np.inf if b is None else _scaled(integer(b), p) for b, p in bounds])
                who, at = np.nonzero((upper >= least[:, None]) & (part.column(2).to_numpy()[:, None] != ids[None]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x).take(pa.array(who)) for x in (0, 1, 3)], pa.array(ids[at])], names=["query_id", "v", "bound", "shard"]
                )

    return asked.mapInArrow(run, "query_id long, v array<double>, bound string, shard long")


def _scaled(x: int, power: int) -> float:
    """x times 2**power, rounded down a little."""
    whole = max(0, x.bit_length() - 1000)
    value = float(np.ldexp(float(x >> whole), whole + power))
    return value - 1e-9 * abs(value)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
