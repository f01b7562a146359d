"""Shared pieces of the training-data operators: folds, Arrow text buffers, word hashing, shared scratch space.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``; ``A-Z`` is the only case that is folded. Everything here
works on UTF-8 bytes of whole texts; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that the vectorised loops look at together; longer texts are taken whole.
CHUNK_BYTES = 2_000_000
#: Files, one short row each, up to which their list is broadcast.
MAX_FILES = 100_000
#: Upper case to lower case, ASCII only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)
SPACE_NP = np.zeros(256, bool)
SPACE_NP[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
#: What the operator that runs in this worker keeps between tasks, by name.
_held: dict[str, object] = {}


def lean(run, keeps: str | None = None):
    """``run``, a function of Arrow batches, for workers that live on from operator to operator.

    What another operator kept is dropped at the start, and what the task freed goes back to the system at its end, so
    that an executor pays for one operator at a time.
    """

    def task(batches):
        # functions of the module: a closure would be sent with a copy of the module's dictionaries
        _begun(keeps)
        try:
            yield from run(batches)
        finally:
            _ended()

    return task


def _begun(keeps: str | None) -> None:
    for name in [name for name in _held if name != keeps]:
        del _held[name]


def _ended() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(name: str, key: object, make):
    """What ``make`` gives, made once a worker for as long as tasks that keep ``name`` follow each other."""
    held = _held.setdefault(name, {})
    if key not in held:
        held[key] = make()
    return held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor and the driver share."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    base = base or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/chronoweave-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/chronoweave-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a table in the shared folder: survives lost executors, is compressed and read by column."""
    spark = df.sparkSession
    path = scratch(spark, what)
    # zstd works in pooled heap buffers; snappy's direct buffers add up over many small files
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no later plan reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/chronoweave-" in path:
                jvm = df.sparkSession.sparkContext._jvm
                hadoop = jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def place(df: DataFrame, name: str) -> int:
    """Position of a column: the one of that very name, else the one that only differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def _scanned(df: DataFrame) -> bool:
    """Whether df is one scan of Parquet files under deterministic projections and filters only."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1, ... and ``row``, a number that every scan gives the same row.

    Of Parquet files it is the file's place in name order and the row's place in the file, whatever splits the scan makes.
    Anything else is written to the shared folder with its numbers first, and read from there.
    """
    columns = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    if "_metadata" not in docs.columns and _scanned(docs):
        meta = plain.metadataColumn("_metadata")
        rows = plain.select(*columns, meta["file_path"].alias("file"), meta["row_index"].alias("at"))
        # one row a file; the files are few enough for the driver's own list of them
        files = rows.select("file").distinct()
        files = written(files.withColumn("no", F.row_number().over(Window.orderBy("file"))), "files")
        if files.count() <= MAX_FILES:
            row = F.shiftleft(F.coalesce(F.col("no").cast("long"), F.raise_error("a file changed").cast("long")), 36) + F.col("at")
            return rows.join(F.broadcast(files), "file", "left").select(*columns, row.alias("row"))
    return written(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column one after another, and the n + 1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Split texts into consecutive runs (first, last) of about ``most`` bytes; each has one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of consecutive texts, each text's first word (n + 1), and word starts.

    ``offsets`` are positions in ``data``. A word hash is a polynomial over per-byte random numbers modulo 2**64, so
    that all words of a run of texts are hashed by one cumulative sum.
    """
    low = LOWER_NP[data]
    solid = ~SPACE_NP[low]
    n = len(low)
    before = np.empty(n, bool)
    before[1:] = solid[:-1]
    edges = offsets[(offsets >= 0) & (offsets < n)]
    if n:
        before[0] = False
        before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[:-1] = solid[1:]
    if n:
        after[-1] = False
        after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[low] * _power("up", _BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts])
    return hashes, np.searchsorted(starts, offsets), starts


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-grams that start at each position; the last n - 1 positions have none."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, (seed + n) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size])
    return out
