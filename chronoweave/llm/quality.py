"""Quality by compression: zstandard dictionaries of good and of bad text.

A bounded sample of labelled training rows gives one dictionary for each label. A text is cut into blocks, every block is
compressed with both dictionaries, and (bytes with the bad one - bytes with the good one) / (bytes of the text + 256) is turned
into a probability by a logistic curve fitted to further labelled rows and weighted to the labels' shares over all
labelled training rows.

The sample: per label, ``DICT_ROWS`` + ``FIT_ROWS`` ids, those with the smallest hash, a text of at most
``SAMPLE_BYTES`` bytes each and ``LABEL_BYTES`` together. Nothing else is bounded: whole texts of all rows are scored.

Defined cases: null or empty text: difference zero, scored by the curve. A doc_id with several labels: the mean decides
(half counts as good). Null labels: not learned from. One label only, or none: score 0.5. Repeated rows stay in the result;
of rows with the same doc_id one text is learned from, the one with the smallest hash. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import buffers, fold, table

DICT_ROWS, FIT_ROWS, SAMPLE_BYTES = 1500, 2000, 200_000
#: Bytes of sampled text of a label that go to the driver.
LABEL_BYTES = 64_000_000
DICT_BYTES, BLOCK, LEVEL = 112_640, 256, 3
#: Bytes added to a text's length in the normalisation, so that a few bytes decide little.
PRIOR_BYTES = 256
THRESHOLD = 0.7


def _sizes(dictionary: bytes | None):
    """A function from blocks to their compressed bytes."""
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO) if dictionary else None
    if loaded:
        loaded.precompute_compress(level=LEVEL)
    own = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_dict_id=False)
    return lambda blocks: sum([len(own.compress(b)) for b in blocks])


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def difference(self, text: bytes) -> float:
        if not text or not self.good:
            return 0.0
        if "_sizes" not in self.__dict__:
            self._sizes = _sizes(self.good), _sizes(self.bad)
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return (self._sizes[1](blocks) - self._sizes[0](blocks)) / (len(text) + PRIOR_BYTES)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.bias, -50, 50))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton steps, with a small ridge on the standardised slope."""
    mean, scale = np.average(x, weights=w), max(x.std(), 1e-9)
    design = np.stack([(x - mean) / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 0]) * w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(2), grad)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, quality; both already without held-out rows."""
    docs = docs.select("doc_id", "text")
    marked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).alias("good"))
    )
    found = marked.groupBy("good").count().collect()
    share = {r["good"]: r["count"] for r in found}
    if len(share) < 2:
        return Model(b"", b"")
    rows = DICT_ROWS + FIT_ROWS
    sized = docs.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    own = F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))
    # one text an id, so that an id that occurs very often is one row
    one = sized.select("doc_id", own.alias("own")).groupBy("doc_id").agg(F.min("own").alias("own"))
    known = one.join(marked, "doc_id").select("doc_id", "good", "own.h", "own.bytes")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = []
    for g in (True, False):
        total = 0
        for r in known.where(F.col("good") == g).orderBy(*order).limit(rows).collect():
            total += r["bytes"]
            if total <= LABEL_BYTES:
                picked.append((r["doc_id"], r["h"], g))
    # at most 2 * rows ids
    wanted = docs.sparkSession.createDataFrame(picked, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, h long, good boolean")
    sample = sized.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"])
    sample = sample.groupBy("doc_id", "h", "good").agg(F.first("text").alias("text"))
    got = sorted(sample.select("doc_id", "text", "good", F.xxhash64("doc_id").alias("o")).collect(), key=lambda r: (r["o"], r["doc_id"]))
    texts = {g: [r["text"].encode() for r in got if r["good"] == g] for g in (True, False)}
    # alternate rows, so that both uses have some of every size
    parts = {g: (t[::2][:DICT_ROWS], t[1::2]) for g, t in texts.items()}
    if not all(len(p[0]) and len(p[1]) for p in parts.values()):
        return Model(b"", b"")
    most = min(sum(map(len, p[0])) for p in parts.values())
    model = Model(_dictionary(parts[True][0], most), _dictionary(parts[False][0], most))
    x = np.array([model.difference(t) for g in (True, False) for t in parts[g][1]])
    y = np.array([float(g) for g in (True, False) for _ in parts[g][1]])
    total = sum(share.values())
    w = np.array([share[g] / total / len(parts[g][1]) for g in (True, False) for _ in parts[g][1]]) * len(x)
    model.slope, model.bias = _logistic(x, y, w)
    return model


def _dictionary(texts: list[bytes], most: int) -> bytes:
    """A dictionary of about ``most`` bytes of texts: both labels get as much."""
    blocks, total = [], 0
    for t in texts:
        blocks += [t[a : a + BLOCK] for a in range(0, len(t), BLOCK)]
        total += len(t)
        if total >= most:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[-DICT_BYTES:].ljust(8, b" ")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            whole = memoryview(data.tobytes())
            found = [own.score(bytes(whole[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = fold(F.col("doc_id"), 4) != 2
    model = learn(docs.where(seen).select("doc_id", "text"), labels.where(seen))
    return score(docs, model).select(
        "doc_id",
        (~seen).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
