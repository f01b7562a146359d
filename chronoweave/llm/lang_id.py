"""Language identification by bit-sliced Bloom filters of byte n-grams.

Learning: every training text gives its 4-byte n-grams (lower case, anything but letters is one space); they are counted
per language over all training rows. A language contains an n-gram if the n-gram makes up at least ``MIN_SHARE`` of the
language's n-grams and at least ``MIN_RATIO`` of its largest share in any language. Every language of the training rows
is learned, however rare. So a language holds at most
1 / MIN_SHARE n-grams, whatever the size of the corpus, and the model that is broadcast is bounded by
languages / MIN_SHARE rows.

The model is one table of m rows of language bitmasks: bit j of a row says whether language j's Bloom filter has that row
set. ANDing the rows of an n-gram's hashes gives all languages that contain it at once. A text's popcounts per language
are corrected for each filter's false-positive rate and the largest decides.

Defined cases: null text, or one without any letter: ``und``, score 0. A text with letters but no n-gram (one-letter
words), or that no filter knows: the most frequent learned language, score 0. Ties: the more frequent language, then text
order. Null lang: never learned from. No training rows: all ``und``. Very long texts are cut into pieces whose popcounts
add up. Repeated rows stay; other columns aren't read, and ``known`` passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.common import buffers, fold, lean, mix, place, runs, table

MIN_SHARE, MIN_RATIO = 1e-5, 0.2
HASHES = 3
#: Rows of the bit-sliced table for each n-gram of the largest language, rounded up to a power of two.
ROWS_PER_GRAM = 8
#: Bytes of text looked at together: a byte costs about 80 of arrays while it is.
RUN_BYTES = 1 << 18
#: The pipeline rejects a text whose best language knows a smaller part of its n-grams.
REJECT_BELOW = 0.2

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def text_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of a run of texts as integers, and each text's first one (n + 1)."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(column), pa.scalar(" "), pa.scalar(""))
    data, offsets = buffers(padded)
    b = _LETTER[data]
    if len(b) < 4:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    # no space inside; that also leaves out what spans two texts
    at = np.flatnonzero((b[1:-2] != 0x20) & (b[2:-1] != 0x20))
    w = b.astype(np.uint32)
    grams = w[at] << np.uint32(24) | w[at + 1] << np.uint32(16) | w[at + 2] << np.uint32(8) | w[at + 3]
    return grams, np.searchsorted(at, offsets)


def pieces(batch: pa.RecordBatch, text: int):
    """(first row, texts) of consecutive runs of rows."""
    column = pc.fill_null(batch.column(text), "")
    _, offsets = buffers(column)
    for a, b in runs(offsets, RUN_BYTES):
        yield a, column.slice(a, b - a)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over docs (lang, text); each task adds up its own counts first."""

    def run(batches):
        langs: dict[str, int] = {}
        keys, counts, waiting = [], [], 0

        def merged():
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            return k[first], np.add.reduceat(c, first)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, texts in pieces(batch, 1):
                grams, at = text_grams(texts)
                if not len(grams):
                    continue
                own = np.array([langs.setdefault(x, len(langs)) for x in names[a : a + len(texts)]], np.uint64)
                key = np.repeat(own, np.diff(at)) << np.uint64(32) | grams
                k, c = np.unique(key, return_counts=True)
                keys.append(k)
                counts.append(c)
                waiting += len(k)
                if waiting > 2_000_000:
                    k, c = merged()
                    keys, counts, waiting = [k], [c], 0
        if keys:
            k, c = merged()
            named = np.array(list(langs), object)
            for a in range(0, len(k), 200_000):
                part = k[a : a + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(named[(part >> np.uint64(32)).astype(int)], pa.string()),
                        pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(c[a : a + 200_000].astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )

    counted = docs.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]  # the most frequent first
    masks: np.ndarray  # [rows, words]
    false_positive: np.ndarray  # [languages]

    @classmethod
    def build(cls, langs: list[str], rows: list[tuple[np.ndarray, int]]) -> Model:
        """rows: of each language its n-grams and its place in ``langs``."""
        most = max([len(g) for g, _ in rows], default=1)
        m = 1 << max(10, int(ROWS_PER_GRAM * max(1, most) - 1).bit_length())
        masks = np.zeros((m, -(-len(langs) // 64) or 1), np.uint64)
        rate = np.zeros(len(langs))
        for grams, j in rows:
            bit = np.zeros(m, bool)
            for at in places(grams, m):
                bit[at] = True
            masks[bit, j // 64] |= np.uint64(1 << (j % 64))
            rate[j] = (bit.sum() / m) ** HASHES
        return cls(langs, masks, rate)

    def popcounts(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[texts, languages]: of how many n-grams each language's filter says that it contains them."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        rows = places(grams, len(self.masks))
        for w in range(self.masks.shape[1]):
            found = self.masks[rows[0], w]
            for r in rows[1:]:
                found &= self.masks[r, w]
            some = int(np.bitwise_or.reduce(found))
            for j in range(64 * w, min(len(self.langs), 64 * w + 64)):
                if not some >> (j - 64 * w) & 1:
                    continue
                sums = np.zeros(len(grams) + 1, np.int64)
                np.cumsum((found >> np.uint64(j - 64 * w)) & np.uint64(1), out=sums[1:])
                out[:, j] = sums[at[1:]] - sums[at[:-1]]
        return out

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language (-1: none) and score of each text."""
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        grams, at = text_grams(texts)
        n = np.diff(at)[:, None]
        own = np.maximum(0, (self.popcounts(grams, at) - n * self.false_positive) / (1 - self.false_positive))
        best = own.argmax(1)
        score = own[np.arange(len(own)), best] / np.maximum(1, n[:, 0])
        return np.where(lettered, best, -1), np.where(lettered, np.clip(score, 0, 1), 0.0)


def places(grams: np.ndarray, m: int) -> list[np.ndarray]:
    """Rows of each hash, by double hashing."""
    h = mix(grams.astype(np.uint64))
    step = h >> np.uint64(32) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(m - 1)).astype(np.int64) for k in range(HASHES)]


def learn(train: DataFrame) -> Model:
    """train: lang, text. What comes to the driver: a row a language, and at most 1 / MIN_SHARE n-grams a language."""
    train = train.select("lang", "text").where("lang is not null")
    rows = train.groupBy("lang").count().collect()
    langs = [name for _, name in sorted((-r["count"], r["lang"]) for r in rows)]
    if not langs:
        return Model.build([], [])
    held = gram_counts(train).persist()
    if held.isEmpty():
        held.unpersist()
        return Model.build([], [])
    sums = F.broadcast(held.groupBy("lang").agg(F.sum("n").alias("size")))
    share = held.join(sums, "lang").select("lang", "gram", (F.col("n") / F.col("size")).alias("share")).where(
        F.col("share") >= MIN_SHARE * MIN_RATIO
    )
    least = share.groupBy("gram").agg(F.max("share").alias("most"))
    chosen = share.join(least, "gram").where(
        (F.col("share") >= MIN_SHARE) & (F.col("share") >= MIN_RATIO * F.col("most"))
    )
    got = chosen.select("lang", "gram").toArrow()
    held.unpersist()
    lang = pc.index_in(got.column("lang"), value_set=pa.array(langs)).to_numpy()
    order = np.argsort(lang, kind="stable")
    grams = got.column("gram").to_numpy()[order].astype(np.uint32)
    ends = np.searchsorted(lang[order], np.arange(len(langs) + 1))
    return Model.build(langs, [(grams[ends[j] : ends[j + 1]], j) for j in range(len(langs))])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        named = np.array([*own.langs, "und"], object)
        for batch in batches:
            best, score = _decided(own, batch, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least ``reject_below``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = place(docs, "text")

    def run(batches):
        for batch in batches:
            best, score = _decided(shared.value, batch, at)
            yield batch.filter(pa.array((best >= 0) & (score >= reject_below)))

    return docs.mapInArrow(lean(run), T.StructType(docs.schema.fields))


def _decided(model: Model, batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    found = [model.decide(texts) for _, texts in pieces(batch, text)]
    if not found:
        return np.empty(0, int), np.empty(0)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def training(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select("lang", "text")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training(docs))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
