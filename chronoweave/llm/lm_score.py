"""Language-model scores by deleted interpolation.

P(w | h) = l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1), where b is the bucket of the context's frequency,
floor(log2 c(h)) + 1, and 0 for an unseen context. Tokens: words (A-Z lower-cased) and one end a text; the end is also
the context of a text's first token. The weights of each bucket are learned by expectation-maximisation on held-out
counts: training rows with crc32(doc_id) mod 7 = ``DEV`` are deleted from the counts for that, and are counted again in
the model that scores.

How it runs. A scan task cuts its rows into chunks of about ``CHUNK`` bytes of text, which are written once, so that all
later passes see the same chunks whatever executors come and go. For each chunk a task sends every
distinct unigram and bigram (64-bit hash) once, with its count in the chunk, to the shard that owns the hash's range; so
a word that makes up a third of all tokens is one entry a chunk. A shard adds the counts up and answers every chunk in
the order of its own sorted hashes, a byte a count. The answers are written to the shared folder. Then each chunk
meets its answers, which hold all the counts that its texts need, and is scored. Shards and chunks grow in number with
the input, not in size; what is gathered grows with the corpus.

Histograms for the weights: one cell for each (bucket, level of c(h, w) / c(h), level of c(w) / N); levels are eighths
of a doubling, so the driver gets a bounded table whatever the corpus.

Defined cases: null text: empty, one token (its end). Null doc_id: fold of the empty text. Nothing to learn from: N = 0,
base_score 0 per token (V = 0), score from the uniform part. Without rows to hold out, weights are equal. Repeated rows
stay and count as often as they occur. A text longer than a chunk is a chunk of its own. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import buffers, fold, grams, runs, table, words, written

HELD_OUT, DEV, FOLDS = 2, 3, 7
#: Bytes of text in a chunk, and for each shard.
CHUNK, SHARD_BYTES = 12_000_000, 13_000_000
ROUNDS, LEVELS = 60, 8
BUCKETS = 48
END = np.uint64(0x9E6C63D0876A9A47)
ORDERS = (1, 2)


# -- chunks
def chunks(batches):
    """(chunk, texts) of a scan task's rows (doc_id, text, fold), in their order: group 1 has the rows held out for the
    weights, group 0 all others."""
    task, groups = TaskContext.get().partitionId(), (0, 1)
    held = {g: [] for g in groups}
    size, count = dict.fromkeys(groups, 0), dict.fromkeys(groups, 0)

    def out(g):
        chunk = pa.Table.from_batches(held[g]).combine_chunks()
        held[g], size[g] = [], 0
        count[g] += 1
        return task << 25 | count[g] << 1 | g, chunk

    for batch in batches:
        dev = pc.equal(batch.column(2), DEV)
        for g in groups:
            own = batch.filter(dev if g else pc.invert(dev))
            while own.num_rows:
                bytes_of = np.cumsum(pc.fill_null(pc.binary_length(own.column(1)), 0).to_numpy(zero_copy_only=False) + 8)
                take = int(np.searchsorted(bytes_of, CHUNK - size[g])) + 1
                part = own.slice(0, take)
                held[g].append(part)
                size[g] += int(bytes_of[min(take, len(bytes_of)) - 1])
                own = own.slice(take)
                if size[g] >= CHUNK:
                    yield out(g)
    for g in groups:
        if held[g]:
            yield out(g)


def packed(texts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(texts)
    return sink.getvalue().to_pybytes()


def unpacked(raw: pa.Array | pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in raw])


def stored(docs: DataFrame) -> DataFrame:
    """chunk, raw: a written table of all rows of docs (doc_id, text, fold); odd chunks are those of the DEV rows."""

    def run(batches):
        for chunk, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed(texts)])], names=["chunk", "raw"])

    return written(docs.mapInArrow(run, "chunk long, raw binary"), "chunks")


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts of a chunk, each text's first token (n + 1), and bigram hashes (context, token)."""
    data, offsets = buffers(texts)
    parts, sizes = [], []
    for a, b in runs(offsets):
        h, first, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(np.insert(h, first[1:], END))
        sizes.append(np.diff(first) + 1)
    own = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return own, first, grams(np.concatenate(([END], own)), 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the key, so that a chunk's sorted keys are those of its shards one after another."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


# -- counts
def small(counts: np.ndarray) -> bytes:
    """Counts as bytes; those over 254 follow as longs, in order."""
    large = counts > 254
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], np.int64)
    return counts


def answers(texts_of: DataFrame, shards: int) -> DataFrame:
    """Of stored chunks: chunk, n_order, shard, n, counts (all training rows), main (without DEV rows; only for DEV chunks), and of each
    shard once: types, total, main_types, main_total."""

    def send(batches):
        for chunk, raw in ((c, r) for b in batches for c, r in zip(b.column(0).to_pylist(), b.column(1))):
            texts = unpacked([raw])
            own, first, pairs = tokens(texts.column(1))
            trains = np.repeat(texts.column(2).to_numpy() != HELD_OUT, np.diff(first))
            for order, keys in zip(ORDERS, (own, pairs)):
                distinct, inverse = np.unique(keys, return_inverse=True)
                n = np.bincount(inverse, weights=trains, minlength=len(distinct)).astype(np.int64)
                at = cuts(distinct, shards)
                rows = [k for k in range(shards) if at[k + 1] > at[k]]
                for some in (rows[k : k + 16] for k in range(0, len(rows), 16)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk] * len(some), pa.int64()),
                            pa.array([order] * len(some), pa.int32()),
                            pa.array(some, pa.int32()),
                            pa.array([distinct[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()),
                            pa.array([small(n[at[k] : at[k + 1]]) for k in some], pa.binary()),
                        ],
                        names=["chunk", "n_order", "shard", "hashes", "counts"],
                    )

    def add(key, group):
        chunk = group.column("chunk").to_numpy()
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        counts = [unsmall(x.as_py(), len(h)) for x, h in zip(group.column("counts"), hashes)]
        every = np.concatenate(hashes)
        distinct, inverse = np.unique(every, return_inverse=True)
        amount = np.concatenate(counts)
        dev = np.repeat(chunk & 1, [len(h) for h in hashes]) == 1
        total = np.bincount(inverse, weights=amount, minlength=len(distinct)).astype(np.int64)
        main = total - np.bincount(inverse, weights=amount * dev, minlength=len(distinct)).astype(np.int64)
        at = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
        places = [inverse[a:b] for a, b in zip(at, at[1:])]
        once = lambda x: pa.array([int(x)] + [0] * (len(chunk) - 1), pa.int64())
        return pa.table(
            {
                "chunk": group.column("chunk"),
                "n_order": group.column("n_order"),
                "shard": group.column("shard"),
                "n": pa.array([len(h) for h in hashes], pa.int64()),
                "counts": pa.array([small(total[p]) for p in places], pa.binary()),
                "main": pa.array([small(main[p]) if c & 1 else None for p, c in zip(places, chunk)], pa.binary()),
                "types": once((total > 0).sum()),
                "total": once(total.sum()),
                "main_types": once((main > 0).sum()),
                "main_total": once(main.sum()),
            }
        )

    sent = texts_of.mapInArrow(send, "chunk long, n_order int, shard int, hashes binary, counts binary")
    return sent.groupBy("n_order", "shard").applyInArrow(
        add,
        "chunk long, n_order int, shard int, n long, counts binary, main binary, types long, total long,"
        " main_types long, main_total long",
    )


def gathered(answer: pa.Table, column: str, order: int, n: int) -> np.ndarray:
    """A chunk's counts of its n sorted distinct hashes of an order."""
    rows = [r for r in zip(*[answer.column(c).to_pylist() for c in ("n_order", "shard", "n", column)]) if r[0] == order]
    out = [unsmall(raw, size) for _, _, size, raw in sorted(rows, key=lambda r: r[1])]
    out = np.concatenate(out) if out else np.empty(0, np.int64)
    if len(out) != n:
        raise RuntimeError("a chunk's rows changed between two passes over the documents")
    return out


def token_counts(texts, answer: pa.Table, column: str):
    """Each token's count, its context's count and the pair's count, with each text's first token."""
    own, first, pairs = tokens(texts)
    distinct, inverse = np.unique(own, return_inverse=True)
    own_counts = gathered(answer, column, 1, len(distinct))
    single = own_counts[inverse]
    # the end is a token of every chunk
    end = own_counts[np.searchsorted(distinct, END)] if len(distinct) else 0
    context = np.concatenate(([end], single[:-1]))
    distinct, inverse = np.unique(pairs, return_inverse=True)
    return single, context, gathered(answer, column, 2, len(distinct))[inverse], first


# -- weights
def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def level(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """The ratio's logarithm in steps of 1/LEVELS of a doubling; -1 for zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log2(part / whole)
    return np.where(part > 0, np.rint(-np.nan_to_num(ratio, neginf=0.0) * LEVELS), -1).astype(np.int64)


def learn_weights(cells: np.ndarray, uniform: float) -> np.ndarray:
    """[BUCKETS, 3] weights of pair, single and uniform part. cells: bucket, pair level, single level, tokens."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if not len(cells):
        return weights
    b = cells[:, 0].astype(int)
    p = np.stack(
        [np.where(cells[:, k] >= 0, np.exp2(-cells[:, k] / LEVELS), 0) for k in (1, 2)] + [np.full(len(b), uniform)], 1
    )
    for _ in range(ROUNDS):
        part = weights[b] * p
        part *= (cells[:, 3] / np.maximum(part.sum(1), 1e-300))[:, None]
        # one token of each kind is added, so that a bucket without held-out tokens keeps usable weights
        sums = np.stack([np.bincount(b, part[:, k], BUCKETS) for k in range(3)], 1) + np.where(weights > 0, 1, 0)
        weights = sums / sums.sum(1, keepdims=True)
    return weights


# -- scores
def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    shards = shards or -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // SHARD_BYTES)
    source = docs.select(F.col("doc_id").cast("long"), "text", fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"))
    held = stored(source)
    found = written(answers(held, shards), "ngram-counts")
    sums = found.where("n_order = 1").agg(*[F.sum(c).alias(c) for c in ("types", "total", "main_types", "main_total")])
    types, total, main_types, main_total = [int(x or 0) for x in sums.first()]

    def held_out(chunk, answer):
        texts = unpacked(chunk.column("raw"))
        single, context, pair, _ = token_counts(texts.column(1), answer, "main")
        code = (bucket(context) * 4096 + level(pair, context) + 1) * 4096 + level(single, main_total) + 1
        code, n = np.unique(code, return_counts=True)
        return pa.table({"cell": code.astype(np.int64), "n": n.astype(np.int64)})

    dev = found.where("main is not null")
    odd = held.where("chunk % 2 = 1").groupBy("chunk")
    cells = odd.cogroup(dev.groupBy("chunk")).applyInArrow(held_out, "cell long, n long").groupBy("cell").agg(F.sum("n"))
    got = np.array(sorted(map(tuple, cells.collect())), np.int64).reshape(-1, 2)
    split = np.stack([got[:, 0] >> 24, ((got[:, 0] >> 12) & 4095) - 1, (got[:, 0] & 4095) - 1, got[:, 1]], 1)
    weights = learn_weights(split.astype(float), 1 / (main_types + 1))

    def final(chunk, answer):
        texts = unpacked(chunk.column("raw"))
        single, context, pair, first = token_counts(texts.column(1), answer, "counts")
        w = weights[bucket(context)]
        p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (single / max(total, 1)) + w[:, 2] / (types + 1)
        base = np.log10((single + 1) / (total + types + 1))
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        adds = lambda x: np.bincount(own, x, len(first) - 1)
        return pa.table(
            {
                "doc_id": texts.column(0),
                "held_out": pa.array(texts.column(2).to_numpy() == HELD_OUT),
                "n_tokens": pa.array(np.diff(first).astype(np.int64)),
                "n_known": pa.array(adds(single > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(first) - 1, total, np.int64)),
                "base_score": pa.array(adds(base)),
                "score": pa.array(adds(np.log10(p))),
            }
        )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return held.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(final, schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


