"""WARC archives: writing, and reading back with boundary-chain verification.

Writing: a record a page; of pages with equal payloads the one with the largest page_id is the response and the others
are revisits without a payload. Which digests repeat is found on (page_id, digest) alone; that table is broadcast only if
its counted rows stay below ``BROADCAST_ROWS``, and joined by a shuffle beyond. Spark's text writer puts the records, one
after another, into plain files (part-*.txt) in the shared folder.

Reading: tasks cut the files' splits at every occurrence of the magic, wherever it stands, and emit for each candidate
its length and the successor that its Content-Length gives. A file's candidates (some numbers each, never payloads) are
put in order; pointer jumping from the file's start then keeps what is reachable, in a number of rounds logarithmic in
the file's records. A magic inside a payload is on no chain from the start and goes. Payload digests are computed where
the candidate is cut; only records whose payload holds a magic are put together again from their parts. A part is known
by two hashes of its bytes, not by its place, so the second scan may split the files in another way.

Defined cases: null html: empty payload. Null url: no WARC-Target-URI; control characters of urls are percent-encoded
in the header. Rows with the same page_id and payload: each is as the page_id says, so several responses. Null page_id:
written as ``null`` and read as null; a revisit if an equal payload has a page_id. Very long payloads: one record each; a
record with a magic inside is put together in one task. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import scratch, table, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads with fewer bytes are always responses.
MIN_BYTES = 0
#: Rows of repeated digests, about 150 bytes each, that may be broadcast.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """40 hex digits in RFC 4648 base 32: each five hex digits are four characters."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes page_id, url, html as WARC files below ``path``."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    long_enough = F.octet_length("payload") >= min_bytes
    repeated = base.where(long_enough).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper"))
    repeated = written(repeated.where("n > 1 and keeper is not null").select("sha1", "keeper"), "digests")
    few = repeated.count() <= BROADCAST_ROWS
    known = base.join(F.broadcast(repeated) if few else repeated, "sha1", "left")
    revisit = F.coalesce(long_enough & (~F.col("page_id").eqNullSafe(F.col("keeper"))), F.lit(False))
    revisit = F.col("keeper").isNotNull() & revisit
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\0", "%00")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        urn("page_id"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("keeper"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(END),
        block,
    )
    known.select(record.alias("value")).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece between two magics: file, block, seq (both give a file's order), value."""
    raw = spark.read.text(path, lineSep=MAGIC)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _hashes(value: str) -> list[Column]:
    return [F.xxhash64(value).alias("one"), F.xxhash64(F.lit(1), value).alias("two")]


def parsed(pieces: DataFrame, value: str = "value") -> DataFrame:
    """Header fields, size, and the payload's length and digest if the block is all there."""
    head = F.substring_index(value, END, 1)
    http_at = F.length(F.col("head")) + 5
    body = F.expr(f"substring({value}, length(head) + 5)")
    out = pieces.withColumn("head", head).withColumn("body", body)
    out = out.withColumn("http", F.substring_index("body", END, 1))
    payload = F.expr("substring(body, length(http) + 5, length(body) - length(http) - 8)").cast("binary")
    return out.select(
        *[c for c in pieces.columns if c != value],
        F.octet_length(value).cast("long").alias("bytes"),
        (F.octet_length("head") + 4 + _field(F.col("head"), "Content-Length").try_cast("long") + 4).alias("needs"),
        _field(F.col("head"), "WARC-Type").alias("type"),
        F.regexp_extract("head", r"(?m)^WARC-Record-ID: <urn:page:(-?\d+|null)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract("head", r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("digest"),
        _field(F.col("http"), "Content-Length").try_cast("long").alias("http_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_sha1"),
        *_hashes(value),
    )


def reachable(offsets: np.ndarray, successors: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates a chain from ``start`` visits; ``next`` indices, len(offsets) is the end. Pointer jumping."""
    n = len(offsets)
    at = np.minimum(np.searchsorted(offsets, successors), n)
    hop = np.where((at < n) & (offsets[np.minimum(at, max(n - 1, 0))] == successors), at, n) if n else at
    hop = np.append(hop, n)
    seen = np.zeros(n + 1, bool)
    first = np.searchsorted(offsets, start)
    if first < n and offsets[first] == start:
        seen[first] = True
    while True:
        before = seen.sum()
        seen[hop[seen]] = True
        if seen.sum() == before:
            return seen[:n]
        hop = hop[hop]


_COLUMNS = "file string, page_id long, refers_to long, type string, digest string, http_bytes long"
_SCHEMA = f"{_COLUMNS}, payload_bytes long, payload_sha1 string, nth long, parts array<struct<one: long, two: long>>"
_PART = pa.struct([("one", pa.int64()), ("two", pa.int64())])


def _chain(key, group):
    """The reachable records of one file; ``parts`` has the pieces of those whose payload holds a magic."""
    order = np.lexsort((group.column("seq").to_numpy(), group.column("block").to_numpy()))
    group = group.take(pa.array(order))
    size = group.column("bytes").to_numpy()
    one, two = group.column("one").to_pylist(), group.column("two").to_pylist()
    magic = len(MAGIC)
    if size.sum() + magic * (len(size) - 1) != group.column("file_size")[0].as_py():
        raise RuntimeError(f"{key[0].as_py()}: the pieces don't make up the file")
    offsets = np.concatenate(([size[0]], size[0] + np.cumsum(size[1:-1] + magic))) if len(size) > 1 else np.empty(0, int)
    body = group.slice(1)
    needs = body.column("needs").to_numpy(zero_copy_only=False)
    needs = np.where(np.isnan(needs.astype(float)), -magic, needs.astype(float)).astype(np.int64)
    successors = offsets + magic + needs
    keep = np.flatnonzero(reachable(offsets, successors))
    ends = np.searchsorted(offsets, successors[keep])
    parts = [
        None if b == a + 1 else [{"one": one[k], "two": two[k]} for k in range(a + 1, b + 1)]
        for a, b in zip(keep.tolist(), ends.tolist())
    ]
    out = body.take(pa.array(keep))
    names = [c.split(" ")[0] for c in _COLUMNS.split(", ")] + ["payload_bytes", "payload_sha1"]
    rest = [pa.array(keep.astype(np.int64)), pa.array(parts, pa.list_(_PART))]
    return pa.table([*[out.column(c) for c in names], *rest], names=[*names, "nth", "parts"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the files below ``path``."""
    pieces = candidates(spark, path)
    found = written(parsed(pieces).groupBy("file").applyInArrow(_chain, _SCHEMA), "records")
    whole = found.where("parts is null")
    out = [whole]
    if found.where("parts is not null").limit(1).count():
        # the parts of a record are as many as its payload has magics; equal parts are one row of values
        spread = found.where("parts is not null").select("file", "nth", F.posexplode("parts").alias("at", "part"))
        spread = written(spread.select("file", "nth", "at", "part.one", "part.two"), "parts")
        needed = written(spread.select("one", "two").distinct(), "needed")
        values = pieces.select("value", *_hashes("value")).join(needed, ["one", "two"], "left_semi")
        values = written(values.groupBy("one", "two").agg(F.first("value").alias("value")), "values")
        joined = spread.join(values, ["one", "two"]).groupBy("file", "nth")
        parts = F.array_sort(F.collect_list(F.struct("at", "value")))
        text = joined.agg(F.array_join(F.transform(parts, lambda p: p["value"]), MAGIC).alias("value"))
        again = parsed(text).withColumn("parts", F.lit(None).cast(found.schema["parts"].dataType))
        out.append(again.select(*found.columns))
    records = out[0] if len(out) == 1 else out[0].unionAll(out[1])
    response = F.col("type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.col("payload_bytes")).otherwise(F.col("http_bytes")).alias("payload_bytes"),
        F.when(response, base32(F.col("payload_sha1"))).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias(
            "payload_digest"
        ),
        F.col("type").alias("record_type"),
        F.when(~response, F.col("refers_to")).alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
g AS (SELECT page_id, h, strlen(payload) AS n, keeper, unnest(generate_series(0, 31)) AS c FROM p JOIN k USING (h)),
b AS (SELECT page_id, h, n, keeper, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 1 + 5 * (c // 4), 5))::BIGINT >> (15 - 5 * (c % 4))) & 31), 1), '' ORDER BY c) AS digest
      FROM g GROUP BY page_id, h, n, keeper)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""
