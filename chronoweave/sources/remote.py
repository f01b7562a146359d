"""Sources read through Python: ranged samples of a remote record file, a line stream over HTTP, xz and NumPy files.

Each is a Python data source, so its partitions are Spark tasks and nothing passes through the driver but their plan.
"""

from __future__ import annotations

import io
import json
import lzma
import random
import re
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A record of a numbered news file starts a line with its number and a date.
RECORD = r"(?:^|\n)([0-9]+(?:\.[0-9]+)?,[0-9]{4}(?:-[0-9]{2}){2} [^\n]*)"


def fetch(url: str, first: int | None = None, last: int | None = None) -> bytes:
    """The bytes of a url, or of a range of it."""
    request = urllib.request.Request(url)
    if first is not None:
        request.add_header("Range", f"bytes={first}-{last}")
    with urllib.request.urlopen(request) as answer:
        body = answer.read()
        if first is not None and answer.status != 206:  # a server without ranges sends all
            body = body[first : last + 1]
    return body


def size_of(url: str) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as answer:
        return int(answer.headers["Content-Length"])


class RangedRecords(DataSource):
    """``ranged_records``: options url, n, seed, window, size. n random offsets; each gives the first whole record after
    it, cut at the next record's start: (byte_offset, record). Offsets follow the seed, whatever the partitions."""

    @classmethod
    def name(cls) -> str:
        return "ranged_records"

    def schema(self) -> str:
        return "byte_offset long, record string"

    def reader(self, schema):
        return _RangedReader(dict(self.options))


class _Offsets(InputPartition):
    def __init__(self, offsets: list[int]):
        self.offsets = offsets


class _RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.n = options["url"], int(options.get("n", 100))
        self.seed, self.window = int(options.get("seed", 42)), int(options.get("window", 65_536))
        self.per_task = int(options.get("per_task", 100))
        self.size = int(options["size"]) if "size" in options else size_of(self.url)

    def partitions(self):
        rng = random.Random(self.seed)
        offsets = [rng.randrange(max(1, self.size)) for _ in range(self.n)]
        return [_Offsets(offsets[k : k + self.per_task]) for k in range(0, self.n, self.per_task)]

    def read(self, partition):
        for offset in partition.offsets:
            last = min(self.size, offset + self.window) - 1
            text = fetch(self.url, offset, last).decode("utf-8", "replace")
            starts = [m.start(1) for m in re.finditer(RECORD, text)]
            if offset and starts and starts[0] == 0:
                starts = starts[1:]  # the window may begin inside a number
            if not starts:
                continue
            end = starts[1] if len(starts) > 1 else len(text) if last == self.size - 1 else None
            if end is not None:
                yield offset + len(text[: starts[0]].encode()), text[starts[0] : end].rstrip("\n")


class HttpLines(DataSource):
    """``http_lines``: options url (several by blanks). A task a url streams its lines: (url, line_number, line). A stream
    that breaks off keeps what was read."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "url string, line_number long, line string"

    def reader(self, schema):
        return _LinesReader(self.options["url"].split())


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _LinesReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self):
        return [_Url(u) for u in self.urls]

    def read(self, partition):
        with urllib.request.urlopen(partition.url) as answer:
            number = 0
            while True:
                try:
                    line = answer.readline()
                except OSError:
                    return
                if not line:
                    return
                yield partition.url, number, line.decode("utf-8", "replace").rstrip("\r\n")
                number += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangedRecords)
    spark.dataSource.register(HttpLines)


def ranged_sample(spark: SparkSession, url: str, n: int, seed: int = 42, **options) -> DataFrame:
    """Distinct records (byte_offset, record) at n random places of a file."""
    register(spark)
    reader = spark.read.format("ranged_records").option("url", url).option("n", n).option("seed", seed)
    return reader.options(**options).load().dropDuplicates(["byte_offset"])


def http_lines(spark: SparkSession, *urls: str) -> DataFrame:
    register(spark)
    return spark.read.format("http_lines").option("url", " ".join(urls)).load()


def xz_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of xz files that hold a JSON array or JSON lines; a file is unpacked by one task, line by line where it can."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with lzma.open(io.BytesIO(raw), "rt", encoding="utf-8", errors="replace") as text:
                    head = text.read(1)
                    while head and head.isspace():
                        head = text.read(1)
                    text.seek(0)
                    rows = [json.dumps(r) for r in json.load(text)] if head == "[" else None
                    for part in [rows] if rows is not None else _lines(text):
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def _lines(text, size: int = 10_000):
    held = []
    for line in text:
        if line.strip():
            held.append(line)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """row, embedding of NumPy matrix files, a task a file."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                matrix = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float32)
                for a in range(0, len(matrix), 4096):
                    part = matrix[a : a + 4096]
                    flat = pa.array(part.ravel())
                    at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(a, a + len(part))), pa.ListArray.from_arrays(at, flat)], names=["row", "embedding"]
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "row long, embedding array<float>")
