import http.server
import io
import json
import lzma
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import audit
from chronoweave.operators.graph import QUAD
from chronoweave.operators.linkpred import recurrence_ranks
from chronoweave.operators.runtime import scratch
from chronoweave.sources import remote
from chronoweave.streaming.ranking import RankSweep

RECORDS = [f"{k}.0,2020-01-{1 + k % 28:02d} 00:00:00 UTC,title {k},body é {'x' * (k % 90)}\nmore {k}" for k in range(400)]
BODY = ("\n".join(RECORDS) + "\n").encode()


class Server(http.server.BaseHTTPRequestHandler):
    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(BODY)))
        self.end_headers()

    def do_GET(self):
        part, code = BODY, 200
        if "Range" in self.headers and self.path != "/whole":
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            part, code = BODY[int(first) : int(last) + 1], 206
        self.send_response(code)
        self.send_header("Content-Length", str(len(part) + (50 if self.path == "/cut" else 0)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("path", ["/ranges", "/whole"])
def test_ranged_records_are_whole_and_follow_the_seed(spark, url, path):
    one = remote.ranged_sample(spark, url + path, 60, seed=3, window=2000, per_task=7).collect()
    two = remote.ranged_sample(spark, url + path, 60, seed=3, window=2000, per_task=60).collect()
    assert sorted(one) == sorted(two) and len(one) > 30
    for r in one:
        assert r.record in RECORDS and BODY[r.byte_offset :].startswith(r.record.encode())


def test_lines_and_broken_streams(spark, url):
    got = remote.http_lines(spark, url + "/a", url + "/cut").collect()
    want = BODY.decode().splitlines()
    for path in ("/a", "/cut"):
        assert [r.line for r in sorted(got, key=lambda r: r.line_number) if r.url.endswith(path)] == want


def test_xz_and_numpy(spark, tmp_path):
    rows = [{"x": k} for k in range(30)]
    (tmp_path / "a.xz").write_bytes(lzma.compress(json.dumps(rows).encode()))
    (tmp_path / "b.xz").write_bytes(lzma.compress("\n".join(map(json.dumps, rows)).encode()))
    for name in "ab":
        assert sorted(r.x for r in remote.xz_json(spark, str(tmp_path / f"{name}.xz"), "x int").collect()) == list(range(30))
    held = io.BytesIO()
    np.save(held, np.arange(12, dtype=np.float16).reshape(4, 3))
    (tmp_path / "v.npy").write_bytes(held.getvalue())
    assert [list(r.embedding) for r in remote.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("row").collect()][3] == [9, 10, 11]


def test_streamed_ranks_equal_the_batch(spark):
    rng = np.random.default_rng(2)
    quads = sorted({tuple(map(int, q)) for q in zip(rng.integers(0, 5, 120), rng.integers(0, 2, 120), rng.integers(0, 5, 120), rng.integers(0, 8, 120))})
    schema = "subj string, rel string, obj string, time int"
    frame = spark.createDataFrame([(str(s), str(r), str(o), t) for s, r, o, t in quads], schema)
    path = scratch(spark, "weeks")
    for t in range(8):
        frame.where(F.col("time") == t).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = RankSweep(spark, 7, frame.schema).run(stream)
    columns = [*QUAD, "seen", "direction", "rank"]
    want = recurrence_ranks(frame, 0, 7)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_reports(spark):
    schema = "id int, h string, h_type string, r string, o string, o_type string, valid boolean"
    rows = spark.createDataFrame([(1, "a", "COMP", "Has", "b", "GPE", True), (2, "a", "X", "Has", "b", "GPE", False)], schema)
    assert audit.missing_types(rows).count() == 10
    stats = spark.createDataFrame([(1, 1, 1, False, 5), (2, 1, 0, False, 5), (3, 0, 0, True, 0)], "id int, n_parsed int, n_valid int, malformed boolean, raw_len int")
    row = audit.extraction_report(rows, stats).first()
    assert (row.articles, round(row.success, 4), round(row.mean_triplets, 4), row.type_density) == (3, 0.3333, 0.3333, 0.5)
