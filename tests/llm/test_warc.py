import base64
import hashlib

import numpy as np
import pytest

from chronoweave.llm import warc
from chronoweave.llm.common import scratch
from tests.conftest import data_dir


def slow(rows, least=0):
    keeper = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= least:
            keeper[raw] = max(keeper.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        k = keeper.get(raw)
        revisit = k is not None and i != k and len(raw) >= least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/\r\nWARC-Type: evil", None), (4, "u", ""), (5, "é", "é日本🎉\r\n\r\n"),
    (6, "u", FAKE), (7, "u", "WARC/1.1\r\n" * 3), (8, "u", "tail WARC/1.1\r\n"), (9, "u", "\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "u", "alone"),
    (10, "u", "big " + FAKE * 40 + "z" * 5000), (10, "u", "another"), (-3, "u", "WARC/1.1\r"), (11, "u", "\nWARC/1.1\r\n"), (2, None, "<p>x</p>"),
]


@pytest.mark.parametrize(("least", "split"), [(0, "128m"), (0, "700b"), (9, "128m")])
def test_round_trip_with_magic_in_payloads(spark, least, split):
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").coalesce(2), path, least)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted((tuple(r) for r in warc.read(spark, path).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == slow(ROWS, least)


def test_files_are_records_one_after_another(spark):
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string").coalesce(1), path)
    text = spark.read.text(path, wholetext=True).first()[0]
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and text.endswith("\r\n\r\n") and "WARC-Refers-To: <urn:page:2>" in text


def test_pointer_jumping():
    offsets = np.array([0, 10, 20, 25, 40, 50])
    successors = np.array([10, 40, 25, 26, 60, 20])
    assert warc.reachable(offsets, successors).tolist() == [True, True, False, False, True, False]
    n = 5000
    assert warc.reachable(np.arange(n), np.arange(1, n + 1)).all()
    assert warc.reachable(np.empty(0, int), np.empty(0, int)).tolist() == []


def test_the_pages_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{data_dir()}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op9_warc(spark, data_dir()).collect()), key=repr) == slow(rows)


def test_empty_table(spark):
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
