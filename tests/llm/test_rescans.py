"""Results don't depend on how the scans of one operator split the files."""

from contextlib import contextmanager

import pytest

from chronoweave.llm import line_dedup, lm_score, shingle_join, simhash, warc
from chronoweave.llm.common import scratch
from tests.conftest import data_dir


@contextmanager
def other_splits(spark, cores, most):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        yield
    finally:
        for name in ("leafNodeDefaultParallelism", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{name}")


def both(spark, make):
    """Rows of make() with one way to split at the call and another at the result, and with the same way at both."""
    with other_splits(spark, 2, "1m"):
        df = make()
        same = sorted(map(repr, make().collect()))
    with other_splits(spark, 6, "40k"):
        assert sorted(map(repr, df.collect())) == same and same


@pytest.fixture(scope="module")
def docs(spark):
    path = scratch(spark, "rescans")
    rows = spark.read.parquet(f"{data_dir('sf0.01')}/documents.parquet").where("doc_id < 400").repartition(3)
    rows.selectExpr("*", "doc_id + 7 as row", "1 as C0").write.option("parquet.block.size", 20_000).parquet(path)
    return lambda: spark.read.parquet(path)


@pytest.mark.parametrize("operator", [line_dedup.dedup, simhash.survivors, shingle_join.survivors, lm_score.score])
def test_operators(spark, docs, operator):
    both(spark, lambda: operator(docs()))


def test_what_is_no_scan_is_numbered_once(spark, docs):
    both(spark, lambda: line_dedup.dedup(docs().unionAll(docs()).where("doc_id < 100")))


def test_names_that_clash_pass_through(spark, docs):
    got = line_dedup.dedup(docs())
    assert got.columns == docs().columns
    assert got.where("row <> doc_id + 7 or C0 <> 1").count() == 0 and got.count() == docs().count()


def test_warc(spark):
    path = scratch(spark, "warc-test")
    fake = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, "u", f"<p>{k % 90}</p>{fake * (k % 4)}tail") for k in range(600)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    both(spark, lambda: warc.read(spark, path))
