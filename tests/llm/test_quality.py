from chronoweave.llm import quality
from tests.conftest import data_dir


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir('sf0.1')}/labels.parquet").collect()}
    got = quality.op5_quality(spark, data_dir("sf0.1")).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len(got) == spark.read.parquet(f"{data_dir('sf0.1')}/documents.parquet").count()


def test_defined_cases(spark):
    good = [(k, f"plain words in a row number {k} " * 9) for k in range(60)]
    bad = [(100 + k, f"%%% ### $$$ {k} " * 20) for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (501, ""), (None, "plain words")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as good", "2 as h")
    labels = spark.createDataFrame(
        [(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(3, 1), (7, None), (None, 0)], "doc_id long, quality int"
    )
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(got[k] for k, _ in good) > max(got[k] for k, _ in bad)
    assert got[500] == got[501] and 0 <= got[None] <= 1


def test_one_label_only_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    one = quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r.score for r in quality.score(docs, one).collect()] == [0.5]
    assert quality.score(docs.limit(0), one).collect() == []
