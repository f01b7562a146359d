from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from chronoweave.llm import bpe, decontam, lang_id, simhash
from tests.conftest import data_dir
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_against_brute_force(spark):
    sf = data_dir()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, state = docs.columns, docs
    one = corpus_pipeline.language(spark, state, sf)
    model = lang_id.learn(lang_id.training(docs))
    kept = {r.doc_id for r in lang_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= lang_id.REJECT_BELOW}
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    assert one.columns == columns and {r[0] for r in rows} == kept
    state = corpus_pipeline.written(one, "one")
    two = corpus_pipeline.repeated_lines(spark, state, sf)
    want = sorted(slow_lines(rows))
    assert two.columns == columns and sorted((r.doc_id, r.text) for r in two.collect()) == want
    state = corpus_pipeline.written(two, "two")
    three = corpus_pipeline.near_duplicates(spark, state, sf)
    prints = [(d, slow_fingerprint(t)) for d, t in want]
    left = sorted(set(slow_components(prints)))
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == left
    state = corpus_pipeline.written(three, "three")
    hit = {r.doc_id for r in decontam.matches(state, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    four = corpus_pipeline.decontaminated(spark, state, sf)
    texts = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and set(texts) == set(left) - hit
    final = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert {r.doc_id: r.n_tokens for r in final} == {d: len(library.encode(t).ids) for d, t in texts.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{data_dir()}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "the words", None, "s", 9)]
    odd = docs.unionAll(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        odd = corpus_pipeline.written(stage(spark, odd, data_dir()), name)
    assert odd.count() > 100
    for empty in (docs.limit(0),):
        for name, stage in corpus_pipeline.STAGES:
            empty = corpus_pipeline.written(stage(spark, empty, data_dir()), name)
        assert empty.count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert simhash.SHINGLE == 4 and simhash.RADIUS == 4
