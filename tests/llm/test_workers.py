import gc
import os

import pyarrow as pa

from chronoweave.llm import bpe, lang_id
from tests.conftest import data_dir


def test_a_worker_keeps_one_operators_caches(spark, monkeypatch):
    # workers of an environment of their own; one task at a time, so there is one of them
    monkeypatch.setitem(spark.sparkContext.environment, "CHRONOWEAVE_WORKERS", "own")
    docs = spark.read.parquet(f"{data_dir()}/documents.parquet").coalesce(1)

    def codecs(batches):
        for _ in batches:
            pass
        alive = sum(isinstance(x, bpe.Codec) for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([alive])], names=["pid", "alive"])

    def now():
        return [tuple(r) for r in docs.select("doc_id").mapInArrow(codecs, "pid long, alive long").collect()]

    bpe.digests(docs, bpe.default_tokenizer()).collect()
    (pid, alive), = now()
    assert alive == 1
    lang_id.known(docs, lang_id.Model.build([], [])).collect()
    assert now() == [(pid, 0)]
