import numpy as np
import pyarrow as pa

from chronoweave.llm import lang_id
from tests.conftest import data_dir

TRAIN = [
    ("en", "the quick brown fox jumps over the lazy dog and then the dog sleeps"),
    ("en", "there is nothing that the other thing could do with those words"),
    ("fr", "le renard brun saute par dessus le chien et la chienne dort toujours"),
    ("fr", "il ne faut jamais que les autres choses soient avec ces mots"),
    (None, "no language given"),
]
EDGES = [(1, None), (2, ""), (3, "1234 !! 99"), (4, "a"), (5, "the other words"), (6, "les autres choses"), (6, "les autres choses"), (None, "the dog")]


def model(spark):
    return lang_id.learn(spark.createDataFrame(TRAIN, "lang string, text string"))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(*r, "zz") for r in EDGES], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in lang_id.predict(docs, model(spark)).collect()]
    assert [g[:2] for g in got] == [
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "fr"), (6, "fr"), (None, "en"),
    ]
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == got[3][2] == 0
    kept = lang_id.known(docs, model(spark))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, None}


def test_filters_return_all_languages_with_a_gram(spark):
    m = model(spark)
    texts = pa.array([t for lang, t in TRAIN if lang])
    grams, at = lang_id.text_grams(texts)
    counts = m.popcounts(grams, at)
    for k, lang in enumerate(lang for lang, _ in TRAIN if lang):
        # shared grams may be left to one language; most of a text's own are in its filter
        assert counts[k, m.langs.index(lang)] >= 0.9 * (at[k + 1] - at[k])
        assert np.argmax(counts[k]) == m.langs.index(lang)


def test_grams_do_not_cross_texts():
    one, _ = lang_id.text_grams(pa.array(["abcd", "efgh"]))
    two = np.concatenate([lang_id.text_grams(pa.array([t]))[0] for t in ("abcd", "efgh")])
    assert one.tolist() == two.tolist()


def test_nothing_to_learn_from(spark):
    empty = lang_id.learn(spark.createDataFrame([], "lang string, text string"))
    got = lang_id.predict(spark.createDataFrame(EDGES, "doc_id long, text string"), empty).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert lang_id.predict(spark.createDataFrame([], "doc_id long, text string"), model(spark)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{data_dir('sf0.01')}/documents.parquet")
    got = lang_id.op1_lang_id(spark, data_dir("sf0.01")).where("held_out").join(docs, "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_rare_languages_are_learned(spark):
    rows = TRAIN[:2] * 1500 + [("fi", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan")]
    rows += [(f"x{k}", f"qz{k:03d} " + " ".join(chr(97 + k % 26) * 3 + chr(97 + j) * 2 for j in range(26))) for k in range(70)]
    m = lang_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(m.langs) == 72 and m.masks.shape[1] == 2
    docs = spark.createDataFrame([(1, "ihmiset syntyvät vapaina"), (2, "the other words")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in lang_id.predict(docs, m).collect()} == {1: "fi", 2: "en"}
    assert lang_id.known(docs, m).count() == 2
