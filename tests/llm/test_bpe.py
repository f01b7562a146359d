import hashlib
import random

import pytest
from tokenizers import Tokenizer

from chronoweave.llm import bpe
from tests.conftest import data_dir

PIECES = ["<|endoftext|>", "'ll", "  ", "\n\n", "the", "ing", "tion", "٣٤", "Ⅷ", "½", " \x85", "\u200b", "日本", "🎉", "e\u0301"]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    return bpe.Codec(path), Tokenizer.from_file(path)


def test_random_texts_agree_with_the_library(both):
    codec, library = both
    rng = random.Random(7)
    letters = "abcdefghiTHE   \n\t'strevmlld0123456789.,!?éüß\x1c\x0b"
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_pair_of_tokens_is_judged_as_merging_does(both):
    codec, library = both
    rng = random.Random(1)
    ids = [i for i in codec.whole.values() if codec.bytes_of[i].isalpha()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        text = (codec.bytes_of[a] + codec.bytes_of[b]).decode()
        assert codec.pair_stays(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_long_pieces_and_full_cache(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    for text in ("ab" * 20_000, "x " * 500, " " * 1000):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_digests(spark, both):
    _, library = both
    docs = spark.read.parquet(f"{data_dir()}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(900, None), (901, ""), (None, "x"), (docs[0][0], docs[0][1])]
    got = sorted((tuple(r) for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_tokenizer()).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_ids_and_texts_round_trip(spark):
    rows = [(1, "Hello <|endoftext|> world"), (2, None)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_tokenizer()).collect()
    assert [(r.doc_id, r.decoded) for r in got] == [(1, rows[0][1]), (2, "")] and 50256 in got[0].ids and got[1].ids == []
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), bpe.default_tokenizer()).collect() == []
