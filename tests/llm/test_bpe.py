import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import bpe
from palimpsest.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def fuzz(n, seed=1):
    pick = random.Random(seed)
    pool = [chr(c) for c in [*range(0, 600), *range(0x2000, 0x2070), 0x3000, 0x180E, 0xFEFF, 0x1F600, 0x4E2D, 0x661, 0x10FFFF]]
    return ["".join(pick.choice(pool) for _ in range(pick.randint(0, 50))) for _ in range(n)]


SPECIAL = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endof", "it's we'll I'M 's", "\n\n \t x", " " * 700 + "x", "aaaa" * 300, "=" * 3000, "ab" * 999]


def test_ids_and_text_equal_the_library(library):
    coder = bpe.Encoder(vocabulary_path())
    for text in [*SPECIAL, *fuzz(1500)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.ids(coder.words([text])[0]).tolist() == ids
        raw = coder.vocab.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0]
        assert raw.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_rounds_and_heap_agree(monkeypatch):
    pick = random.Random(2)
    words = ["".join(pick.choice("abcdeinrst") for _ in range(pick.randint(1, 120))).encode() for _ in range(300)]
    v = bpe.vocabulary(vocabulary_path())
    flat, sizes = v.encode_words(words)
    monkeypatch.setattr(bpe, "LONG", 0)
    again, more = v.encode_words(words)
    assert flat.tolist() == again.tolist() and sizes.tolist() == more.tolist()


def test_operators_round_trip(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = bpe.encode(docs, vocabulary_path())
    assert {r["doc_id"]: r["text"] for r in bpe.decode(ids, vocabulary_path()).collect()} == texts
    for r in bpe.round_trip(docs, vocabulary_path()).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 5)
    coder = bpe.Encoder(vocabulary_path())
    for text in ("one two three four", "five six seven eight nine ten", "one two"):
        assert coder.ids(coder.words([text])[0]).tolist() == library.encode(text).ids


def test_bad_ids_and_files(spark, tmp_path):
    with pytest.raises(ValueError):
        bpe.vocabulary(vocabulary_path()).decode_many(np.array([10**6]), np.array([1]))
    (tmp_path / "x.json").write_text('{"model": {"type": "WordPiece"}}')
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "x.json"))
