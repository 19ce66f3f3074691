import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_same_as_library(make_docs, odd, empty, library):
    rng = random.Random(4)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, rng.choices(points, k=400))) for _ in range(4)]
    texts += ["don't we'll I'M  \n\n 12345 ½²", "<|endoftext|>a<|endoftext|", "ab" * 500, "".join(rng.choices("abcdefghij", k=3000)), "ᲉꟋ x"]
    df = make_docs(list(enumerate(texts))).unionByName(odd)
    rows = [r.text for r in df.select("text").collect()]
    for got, text in zip(bpe.encode(df, PATH).collect(), rows):
        ids, decoded = expected(library, text)
        assert list(got.ids) == ids and got.decoded == decoded and got.n_tokens == len(ids)
    for got, text in zip(bpe.encode_digests(df, PATH).collect(), rows):
        ids, decoded = expected(library, text)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(empty, PATH).count() == 0


def test_long_words_and_full_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    rng = random.Random(9)
    texts = ["".join(rng.choices("etaoin shrdlu", k=n)) for n in (3000, 200, 50, 5)] + ["z" * 10000]
    for _ in range(2):
        for text, row in zip(texts, encoder.encode(texts)):
            assert [int(x) for s, _, _ in row for x in s.split(",")] == expected(library, text)[0]
