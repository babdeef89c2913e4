import hashlib
import random

import numpy as np
import pytest
from llm_cases import as_rows, both, empty

from cardflow.llm import bpe
from cardflow.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(bpe.read_spec(vocabulary_path()))


def test_table_equals_library(spark, library):
    docs, pairs = both(spark)
    expected = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = bpe.encode_corpus(docs, vocabulary_path())
    assert as_rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_tree_concatenation_equals_plain_merging(own, library):
    rng = random.Random(1)
    for letters in ("ab", "ant", "theinrs", "abcdefghijklmnopqrstuvwxyz", "éèa", "!?.#", "漢字", "🙂!"):
        for length in (1, 23, 24, 25, 60, 400, 3000):
            text = "".join(rng.choice(letters) for _ in range(length))
            symbols = own.symbols(text)
            assert own.encode_symbols(symbols) == library.encode(text, add_special_tokens=False).ids
            if length <= 400:
                assert own.encode_symbols(symbols) == own.merge(symbols)


def test_a_very_long_piece(own, library):
    text = "".join(random.Random(2).choice("etaoin") for _ in range(200_000))
    assert own.encode_symbols(own.symbols(text)) == library.encode(text, add_special_tokens=False).ids


def test_every_character_is_split_as_the_library_does(own, library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3000 or c % 37 == 0)]
    texts = [f"a{chr(c)}B{chr(c)}" for c in codes]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == coded.ids, hex(ord(text[1]))


def test_memory_stays_bounded(own, monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    text = " ".join(f"w{i}x" for i in range(500))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 50


def test_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert as_rows(bpe.decode(rows, vocabulary_path()), "doc_id", "decoded") == [(1, None), (2, "")]
    assert bpe.encode_corpus(empty(spark).drop("ids"), vocabulary_path()).count() == 0
