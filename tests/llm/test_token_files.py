import zlib

import numpy as np
import pytest
from llm_cases import as_rows, both, empty

from cardflow.llm import token_files
from cardflow.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture
def many_partitions(spark):
    """Small tables in as many partitions as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def coded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_equal_library(spark, library):
    docs, pairs = both(spark)
    found = token_files.round_trip(docs, vocabulary_path()).collect()
    expected = sorted((repr(i), len(coded(library, t)), crc(coded(library, t))) for i, t in pairs)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    # In order of start, ids ascend (null first) and every document begins where the one before ends.
    found.sort(key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert keys == sorted(keys)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()


def test_segments_are_flat_files(spark, library, many_partitions):
    docs, pairs = both(spark)
    files = token_files.write(docs.filter("doc_id >= 1000"), vocabulary_path())
    rows = files.manifest.orderBy("segment").collect()
    assert len(rows) > 1 and files.dtype == "<u2"
    text = dict(pairs)
    document = iter(sorted(i for i in text if i is not None and i >= 1000))
    base = first = 0
    for row in rows:
        segment = token_files.Segment(files.folder, row["name"], files.dtype)
        assert (row["base"], row["first_doc"]) == (base, first)
        for n in range(row["n_docs"]):
            assert segment.document(n).tolist() == coded(library, text[next(document)])
        base += row["n_ids"]
        first += row["n_docs"]


def test_windows_and_forgetting_change_nothing(spark, library, monkeypatch):
    texts = [t or "" for _, t in both(spark)[1]] + ["", "don't stop " * 3000 + "Été.. ß×ǅ x<|endoftext|>y\tz"]
    monkeypatch.setattr(token_files, "WINDOW", 50)
    monkeypatch.setattr(token_files, "FLUSHED", 90)
    monkeypatch.setattr(token_files, "REMEMBERED", 60)
    monkeypatch.setattr(token_files, "REMEMBERED_WORDS", 200)
    own = token_files.Encoder(token_files.read_spec(vocabulary_path()))
    for at in range(0, len(texts), 7):
        parts = list(own.encode(texts[at : at + 7]))
        ids = np.concatenate([p[0] for p in parts])
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        ends = [int(b + e) for (_, ends), b in zip(parts, before[:-1], strict=True) for e in ends]
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 7]]
        assert ids.tolist() == [i for e in expected for i in e]
        assert ends == np.cumsum([len(e) for e in expected]).tolist()


def test_every_latin_letter_and_mark(library):
    own = token_files.Encoder(token_files.read_spec(vocabulary_path()))
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("", ""), ("a", "B."), ("É", "!"), ("", "?"), (".", ","))]
    for text in texts:
        assert np.concatenate([p[0] for p in own.encode([text])]).tolist() == coded(library, text)[:-1]


def test_other_vocabularies_are_encoded_whole(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs, pairs = both(spark)
    files = token_files.write(docs, path, end_id=70_000)
    assert files.dtype == "<u4"
    found = token_files.read(spark, files)
    expected = []
    for i, t in pairs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 70_000]
        expected.append((i, len(ids), crc(ids)))
    assert as_rows(found, "doc_id", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


def test_string_ids_and_a_hot_id(spark, library, many_partitions):
    docs = spark.createDataFrame([("b", "x y"), ("a", None), *(("k", f"text {i % 3}") for i in range(900))], "doc_id string, text string")
    files = token_files.write(docs.repartition(6), vocabulary_path())
    assert files.manifest.count() > 2
    found = sorted(token_files.read(spark, files, "string").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == ["a", "b", *["k"] * 900]
    assert found[0]["n_tokens"] == 1 and found[0]["ids_crc32"] == crc([token_files.END_ID])
    crcs = [r["ids_crc32"] for r in found[2:]]
    assert len({c for a, b in zip(crcs, crcs[1:]) for c in (a, b) if a != b}) == 3 and sum(a != b for a, b in zip(crcs, crcs[1:])) == 2


def test_empty_table(spark):
    assert token_files.round_trip(empty(spark), vocabulary_path()).count() == 0
