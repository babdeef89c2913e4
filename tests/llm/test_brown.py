import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import as_rows, both, empty

from cardflow.llm import brown


def tokens(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "END OF TEXT"]


def out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def test_base_equals_plain_counts(spark):
    docs, pairs = both(spark)
    counts = Counter(t for doc, text in pairs if not out(doc) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = {}
    for doc, text in pairs:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        expected.setdefault(doc, []).append((out(doc), len(own), sum(counts[t] > 0 for t in own), total, base))
    scores = {}
    for held in (brown.HELD, 40):
        found = brown.score_corpus(docs, clustered=30, classes=5, held=held).collect()
        scores[held] = sorted((repr(r["doc_id"]), r["score"]) for r in found)
        for row in found:
            assert any(row["held_out"] == e[0] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == e[1:4]
                       and math.isclose(row["base_score"], e[4], rel_tol=1e-9) for e in expected[row["doc_id"]])
    # Which words are held where does not change the model.
    for a, b in zip(*scores.values(), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    docs, pairs = both(spark)
    learned = brown.learn(docs, 30, 5)
    model = learned.model
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    counts = Counter(t for _, text in pairs for t in tokens(text))
    rest = int(model.own[-2])
    for c in range(len(model.emission)):
        words = [counts[w.decode()] for w, i in model.numbers.items() if model.own[i] == c]
        if c == rest:
            clustered = {w.decode() for w in model.numbers}
            words = [n for w, n in counts.items() if w not in clustered and w != "END OF TEXT"]
        if c != int(model.own[-1]):
            assert (model.emission[c, 0], model.emission[c, 1]) == (sum(words), len(words))


def test_every_counted_word_has_a_class_and_moves_are_counted_with_it(spark):
    docs, pairs = both(spark)
    counts = Counter(t for _, text in pairs for t in tokens(text))
    ends = counts.pop("END OF TEXT")
    for held in (brown.HELD, 40):
        words, model = brown.learn(docs, 30, 5, held)
        rows = words.table.collect()
        own = {r["word"]: r["class"] for r in rows}
        assert {r["word"]: r["n"] for r in rows} == counts and len(rows) == len(counts)
        assert set(own.values()) <= set(range(5)) and words.end == ends
        table = np.zeros((7, 7))
        for _, text in pairs:
            row = [6, *(own[t] for t in tokens(text)[:-1]), 6]
            np.add.at(table, (row[:-1], row[1:]), 1)
        assert table.sum() == words.tokens
        assert np.allclose(10**model.transition, brown.smoothed(table, 5), rtol=1e-12)


def test_rare_words_follow_their_own_contexts(spark):
    texts = [t for i in range(40) for t in (f"red apple one red a{i} one", f"blue berry two blue b{i} two")]
    ids = [i for i in range(1000) if not out(i)]
    asked = [i for i in range(1000) if out(i)][:2]
    rows = [*zip(ids, texts), (asked[0], "red a3 one"), (asked[1], "red b3 one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (brown.HELD, 7):
        found = {r["doc_id"]: r["score"] for r in brown.score_corpus(docs, clustered=6, classes=6, held=held).collect()}
        assert found[asked[0]] > found[asked[1]] + 1


def test_classes_and_seeds_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 2)
    monkeypatch.setattr(brown, "CLUSTERED", 2)
    sizes = []
    for n in (20, 2000):
        docs = spark.createDataFrame([(i, f"w{i} w{i * 7 % n}") for i in range(n)], "doc_id long, text string")
        sizes.append(len(brown.learn(docs).model.transition) - 2)
    assert 2 <= sizes[0] < sizes[1]


def likelihood(a, b, n, own):
    size = own.max() + 1
    table = np.zeros((size, size))
    np.add.at(table, (own[a], own[b]), n)
    return brown.xlogx(table).sum() - brown.xlogx(table.sum(axis=0)).sum() - brown.xlogx(table.sum(axis=1)).sum()


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(2)
    # Words of three kinds follow each other in a ring: 0 -> 1 -> 2 -> 0.
    kinds = rng.integers(0, 3, 30)
    at = [0]
    for _ in range(6000):
        at.append(rng.choice(np.flatnonzero(kinds == (kinds[at[-1]] + 1) % 3)))
    pairs, n = np.unique(np.array(at[:-1]) * 32 + np.array(at[1:]), return_counts=True)
    a, b = pairs // 32, pairs % 32
    start = np.concatenate([np.arange(30) % 3, [3, 4]])
    own = brown.exchange(a, b, n.astype(float), 30, 3, 50)
    best = likelihood(a, b, n, own)
    assert best > likelihood(a, b, n, start)
    for w in range(30):
        for c in range(3):
            moved = own.copy()
            moved[w] = c
            assert likelihood(a, b, n, moved) <= best + 1e-6


def test_better_than_single_words_on_held_out_text(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = brown.score_corpus(given).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert row["s"] > row["b"]


def test_empty_table_and_no_training_rows(spark):
    assert brown.score_corpus(empty(spark)).count() == 0
    only_held_out = next(i for i in range(100) if out(i))
    docs = spark.createDataFrame([(only_held_out, "a b"), (only_held_out, None)], "doc_id long, text string")
    found = as_rows(brown.score_corpus(docs), "n_tokens", "n_known", "train_tokens", "base_score")
    assert [r[:3] for r in found] == [(1, 0, 0), (3, 0, 0)] and all(abs(r[3]) < 1e-12 for r in found)


@pytest.mark.parametrize("full", [1, 6, 1000])
def test_chooser_is_a_plain_argmax(monkeypatch, full):
    monkeypatch.setattr(brown, "FULL", full)
    rng = np.random.default_rng(5)
    table = rng.integers(0, 50, (9, 9)).astype(float)
    chooser = brown.Chooser(table)
    moves, mass = np.rint(np.log10(brown.smoothed(table)) * brown.FINE), np.rint(np.log10(table.sum(axis=0) + 1) * brown.FINE)
    lists = []
    for _ in range(300):
        times = int(rng.choice([1, 1, 2, 7]))
        lists.append((Counter(rng.integers(0, 9, times).tolist()), Counter(rng.integers(0, 9, times).tolist())))
    keys = [np.array([*sorted(before), *(9 + c for c in sorted(after))]) for before, after in lists]
    n = [np.array([*(before[c] for c in sorted(before)), *(after[c] for c in sorted(after))]) for before, after in lists]
    starts = np.cumsum([0, *map(len, keys)])
    got_times, got = chooser.choose(starts, np.concatenate(keys), np.concatenate(n))
    for i, (before, after) in enumerate(lists):
        times = sum(before.values())
        gains = [sum(x * moves[b, c] for b, x in before.items()) + sum(x * moves[c, a] for a, x in after.items()) - times * mass[c]
                 for c in range(7)]
        assert got_times[i] == times and got[i] == gains.index(max(gains))


def test_score_equals_a_plain_evaluation(spark):
    docs, pairs = both(spark)
    counts = Counter(t for doc, text in pairs if not out(doc) for t in tokens(text))
    rows = docs.select("doc_id", "text")
    inside = ~brown.held_out(rows["doc_id"])
    for held in (brown.HELD, 40):
        words = brown.classify(rows.filter(inside), 30, 5, held)
        own = {r["word"]: r["class"] for r in words.table.collect()} | {"END OF TEXT": 6}
        table = np.zeros((7, 7))
        for doc, text in pairs:
            if not out(doc):
                row = [6, *(own[t] for t in tokens(text))]
                np.add.at(table, (row[:-1], row[1:]), 1)
        move = brown.smoothed(table, 5)
        mass, kinds = np.zeros(7), np.zeros(7)
        for w, n in counts.items():
            mass[own[w]] += n
            kinds[own[w]] += 1
        expected = []
        for doc, text in pairs:
            total, before = 0.0, 6
            for t in tokens(text):
                c = own.get(t, 5)
                share = 1 if t == "END OF TEXT" else (counts[t] + 0.5) / (mass[c] + 0.5 * kinds[c]) if t in own else 1
                total += math.log10(move[before, c]) + math.log10(share)
                before = c
            expected.append((repr(doc), total))
        found = sorted((repr(r["doc_id"]), r["score"]) for r in brown.score_corpus(docs, 30, 5, held).collect())
        for a, b in zip(found, sorted(expected), strict=True):
            assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9)


def test_texts_are_read_twice(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('a b ', id % 7, ' c', id) AS text")
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert brown.score_corpus(docs.mapInArrow(counting, docs.schema), 4, 2).count() == 500
    assert 500 <= read.value <= 2 * 500


def test_words_end_at_ascii_space_only():
    texts = [None, "", " ", "A b\x0bC\x0c\r\nd\te ", "\x00\x1c \x1fÄ\u00a0É\u2003x\x85 \u0130", "  x", "y"]
    words, bounds = brown.split(pa.array(texts))
    assert [words.slice(a, b - a).to_pylist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tokens(t)[:-1] for t in texts]
    sliced, bounds = brown.split(pa.array(texts).slice(3, 2))
    assert sliced.to_pylist() == tokens(texts[3])[:-1] + tokens(texts[4])[:-1] and bounds[0] == 0 and bounds[-1] == len(sliced)


@pytest.mark.parametrize("step", [1, 3, 100])
def test_stretches_join_up(monkeypatch, step):
    monkeypatch.setattr(brown, "STRETCH", step)
    lists = pa.array([[1, 9], [2, 3, 9], [4, 9], [9]], pa.list_(pa.int32())).slice(1)
    found = [np.concatenate(x).tolist() for x in zip(*brown.stretches(lists, 9), strict=True)]
    assert found == [[9, 2, 3, 9, 4, 9], [2, 3, 9, 4, 9, 9], [3, 9, 4, 9, 9, 9]]


def test_words_without_a_number_get_the_same_class(spark, monkeypatch):
    monkeypatch.setattr(brown, "SWEPT", 40)
    docs, _ = both(spark)
    found = {}
    for held in (brown.HELD, 40, 15):
        words = brown.classify(docs.select("doc_id", "text"), 30, 5, held)
        rows = sorted((r["doc_id"] is None, str(r["doc_id"]), r["score"]) for r in brown.score_corpus(docs, 30, 5, held).collect())
        found[held] = words.rare.count(), sorted(map(tuple, words.table.collect())), rows
    assert found[brown.HELD][0] == 0 < found[40][0]
    for held in (40, 15):
        assert found[held][1] == found[brown.HELD][1]
        assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(found[held][2], found[brown.HELD][2], strict=True))
