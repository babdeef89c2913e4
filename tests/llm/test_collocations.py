import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import as_rows, empty, frame
from pyspark.sql import functions as F

from cardflow.llm import collocations as c

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counts_of(pairs, most):
    f, n = defaultdict(Counter), Counter()
    for text, lang in pairs:
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    return f, n


def plain(pairs, most=3, least=10, percent=50, top=2000):
    out = []
    f, n = counts_of(pairs, most)
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = [x for q, x in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * x >= percent * a for x in inside):
                score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "a", "red", "fox", "été", "ran", "on", "漢字", "x\x00y", "it's", "w z"]
    phrases = ["the quick red fox", "of the", "of the", "Of The", "in spite of", "New York City"]
    made = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! "]) for p in parts)
        made.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return made + [(None, "en"), ("", None), (" . ,;", "fr"), ("lone", "es")]


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_equals_plain_search(spark, ranges):
    pairs = texts(1)
    docs = spark.createDataFrame(pairs, "text string, lang string").repartition(4)
    found = c.collocations(docs, ranges=ranges)
    assert as_rows(found, *COLUMNS) == plain(pairs)


def test_other_sizes_limits_and_salted_lookups(spark):
    pairs = texts(2)
    docs = spark.createDataFrame(pairs, "text string, lang string").repartition(3)
    found = c.collocations(docs, most=4, least=3, percent=80, top=7, ranges=9, heavy_rows=2)
    assert as_rows(found, *COLUMNS) == plain(pairs, 4, 3, 80, 7)


def test_windows_of_long_texts(spark):
    pairs = texts(3, 60)
    long = " ".join(["of the red fox ran"] * 400) + " " + "z" * 300 + " of the"
    pairs += [(long, "en"), (long.replace(" ", "\n", 5), "de"), ("y" * 500, "en")]
    for data, most in ((b"a bb  ccc\nd e f g", 3), (b"aaaaaaaaaa b c d\n\ne", 2), (b"aaaa", 3)):
        for limit in range(1, 20):
            total = Counter()
            for window, ahead in c.cut(data, most, limit):
                own = c.suffixes(window, ahead, most)
                for column, n in zip(own.keys.T.tolist(), own.weights.tolist(), strict=True):
                    total[tuple(own.words[x - 1] if x else b"" for x in column)] += n
            own = c.suffixes(data, 0, most)
            assert total == {tuple(own.words[x - 1] if x else b"" for x in column): n for column, n in zip(own.keys.T.tolist(), own.weights.tolist(), strict=True)}
    docs = spark.createDataFrame(pairs, "text string, lang string").repartition(2)
    expected = plain(pairs)
    counted = c.phrase_counts(docs, ranges=5).filter("size > 0")
    f, _ = counts_of(pairs, 3)
    assert {(r["lang"], r["phrase"]): r["n"] for r in counted.collect()} == {
        (lang, " ".join(p)): n for lang, own in f.items() for p, n in own.items() if n >= 10}
    assert as_rows(c.collocations(docs), *COLUMNS) == expected


def test_sort_counts_every_prefix():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 50, 3000):
        keys = rng.integers(1, 6, (3, size)).astype(np.int32)
        keys[1:][:, rng.random(size) < 0.1] = 0
        weights = rng.integers(1, 4, size)
        expected = Counter()
        for column, n in zip(keys.T.tolist(), weights.tolist(), strict=True):
            for d in range(3):
                if column[d]:
                    expected[tuple(column[: d + 1])] += n
        for least in (1, 40):
            found = {}
            for depth, at, n in c.three_way(keys, weights, least, np.zeros(keys.shape, bool)):
                found |= {tuple(keys[: depth + 1, p].tolist()): x for p, x in zip(at, n.tolist(), strict=True)}
            assert found == {p: n for p, n in expected.items() if n >= least}


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10**15 - 1, 10**15 - 1)]
    rows += [(a, a + rng.randrange(10**9), a + rng.randrange(10**10)) for a in (rng.randrange(10, 10**14) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    found = df.select("a", "l", "r", c.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in found)


def test_hot_words_and_pairs_are_spread_over_ranges(spark):
    rng = random.Random(6)
    pairs = [(" ".join(f"of the w{rng.randrange(3000)}" for _ in range(200)), "en") for _ in range(60)]
    docs = spark.createDataFrame(pairs, "text string, lang string").repartition(4)
    splitters = c.splitters_of(docs, 3, 12)
    assert sum(a == b"of" and b == b"the" for a, b in zip(*splitters.columns[1:3], strict=True)) >= 2
    assert as_rows(c.collocations(docs, ranges=12), *COLUMNS) == plain(pairs)


def test_clashing_columns_odd_rows_and_empty_table(spark):
    docs = frame(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert as_rows(c.collocations(docs, least=3), *COLUMNS) == plain(rows, least=3)
    assert c.collocations(empty(spark)).count() == 0
