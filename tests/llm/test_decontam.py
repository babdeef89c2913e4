import hashlib
import re

import numpy as np
import pyarrow as pa
from llm_cases import PHRASE, as_rows, both, empty, frame

from cardflow.llm import decontam

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(pairs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 9)) if own else ():
            windows.setdefault(tuple(own[i : i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in pairs:
        own = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if (key := tuple(own[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = given + [(900, PHRASE), (901, PHRASE + " and more words that nobody else has used"), (902, "boats left"), (903, None),
                    (904, "..."), (905, "x" * 40_000), (906, "the quiet harbour while"), (907, PHRASE), (None, "dawn"), (908, "ab " * 9)]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_equals_all_windows(spark):
    docs, pairs = both(spark)
    items, rows = benchmark(spark)
    rows = [("" if i is None else i, t) for i, t in rows]
    items = items.selectExpr("coalesce(cast(item_id AS string), '') AS item_id", "text")
    for block_bytes in (decontam.BLOCK_BYTES, 4000):
        found = as_rows(decontam.find_leaks(docs, items, block_bytes), *COLUMNS)
        assert found == brute(pairs, rows)
    assert sum(r[-1] for r in found) > 3


def test_every_span_of_window_length_shares_a_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        span = [f"w{i}" for i in rng.integers(0, 1000, decontam.WINDOW)]
        prints = []
        for _ in range(2):
            around = [[f"v{i}" for i in rng.integers(0, 1000, rng.integers(0, 9))] for _ in range(2)]
            own = decontam.words_of(pa.array([" ".join(around[0] + span + around[1])]))
            prints.append(set(decontam.spans_hash(own.lanes[0], decontam.K)[decontam.winnow(own)].tolist()))
        assert prints[0] & prints[1]


def test_dropping(spark):
    docs = frame(spark)
    items, rows = benchmark(spark)
    clean = [r[0] for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()], rows) if not r[-1]]
    for block_bytes in (decontam.BLOCK_BYTES, 4000):
        kept = decontam.drop_leaks(docs, items, block_bytes)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    items, _ = benchmark(spark)
    docs, pairs = both(spark)
    assert decontam.find_leaks(empty(spark), items).count() == 0
    assert as_rows(decontam.find_leaks(docs, items.limit(0)), *COLUMNS) == brute(pairs, [])
