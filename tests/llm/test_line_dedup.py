import hashlib

import numpy as np
from llm_cases import as_rows, both, empty, frame
from pyspark.sql import functions as F

from cardflow.llm import cuckoo, line_dedup

SPACE = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(pairs):
    holders = {}
    pairs = [(LAST if i is None else i, t or "") for i, t in pairs]
    for i, t in pairs:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in pairs:
        lines = t.split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((None if i == LAST else i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def result(docs, index):
    kept = line_dedup.dedup(docs, index)
    return as_rows(kept.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), *COLUMNS)


def test_equals_plain_counting(spark):
    docs, pairs = both(spark)
    assert as_rows(line_dedup.dedup_corpus(docs), *COLUMNS) == brute(pairs)
    # Filters too large to hold: the exact table alone decides.
    index = line_dedup.create(docs)
    assert {tuple(r) for r in line_dedup.suspects(docs, index).collect()} < {
        tuple(r) for r in line_dedup.suspects(docs, index, filter_bytes=-1).collect()}


def test_ids_of_other_types_and_rows_without_one(spark):
    """Text ids are ordered as text; rows without an id are one document, the last, with a list of lost lines per row."""
    docs, pairs = both(spark)
    named = docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text")
    want = brute([("~" if i is None else str(i), t) for i, t in pairs])
    got = line_dedup.dedup_corpus(named).na.fill("~", ["doc_id"])
    assert as_rows(got, *COLUMNS) == want
    index = line_dedup.create(named.limit(0))
    index = line_dedup.delete(line_dedup.insert(index, named), named.filter("doc_id = '0'").select("doc_id"))
    assert index.shared().count() > 0
    nameless = docs.selectExpr("CAST(NULL AS int) AS doc_id", "text")
    first = docs.filter("doc_id = 1001").selectExpr("CAST(1 AS int) AS doc_id", "text")
    rows = nameless.unionByName(first).persist()
    assert as_rows(line_dedup.dedup_corpus(rows), *COLUMNS) == brute([tuple(r) for r in rows.collect()])
    rows.unpersist()


def test_columns_of_the_same_names_give_way(spark):
    docs = frame(spark).withColumn("N_Lines", F.lit("x")).withColumn("mark", F.lit("x"))
    found = line_dedup.dedup(docs, line_dedup.create(docs))
    assert found.columns == [*[c for c in docs.columns if c != "N_Lines"], "n_lines", "n_dropped"]
    assert {r["mark"] for r in found.collect()} == {"x"} and dict(found.dtypes)["n_lines"] == "bigint"


def test_insert_and_delete_are_reversible(spark):
    docs, pairs = both(spark)
    docs = docs.persist()
    early, late = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0 OR doc_id IS NULL")
    index = line_dedup.insert(line_dedup.create(early), late)
    assert result(docs, index) == brute(pairs)
    gone = docs.filter("doc_id % 2 = 0")
    index = line_dedup.delete(index, gone.select("doc_id"))
    left = docs.filter("doc_id % 2 <> 0 OR doc_id IS NULL")
    assert result(left, index) == brute([p for p in pairs if p[0] is None or p[0] % 2])
    index = line_dedup.insert(index, gone)
    assert result(docs, index) == brute(pairs)
    docs.unpersist()


def test_filters_follow_the_exact_table(spark):
    docs, _ = both(spark)
    index = line_dedup.delete(line_dedup.insert(line_dedup.create(docs.limit(0)), docs), docs.filter("doc_id > 1100").select("doc_id"))
    entries = sum(np.count_nonzero(np.frombuffer(r["slots"], np.uint16)) for r in index.filters.collect())
    assert entries == index.shared().count() > 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    first, second = (rng.integers(0, 1 << 63, 50_000).astype(np.uint64) for _ in range(2))
    table = cuckoo.empty(len(first))
    assert cuckoo.insert(table, first, second)
    mask = len(table) - 1
    assert cuckoo.contains(table, first, second, mask).all()
    strange = cuckoo.contains(table, second, first, mask)
    assert strange.mean() < 0.001
    cuckoo.delete(table, first[:30_000], second[:30_000])
    assert cuckoo.contains(table, first[30_000:], second[30_000:], mask).all()
    assert cuckoo.contains(table, first[:30_000], second[:30_000], mask).mean() < 0.001
    small = cuckoo.empty(4)
    assert not cuckoo.insert(small, first[:1000], second[:1000])


def test_columns_and_empty_table(spark):
    docs = frame(spark)
    assert line_dedup.dedup(docs, line_dedup.create(docs)).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_corpus(empty(spark)).count() == 0
