import hashlib
import zlib

from llm_cases import as_rows, both, empty

from cardflow.llm import sharding


def brute(pairs, shards=16):
    h = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    rows = sorted((h((t or "").encode()), h(("" if i is None else str(i)).encode()), -1 if i is None else i, t or "") for i, t in pairs)
    total = sum(len(t.encode()) + 1 for *_, t in rows)
    out, at, slots = [], 0, {}
    for _, _, i, t in rows:
        size, shard = len(t.encode()) + 1, min(shards - 1, at * shards // total)
        out.append((None if i < 0 else i, size, zlib.crc32(t.encode()), "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def test_equals_one_sorted_list(spark):
    docs, pairs = both(spark)
    for ranges in (64, 1024):
        assert as_rows(sharding.shard_evenly(docs, ranges=ranges), *COLUMNS) == brute(pairs)


def test_a_text_in_a_third_of_all_rows(spark):
    pairs = [(i, "the same words in many rows" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(3000)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    found = as_rows(sharding.shard_evenly(docs, ranges=200), *COLUMNS)
    assert found == brute(pairs)
    sizes = [sum(r[1] for r in found if r[4] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in found)


def test_no_python_and_no_single_task_sort(spark):
    plan = sharding.shard_evenly(both(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan and "SinglePartition" not in plan


def test_empty_table(spark):
    assert sharding.shard_evenly(empty(spark)).count() == 0
