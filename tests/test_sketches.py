"""Sketches of batches against exact counts."""

from pyspark.sql import functions as F

from cardflow.operators import sketches


def counts(df, key):
    return {r[key]: r["n"] for r in df.collect()}


def test_merged_batches_equal_one_sketch_and_come_near_exact_counts(spark, tmp_path):
    rows = spark.range(120_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('k', id % 7) end AS k", "cast(id % 40000 as string) AS v", "id % 2 AS half")
    path = str(tmp_path / "sketches")
    for half in (0, 1, 1):
        sketches.store_batch(sketches.distinct_sketches(rows.filter(F.col("half") == half), "k", {"n": "v"}), path, f"b{half}")
    got = counts(sketches.estimates(sketches.stored(spark, path, "k"), "k"), "k")
    once = counts(sketches.estimates(sketches.distinct_sketches(rows, "k", {"n": "v"}), "k"), "k")
    exact = counts(rows.groupBy("k").agg(F.count_distinct("v").alias("n")), "k")
    assert got.keys() == exact.keys()
    for key, n in exact.items():
        assert abs(got[key] - n) <= n * sketches.BOUND and abs(got[key] - once[key]) <= n * sketches.BOUND


def test_null_is_one_value_and_small_counts_are_exact(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", None), ("c", "y"), ("c", "y")], "k string, v string")
    assert counts(sketches.estimates(sketches.distinct_sketches(rows, "k", {"n": "v"}), "k"), "k") == {"a": 2, "b": 1, "c": 1}
    none = sketches.distinct_sketches(rows.limit(0), "k", {"n": "v"})
    assert sketches.estimates(sketches.merged(none, "k"), "k").count() == 0
