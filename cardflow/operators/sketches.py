"""Approximate distinct counts that batches can add up: HyperLogLog sketches per key, stored and merged.

A sketch has a fixed size whatever it has seen, and merging sketches of batches gives the sketch of all their rows. So counts over years
need no second look at old rows, where exact counts need every (key, value) pair again. Null counts as one value, as in the
exact counts. Sketches of one `lg_k` merge; the relative standard error is about 1.04 / sqrt(2 ** lg_k), 1.6 % here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
# Five standard errors: what an estimate is allowed to be off.
BOUND = 5 * 1.04 / 2 ** (LG_K / 2)
_NULL = "\x00"


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def distinct_sketches(rows: DataFrame, key: str, columns: dict[str, str], lg_k: int = LG_K) -> DataFrame:
    """One row per key and a sketch of each column's values under its new name.

    Sketches are built before the shuffle, so a busy key moves one small row per task.
    """
    return rows.groupBy(key).agg(*(F.hll_sketch_agg(_value(c), lg_k).alias(name) for name, c in columns.items()))


def merged(sketches: DataFrame, key: str) -> DataFrame:
    """One row per key from any number of rows."""
    return sketches.groupBy(key).agg(*(F.hll_union_agg(c).alias(c) for c in sketches.columns if c not in (key, "batch")))


def estimates(sketches: DataFrame, key: str) -> DataFrame:
    return sketches.select(key, *(F.hll_sketch_estimate(c).alias(c) for c in sketches.columns if c != key))


def store_batch(sketches: DataFrame, path: str, batch: str) -> None:
    """Keeps one batch's sketches; the same batch again takes the place of what was there."""
    sketches.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The merged sketches of all stored batches."""
    return merged(spark.read.parquet(path), key)
