"""Shards of equal size by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, hash of the id, id), so equal texts stand together. A sample drawn with
chances in proportion to size gives quantile boundaries, which cut the order into many ranges. Texts that alone would
overfill a range get a range of their own, and what is still overfull is subdivided: by key, or by the hash of the
id where a range has a single key. Exact sizes of the ranges, summed up in order, give every record its place in
bytes and in rows, and a shard is a sixteenth of all bytes: shards differ by less than one record.

Nothing is sorted beyond a range, so a text that a third of all rows share is no hot spot. A null text has no bytes;
a null id is ordered like an empty one. Rows alike in all of this share their places in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.sources.store import materialize

SHARDS = 16
# Ranges the order is cut into, and sampled records per range. Splitters at the driver: at most 3 per range.
RANGES = 1024
SAMPLE = 64
LAW = "bytes"


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key, tie."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        hash60(text).alias("key"), hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("tie"))


def splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """Keys that begin a range: quantiles of a size-weighted sample, and heavy keys with their successors."""
    chance = F.col("size") * (ranges * sample / total)
    draw = F.pmod(F.xxhash64("key", "tie", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    quantiles = rows.filter(draw < chance).agg(
        F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    # At most `ranges` keys can have more than total / ranges bytes.
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > total / ranges).collect()
    return sorted({*(quantiles or []), *(k for r in heavy for k in (r["key"], r["key"] + 1))})


def place_in(bounds: list[int], key: Column) -> Column:
    """How many bounds are at most the key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = F.lit(bounds)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda low, step: F.when((low + step <= len(bounds)) & (F.get(array, low + step - 1) <= key), low + step).otherwise(low))


def parts(ranged: DataFrame, limit: float) -> DataFrame:
    """(range, pieces, lo, hi) of the overfull ranges: at most total / limit rows."""
    each = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return each.filter(F.col("bytes") > 1.5 * limit).select(
        "range", F.ceil(F.col("bytes") / limit).cast("int").alias("pieces"), "lo", "hi")


def shard_evenly(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    rows = materialize(sizes(docs), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    limit = total / ranges
    ranged = rows.withColumn("range", place_in(splitters(rows, total, ranges, sample), F.col("key")))
    overfull = materialize(parts(ranged, limit), "overfull")
    within = F.when(F.col("lo") == F.col("hi"), F.col("tie") / float(1 << 60)).otherwise(
        (F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1).cast("double"))
    cut = ranged.join(F.broadcast(overfull), "range", "left").withColumn(
        "piece", F.coalesce(F.least(F.floor(within * F.col("pieces")), F.col("pieces") - 1), F.lit(0)).cast("int"))
    cut = materialize(cut.drop("pieces", "lo", "hi"), "cut")
    # One row per range and piece: a few thousand, whatever the input.
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select(
        "range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range", "piece").orderBy("key", "tie", "doc_id")
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = cut.join(F.broadcast(materialize(offsets, "offsets")), ["range", "piece"]).select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(start * shards / F.lit(total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"))
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
