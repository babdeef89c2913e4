"""Exact order statistics without a single-task window.

Rows are cut once into ranges of (group, value, spread) and written bucketed by range. Windows then run inside a range without
another shuffle, a small table with one row per (range, group) gives each range its offset, and only values that a limit between
two ranges cuts apart, one per limit at most, are put together again. So all groups of a ranking, however many or uneven, go
through one pass, and a value that a third of all rows share is spread over ranges. Range limits steer balance only: results
do not depend on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.sources.store import materialize, materialize_by_key

# Buckets of `uniform_position`.
BUCKETS = 256


def _running_offset(totals: DataFrame, groups: list[str], bucket: str, n: str) -> DataFrame:
    """Rows in earlier buckets and rows in all buckets, per (group, bucket).

    The window sees at most one row per bucket, so it is short even when `groups` is empty.
    """
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    earlier = whole.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    kept = [c for c in totals.columns if c not in (*groups, bucket, n)]
    return totals.select(
        *groups, bucket, n, *kept,
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_offset"),
        F.sum(n).over(whole).alias("n_ranked"),
    )


def in_ranges(df: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """The rows cut into ranges of `order`, numbered by `_part` in ascending order and written bucketed by it.

    `parts` is the number of ranges; by default that of shuffle partitions. The frame is read twice, for the limits
    and for the rows.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return materialize_by_key(cut, "ranges", "_part", parts)


def average_ranks(
    df: DataFrame, value: str, groups: list[str] | None = None, spread_by: list[str] | None = None, parts: int | None = None,
) -> DataFrame:
    """Adds `avg_rank`, the average rank of `value` in its group, and `n_ranked`, the group's values; null values have no rank.

    `spread_by` deals the rows of one value over ranges.
    """
    groups = groups or []
    rows = in_ranges(
        df.withColumn("_known", F.col(value).isNotNull()), [*groups, "_known", value, *(spread_by or [])], parts)
    inside = W.partitionBy("_part", *groups, "_known")
    placed = rows.withColumns({
        "_ties": F.count(F.lit(1)).over(W.partitionBy("_part", *groups, "_known", value)),
        "_below": F.rank().over(inside.orderBy(value)) - 1})
    end = F.struct(F.col(value).alias("v"), F.col("_ties").alias("ties"))
    totals = placed.filter("_known").groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min(end).alias("_lo"), F.max(end).alias("_hi"))
    offsets = materialize(_running_offset(totals, groups, "_part", "_n"), "range-offsets")
    # The first and the last value of every (range, group): those found in several ranges are one value cut apart.
    low = F.struct(F.col("_lo.v").alias("v"), F.col("_offset").alias("below"), F.col("_lo.ties").alias("ties"))
    high = F.struct(F.col("_hi.v").alias("v"), (F.col("_offset") + F.col("_n") - F.col("_hi.ties")).alias("below"),
                    F.col("_hi.ties").alias("ties"))
    both = F.when(F.col("_lo.v") == F.col("_hi.v"), F.array(low)).otherwise(F.array(low, high))
    cut = offsets.select(*groups, F.explode(both).alias("e")).groupBy(*groups, F.col("e.v").alias(value)).agg(
        F.min("e.below").alias("_first"), F.sum("e.ties").alias("_all"), F.count(F.lit(1)).alias("_parts")
    ).filter("_parts > 1").drop("_parts")
    joined = placed.join(offsets.select("_part", *groups, "_offset", "n_ranked"), ["_part", *groups], "left").join(
        F.broadcast(cut), [*groups, value], "left")
    below = F.coalesce("_first", F.col("_offset") + F.col("_below"))
    rank = F.when(F.col("_known"), below + (F.coalesce("_all", "_ties") + 1) / 2)
    return joined.select(*df.columns, rank.alias("avg_rank"), "n_ranked")


def average_rank_share(
    df: DataFrame,
    value: str,
    name: str,
    groups: list[str] | None = None,
    spread_by: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Adds the average rank of `value` over the number of ranked rows; null values stay null."""
    ranked = average_ranks(df, value, groups, spread_by or ["card_no"], parts)
    return ranked.withColumn(name, F.col("avg_rank") / F.col("n_ranked")).drop("avg_rank", "n_ranked")


def first_rows(df: DataFrame, order: list[Column], fraction: float, parts: int | None = None) -> DataFrame:
    """The first floor(n * fraction) rows in an order that tells all rows apart."""
    rows = in_ranges(df, order, parts)
    offsets = _running_offset(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), [], "_part", "_n")
    numbered = rows.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    place, most = F.col("_offset") + F.col("_place"), F.floor(F.col("n_ranked") * F.lit(fraction))
    return numbered.join(F.broadcast(offsets), "_part").filter(place <= most).select(*df.columns)


def quantiles(df: DataFrame, value: str, fractions: list[float], parts: int | None = None) -> list[float]:
    """Exact quantiles of the known values, linear between neighbours; empty if there are none.

    Counts per distinct value are summed up range by range. Only the values beside the wanted places come to the driver,
    two per fraction at most.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    rows = in_ranges(counts, [value], parts)
    offsets = materialize(
        _running_offset(rows.groupBy("_part").agg(F.sum("_c").alias("_n")), [], "_part", "_n"), "range-offsets")
    found = offsets.select("n_ranked").first()
    if found is None:
        return []
    places = [(found["n_ranked"] - 1) * f for f in fractions]
    wanted = sorted({int(side(p)) for p in places for side in (math.floor, math.ceil)})
    upto = F.sum("_c").over(W.partitionBy("_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_offset")
    placed = rows.join(F.broadcast(offsets), "_part").withColumn("_upto", upto)
    inside = F.filter(F.lit(wanted), lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_c")))
    at = {p: float(r[value]) for r in placed.withColumn("_places", inside).filter(F.size("_places") > 0).select(
        value, "_places").collect() for p in r["_places"]}
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(at[low] if low == high else (high - p) * at[low] + (p - low) * at[high])
    return out


def uniform_position(
    df: DataFrame, groups: list[str], spread: str, span: int, tie: list[str], name: str
) -> DataFrame:
    """Exact row number (from 1) inside each group, ordered by `spread`, then `tie`.

    `spread` must be an integer spread evenly over 0 .. span-1, such as a hash: it then cuts every
    group, however large, into even buckets.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(spread) * BUCKETS / span).cast("int"))
    totals = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _running_offset(totals, groups, "_bucket", "_n").drop("n_ranked")
    inside = W.partitionBy(*groups, "_bucket").orderBy(spread, *tie)
    return (
        bucketed.withColumn("_in_bucket", F.row_number().over(inside))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_in_bucket"))
        .drop("_bucket", "_in_bucket", "_offset")
    )


def magnitude_bucket(value: Column) -> Column:
    """Order-preserving bucket of a non-negative number: 64 buckets per doubling.

    One bucket spans about 1 % of its values, so amounts in cents give it a bounded number of
    distinct values whatever the number of rows.
    """
    return F.floor(F.log2(value + 1) * 64).cast("int")


def nearest_quantile(
    df: DataFrame, keys: list[str], value: str, fraction: float, name: str
) -> DataFrame:
    """Per key, the sorted non-negative value at index round((n - 1) * fraction). Null keys group.

    Keys without any value are absent.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c")).withColumn("_bucket", magnitude_bucket(F.col(value)))
    buckets = hist.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_n"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    index = F.round((F.sum("_n").over(whole) - 1) * F.lit(fraction)).cast("long")
    wanted = (
        buckets.select(*keys, "_bucket", "_n", F.sum("_n").over(upto).alias("_upto"), index.alias("_index"))
        .filter((F.col("_index") < F.col("_upto")) & (F.col("_index") >= F.col("_upto") - F.col("_n")))
        .select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"),
            (F.col("_index") - F.col("_upto") + F.col("_n")).alias("_index"))
    )
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (
        hist.join(wanted, same)
        .withColumn("_upto", F.sum("_c").over(inside))
        .filter((F.col("_index") < F.col("_upto")) & (F.col("_index") >= F.col("_upto") - F.col("_c")))
        .select(*keys, F.col(value).alias(name))
    )
