"""Joins and key splits that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.sources.store import materialize

# A key is split once it holds more rows than this: about 400 MB of transactions.
HEAVY_ROWS = 2_000_000
# Number of heavy keys that are split. The list is broadcast, so its length is bounded; a key
# that is not among the heaviest 100,000 holds less than 1/100,000 of the rows and fits a task.
HEAVY_KEYS = 100_000
# Rows without a key match nothing and are dealt over this many salts.
KEYLESS_SALTS = 1 << 16


def heavy_keys(counts: DataFrame, keys: list[str], weight: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys above `heavy_rows` with their weight, HEAVY_KEYS rows at most.

    Where more keys are that heavy, the limit is raised to the next doubling that few enough keys reach.
    No key above the raised limit is left whole, and one below it is a small part of all rows.
    """
    heavy = counts.filter(F.col(weight) > heavy_rows).select(*keys, weight)
    if heavy.isEmpty():
        return heavy
    level = F.floor(F.log2(F.col(weight)))
    levels = {r["level"]: r["n"] for r in heavy.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room, least = HEAVY_KEYS, None
    for found in sorted(levels, reverse=True):
        room -= levels[found]
        if room < 0:
            least = found + 1
            break
    return heavy if least is None else heavy.filter(level >= least)


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: list[str],
    heavy_rows: int = HEAVY_ROWS,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Left join of many rows to a one-row-per-key lookup, with heavy keys salted.

    `weight` is the lookup column saying how many rows carry the key. A heavy key gets one salt per
    `heavy_rows` rows: its rows are dealt over the salts by a hash of `spread_by`, and its lookup row
    is repeated once per salt, so all repeats together stay below rows / heavy_rows + HEAVY_KEYS.
    Rows without a key are dealt over salts of their own; all other keys join on salt 0.

    The lookup is read twice, for its heavy keys and for the join, and usually summarises `rows`
    itself, so it is written to the shared folder first; with `weights`, a written table of the keys and
    their weight, it stays lazy.
    """
    if weights is None:
        lookup = weights = materialize(lookup, "lookup")
    missing: Column = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    hashed = F.xxhash64(*spread_by)
    keyless = F.when(missing, F.pmod(hashed, F.lit(KEYLESS_SALTS)))
    heavy = heavy_keys(weights, keys, weight, heavy_rows)
    if heavy.isEmpty():
        salted_rows = rows.withColumn("_salt", F.coalesce(keyless, F.lit(0)).cast("long"))
        salted_lookup = lookup.withColumn("_salt", F.lit(0).cast("long"))
    else:
        salts = F.ceil(F.col(weight) / max(heavy_rows, 1)).cast("long")
        hot = F.broadcast(heavy.select(*keys, salts.alias("_salts")))
        dealt = F.pmod(hashed, F.coalesce("_salts", F.lit(1)))
        salted_rows = rows.join(hot, keys, "left").withColumn(
            "_salt", F.coalesce(keyless, dealt).cast("long")).drop("_salts")
        every_salt = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
        salted_lookup = (
            lookup.join(hot, keys, "left").withColumn("_salt", F.explode(every_salt)).drop("_salts"))
    return salted_rows.join(salted_lookup, [*keys, "_salt"], "left").drop("_salt")


def grouped(
    rows: DataFrame, key: str, by: list[str], measures: list[Column], heavy: DataFrame | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The prepared rows grouped by `by`, which contains `key`. What moves are the rows as they come, before `prepare`.

    That is less than partial aggregates where measures are many and keys have few rows each in a task. Rows of the
    `heavy` keys, values of `key` that no single task takes, are aggregated before they move.
    """
    if heavy is None or heavy.isEmpty():
        return prepare(rows.repartition(key)).groupBy(*by).agg(*measures)
    hot = F.broadcast(heavy)
    light = prepare(rows.join(hot, key, "left_anti").repartition(key)).groupBy(*by).agg(*measures)
    return light.unionByName(prepare(rows.join(hot, key, "left_semi")).groupBy(*by).agg(*measures))
