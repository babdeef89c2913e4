"""Per-card event sequences: anchors, positions, previous rows and forward fills.

Almost every card is one window group: one shuffle on the card and one sort. But one card may hold a
large part of all rows. Cards above `skew.HEAVY_ROWS` leave that path and are cut into time slices:
their row-level windows run inside (card, slice), and a summary with one row per (card, slice)
carries counts, last times and last directions from slice to slice. That summary grows with the
calendar, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.functions.exprs import seconds_between
from cardflow.operators import skew
from cardflow.sources.store import materialize

# Event order. The account number settles two accounts that write in the same second.
EVENT_ORDER = ["tms", "accno_txn_sn", "cst_accno"]
SLICE_SECONDS = 60
# Rows without a time sort first, so their slice is the smallest number.
UNTIMED_SLICE = -(2**62)
# Rows of ordinary cards that one task sorts and groups. Sorts, windows and group-bys behind one shuffle add up to about
# 2.5 kB of task memory per row.
ROWS_PER_TASK = 400_000


def event_position() -> Column:
    """Sortable position of a row inside its card."""
    return F.struct(*EVENT_ORDER)


def with_directions(txn: DataFrame) -> DataFrame:
    return txn.withColumns({
        "hour": F.hour("tms"),
        "is_in": F.col("inflow_amt") > 0,
        "is_out": F.col("outflow_amt") > 0,
    })


def card_rows(txn: DataFrame) -> DataFrame:
    """Number of rows per card (`_rows`), from one scan of the card column; written, as sizes and heavy cards are read off it."""
    return materialize(txn.groupBy("card_no").agg(F.count(F.lit(1)).alias("_rows")), "card-rows")


def total_rows(per_card: DataFrame) -> int:
    return per_card.agg(F.sum("_rows")).first()[0] or 0


def heavy_cards(
    txn: DataFrame, heavy_rows: int = skew.HEAVY_ROWS, counted: str | None = None
) -> DataFrame:
    """Cards with more than `heavy_rows` rows, from a scan of the card column alone.

    With `counted`, `txn` has one row per card and its number of rows in that column.
    """
    counts = card_rows(txn) if counted is None else txn.withColumnRenamed(counted, "_rows")
    heavy = skew.heavy_keys(counts, ["card_no"], "_rows", heavy_rows)
    return materialize(heavy.select("card_no"), "heavy-cards")


def task_count(spark: SparkSession, rows: int) -> int | None:
    """Tasks that `rows` rows need; None where the plan's own shuffle keeps tasks small enough."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def dealt_by_card(plain: DataFrame, tasks: int | None) -> DataFrame:
    """The rows shuffled on the card over `tasks` tasks. Left to the plan, the number of tasks does not follow the rows."""
    return plain if tasks is None else plain.repartition(tasks, "card_no")


def heavy_and_tasks(txn: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> tuple[DataFrame, int | None]:
    """The heavy cards and the tasks that all rows need, from one count of the cards."""
    per_card = card_rows(txn)
    return heavy_cards(per_card, heavy_rows, "_rows"), task_count(txn.sparkSession, total_rows(per_card))


def split_heavy(
    txn: DataFrame, heavy: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary cards, and rows of heavy cards with `_slice`; None when no card is heavy."""
    if heavy.isEmpty():
        return txn, None
    hot = F.broadcast(heavy)
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    time_slice = F.floor(seconds_between(epoch, F.col("tms")) / slice_seconds).cast("long")
    sliced = txn.join(hot, "card_no", "left_semi").withColumn(
        "_slice", F.coalesce(time_slice, F.lit(UNTIMED_SLICE)))
    return txn.join(hot, "card_no", "left_anti"), sliced


def _whole_card(rows: DataFrame) -> DataFrame:
    """Card-wide values of ordinary cards, as windows over the partitioning already at hand."""
    card = W.partitionBy("card_no")
    inflows = F.count_if("is_in").over(card)
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.withColumns({
        "anchor_dt": F.max("stm_dt").over(card),
        "anchor_tms": F.max("tms").over(card),
        "_card_rows": F.count(F.lit(1)).over(card),
        "_card_in": inflows,
    }).withColumns({
        "_rows_left": F.col("_card_rows"),
        "_in_left": F.col("_card_in"),
        "_carry_in_tms": nothing("timestamp_ntz"),
        "_carry_tms": nothing("timestamp_ntz"),
        "_carry_is_in": nothing("boolean"),
    })


def _carried(rows: DataFrame) -> DataFrame:
    """One row per (card, slice): card-wide values and what earlier slices hand over."""
    summary = rows.groupBy("card_no", "_slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_in").alias("n_in"),
        F.max("stm_dt").alias("max_dt"),
        F.max("tms").alias("max_tms"),
        F.max(F.when(F.col("is_in"), F.col("tms"))).alias("max_in_tms"),
        F.max_by("is_in", event_position()).alias("end_is_in"),
    )
    card = W.partitionBy("card_no")
    in_time = card.orderBy("_slice")
    earlier = in_time.rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return summary.select(
        "card_no", "_slice",
        F.max("max_dt").over(card).alias("anchor_dt"),
        F.max("max_tms").over(card).alias("anchor_tms"),
        F.sum("n").over(card).alias("_card_rows"),
        F.sum("n_in").over(card).alias("_card_in"),
        (F.sum("n").over(card) - before("n")).alias("_rows_left"),
        (F.sum("n_in").over(card) - before("n_in")).alias("_in_left"),
        F.max("max_in_tms").over(earlier).alias("_carry_in_tms"),
        F.lag("max_tms").over(in_time).alias("_carry_tms"),
        F.lag("end_is_in").over(in_time).alias("_carry_is_in"),
    )


def _positions(rows: DataFrame, group: list[str]) -> DataFrame:
    """Order-dependent values inside a window group."""
    ordered = W.partitionBy(*group).orderBy(*EVENT_ORDER)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({
        "_pos": F.row_number().over(ordered),
        "_prev_tms": F.lag("tms").over(ordered),
        "_prev_is_in": F.lag("is_in").over(ordered),
        "_in_upto": F.sum(F.when(F.col("is_in"), 1).otherwise(0)).over(upto),
        "_in_tms": F.last(F.when(F.col("is_in"), F.col("tms")), ignorenulls=True).over(upto),
    })


def _measured(placed: DataFrame) -> DataFrame:
    """Row measures from positions and card-wide values."""
    first = F.col("_pos") == 1
    previous_tms = F.when(first, F.col("_carry_tms")).otherwise(F.col("_prev_tms"))
    previous_in = F.when(first, F.col("_carry_is_in")).otherwise(F.col("_prev_is_in"))
    latest_in = F.coalesce("_in_tms", "_carry_in_tms")
    later_in = F.col("_in_left") - F.col("_in_upto")
    inflow = F.coalesce(F.col("is_in"), F.lit(False))
    rn_end = (F.col("_rows_left") - F.col("_pos")).cast("long")
    helpers = [c for c in placed.columns if c.startswith("_")]
    return placed.withColumns({
        "days_before": F.date_diff("anchor_dt", "stm_dt"),
        "sec_before": seconds_between(F.col("tms"), F.col("anchor_tms")),
        "rn_end": rn_end,
        "is_first": rn_end == F.col("_card_rows") - 1,
        "gap_sec": seconds_between(previous_tms, F.col("tms")),
        "out_after_in_sec": F.when(F.col("is_out"), seconds_between(latest_in, F.col("tms"))),
        "io_flip": F.col("is_out") & previous_in,
        "is_last_in": inflow & (later_in == 0),
        "after_last_in": ~inflow & (F.col("_card_in") > 0) & (later_in == 0),
    }).drop(*helpers)


def enrich(
    txn: DataFrame, heavy: DataFrame | None = None, slice_seconds: int = SLICE_SECONDS, tasks: int | None = None
) -> DataFrame:
    """Transactions with anchors, look-back distances, positions and previous-row measures.

    Adds hour, is_in, is_out, anchor_dt, anchor_tms, days_before, sec_before, rn_end (0 = last),
    is_first, gap_sec, out_after_in_sec, io_flip, is_last_in (the card's last inflow) and
    after_last_in (row follows it). `heavy` is a `heavy_cards` result, computed when not given, and `tasks` a
    `task_count`, computed with it.
    """
    if heavy is None:
        heavy, tasks = heavy_and_tasks(txn)
    plain, sliced = split_heavy(with_directions(txn), heavy, slice_seconds)
    # Positions first: their sort also serves the card-wide windows.
    enriched = _measured(_whole_card(_positions(dealt_by_card(plain, tasks), ["card_no"])))
    if sliced is None:
        return enriched
    heavy = _positions(sliced, ["card_no", "_slice"]).join(_carried(sliced), ["card_no", "_slice"])
    return enriched.unionByName(_measured(heavy))


def tail_rows(txn: DataFrame, k: int) -> DataFrame:
    """The last k rows of each card with rn_end = 0 .. k-1.

    The row limit is applied before the shuffle (at most k rows per card leave a task), so the
    window needs no slices.
    """
    latest = W.partitionBy("card_no").orderBy(*[F.desc(c) for c in EVENT_ORDER])
    return (
        with_directions(txn)
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= k)
        .withColumn("rn_end", (F.col("_rank") - 1).cast("long"))
        .drop("_rank")
    )
