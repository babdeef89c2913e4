"""Features read off a card's calendar: one row per (card, day), so windows stay short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.constants import DAY_LOOKBACKS
from cardflow.functions.exprs import sum0, sum_where
from cardflow.operators.timeline import with_directions


def daily(txn: DataFrame) -> DataFrame:
    """(card, stm_dt): rows, sums, hours, counterparties, and days before the card's last day.

    Counterparties are counted by grouping on (card, day, counterparty) first; the window runs over
    the days of a card.
    """
    known_out = F.col("is_out") & F.col("cntrprt_card_no").isNotNull()
    cells = with_directions(txn).groupBy("card_no", "stm_dt", "cntrprt_card_no").agg(
        F.count(F.lit(1)).alias("n"),
        sum0(F.col("inflow_amt")).alias("in_sum"),
        sum0(F.col("outflow_amt")).alias("out_sum"),
        F.min("hour").alias("hour_min"),
        F.max("hour").alias("hour_max"),
        F.count_if(known_out).alias("known_out"),
    )
    days = cells.groupBy("card_no", "stm_dt").agg(
        F.sum("n").alias("n"),
        F.sum("in_sum").alias("in_sum"),
        F.sum("out_sum").alias("out_sum"),
        F.min("hour_min").alias("hour_min"),
        F.max("hour_max").alias("hour_max"),
        F.count(F.lit(1)).alias("n_cntrprt"),
        F.count_if(F.col("known_out") > 0).alias("out_cntrprt"),
    )
    last_day = F.max("stm_dt").over(W.partitionBy("card_no"))
    return days.withColumn("days_before", F.date_diff(last_day, F.col("stm_dt")))


def lookback_measures(widths: list[int] = DAY_LOOKBACKS) -> list[Column]:
    measures = []
    for w in widths:
        recent = F.col("days_before") < w
        measures += [
            F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias(f"n_txn_w{w}"),
            sum_where(recent, F.col("in_sum")).alias(f"in_sum_w{w}"),
            sum_where(recent, F.col("out_sum")).alias(f"out_sum_w{w}"),
        ]
    return measures


LAST_DAY = {
    "d0_n": "n", "d0_in_sum": "in_sum", "d0_out_sum": "out_sum", "d0_n_cntrprt": "n_cntrprt",
    "d0_hour_min": "hour_min", "d0_hour_max": "hour_max",
}


def last_day_measures() -> list[Column]:
    return [
        F.max(F.when(F.col("days_before") == 0, F.col(source))).alias(name)
        for name, source in LAST_DAY.items()
    ]


def peak_measures() -> list[Column]:
    return [
        F.max("n").alias("daily_n_max"),
        F.max("out_sum").alias("daily_out_max"),
        F.max("in_sum").alias("daily_in_max"),
        F.stddev_samp("n").alias("daily_n_std"),
    ]


def spread_measures() -> list[Column]:
    """Outflow counterparties on the days that have any."""
    parties = F.when(F.col("out_cntrprt") > 0, F.col("out_cntrprt"))
    return [F.max(parties).alias("fanout_day_max"), F.avg(parties).alias("fanout_day_mean")]


def day_lookbacks(days: DataFrame, widths: list[int] = DAY_LOOKBACKS) -> DataFrame:
    return days.groupBy("card_no").agg(*lookback_measures(widths))


def last_day(days: DataFrame) -> DataFrame:
    return days.filter(F.col("days_before") == 0).select(
        "card_no", *[F.col(source).alias(name) for name, source in LAST_DAY.items()])


def daily_peak(days: DataFrame) -> DataFrame:
    return days.groupBy("card_no").agg(*peak_measures())


def hour_counts(txn: DataFrame) -> DataFrame:
    """(card_no, code = hour of day, n, out_max): rows, and most outflow rows in one such hour."""
    return (
        with_directions(txn)
        .groupBy("card_no", "stm_dt", "hour")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_out").alias("n_out"))
        .groupBy("card_no", F.col("hour").alias("code"))
        .agg(F.sum("n").alias("n"), F.max("n_out").alias("out_max"))
    )


def busiest_hour() -> Column:
    return F.max(F.when(F.col("out_max") > 0, F.col("out_max"))).alias("hourly_out_max")


def fan_out(days: DataFrame, txn: DataFrame) -> DataFrame:
    """Outflow counterparties per day and outflow rows per hour; cards without outflow are absent."""
    hours = hour_counts(txn).groupBy("card_no").agg(busiest_hour()).filter("hourly_out_max > 0")
    return hours.join(days.groupBy("card_no").agg(*spread_measures()), "card_no", "left")
