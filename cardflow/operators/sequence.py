"""Features of the event order: gaps, fast in-and-out, flips, last rows, balance path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.constants import INTERBANK
from cardflow.functions.exprs import share, sum_where
from cardflow.operators.timeline import tail_rows


def flip_measures() -> list[Column]:
    return [F.count_if("io_flip").alias("n_io_flips")]


def ranked_values(enriched: DataFrame, value: str, median: str, measures: list[Column]) -> DataFrame:
    """Exact median per card and `measures` over the rows, null where a card has no value.

    The rows of a card are sorted by value, and their numbers show where the middle lies, so no buffer holds a card's
    values and `enriched` is read once. Values of a card are mostly distinct: counting them first would hash every row twice.
    """
    card = W.partitionBy("card_no")
    placed = enriched.select("card_no", value).withColumns({
        "_at": F.row_number().over(card.orderBy(F.col(value).asc_nulls_last())) - 1, "_n": F.count(value).over(card)})
    last = F.col("_n") - 1
    at = lambda place: F.max(F.when(F.col("_at") == place, F.col(value)))
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0
    return placed.groupBy("card_no").agg(*measures, middle.alias(median))


def last_row_measures() -> list[Column]:
    """Values of the last row, as aggregates over rows that carry rn_end."""
    at_end = lambda c: F.max(F.when(F.col("rn_end") == 0, c))
    return [
        at_end(F.col("is_out").cast("byte")).alias("last_is_out"),
        at_end(F.col("txn_amt")).alias("last_amt"),
        at_end(F.col("acct_bal")).alias("last_bal2"),
        at_end(F.col("hour")).alias("last_hour"),
        at_end(F.col("cntrprt_prvt_ind")).alias("last_prvt"),
    ]


def last_k_measures() -> list[Column]:
    """Measures of the last 3, 5, 10 and 20 rows, counterparty counts left out."""
    rn = F.col("rn_end")
    measures = []
    for k in (3, 20):
        recent = rn < k
        measures += [
            share(F.when(recent, F.col("is_out"))).alias(f"last{k}_out_share"),
            sum_where(recent, F.col("outflow_amt")).alias(f"last{k}_out_sum"),
            F.avg(F.when(recent, F.col("cntrprt_prvt_ind"))).alias(f"last{k}_prvt"),
            F.avg(F.when(recent, F.col("txn_amt"))).alias(f"last{k}_amt_mean"),
        ]
    five, ten = rn < 5, rn < 10
    return measures + [
        share(F.when(five, F.col("is_out"))).alias("last5_out_share"),
        sum_where(five, F.col("outflow_amt")).alias("last5_out_sum"),
        sum_where(five, F.col("inflow_amt")).alias("last5_in_sum"),
        F.avg(F.when(five, F.col("txn_amt"))).alias("last5_amt_mean"),
        F.min(F.when(five, F.col("acct_bal"))).alias("last5_bal_min"),
        share(F.when(ten, F.col("is_out"))).alias("last10_out_share"),
        sum_where(ten, F.col("outflow_amt")).alias("last10_out_sum"),
        F.avg(F.when(ten, F.col("cntrprt_prvt_ind"))).alias("last10_prvt_share"),
        share(F.when(ten, F.col("cntrprt_clear_type") == INTERBANK)).alias("last10_interbank"),
        F.max(F.when(ten, F.col("txn_amt"))).alias("last10_amt_max"),
        F.avg(F.when(ten, F.col("hour"))).alias("last10_hour_mean"),
    ]


def balance_path_measures() -> list[Column]:
    """First balance, balance before the last row, and change over the history."""
    balance = F.col("acct_bal")
    first = F.max(F.when(F.col("is_first"), balance))
    return [
        first.alias("bal_first"),
        F.max(F.when(F.col("rn_end") == 1, balance)).alias("bal_prev1"),
        (F.max(F.when(F.col("rn_end") == 0, balance)) - first).alias("bal_delta"),
    ]


# Rows that fall into the look-back of a counterparty count: name -> rows from the end.
LAST_K_PARTIES = {"last3_n_cp": 3, "last20_n_cp": 20, "last10_n_cntrprt": 10}


def gap_stats(enriched: DataFrame) -> DataFrame:
    """Seconds between neighbouring rows."""
    gap = F.col("gap_sec")
    return ranked_values(enriched, "gap_sec", "gap_median", [
        F.avg(gap).alias("gap_mean"), F.min(gap).alias("gap_min"), F.count_if(gap < 60).alias("n_burst60")])


def fast_in_out(enriched: DataFrame) -> DataFrame:
    """Seconds from the latest inflow to each outflow."""
    wait = F.col("out_after_in_sec")
    return ranked_values(enriched, "out_after_in_sec", "fio_median", [
        F.min(wait).alias("fio_min"), F.count_if(wait < 3600).alias("n_fastout_1h"),
        F.count_if(wait < 86400).alias("n_fastout_1d")])


def io_flips(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("card_no").agg(*flip_measures())


def last_row(txn: DataFrame) -> DataFrame:
    return tail_rows(txn, 1).groupBy("card_no").agg(*last_row_measures())


def last_k(txn: DataFrame) -> DataFrame:
    """At most 20 rows per card reach the aggregate, so the counterparty sets stay that small."""
    party = F.col("cntrprt_card_no")

    def parties(k: int) -> Column:
        recent = F.col("rn_end") < k
        unknown = F.max(F.when(recent & party.isNull(), 1).otherwise(0))
        return F.size(F.collect_set(F.when(recent, party))) + unknown

    return tail_rows(txn, 20).groupBy("card_no").agg(
        *last_k_measures(), *[parties(k).alias(name) for name, k in LAST_K_PARTIES.items()])


def balance_path(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("card_no").agg(*balance_path_measures())
