"""Per-card aggregates that need no event order: flows, balances, mix, amounts, anchors.

Each block is a list of measures, so that the matrix computes many blocks in one aggregation, and a
DataFrame operator around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import CASH_CATEGORY, INTERBANK, ON_US
from cardflow.functions.exprs import iso_weekday, safe_div, share, sum0
from cardflow.operators.timeline import with_directions


def distinct_per_card(txn: DataFrame, column: str, name: str) -> DataFrame:
    """Number of distinct values per card, null counted as a value.

    Two group-bys: the first shrinks rows to (card, value) before and after its shuffle, so
    neither a popular card nor a popular value gathers in one task.
    """
    return (
        txn.groupBy("card_no", column).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("card_no").agg(F.count(F.lit(1)).alias(name))
    )


def _with_distinct(block: DataFrame, txn: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, column in columns.items():
        block = block.join(distinct_per_card(txn, column, name), "card_no", "left")
    return block


def card_anchor(txn: DataFrame, train: DataFrame, target: DataFrame) -> DataFrame:
    """First and last date, row count, span and group (label text, or `target` for targets)."""
    per_card = txn.groupBy("card_no").agg(
        F.max("stm_dt").alias("last_dt"),
        F.min("stm_dt").alias("first_dt"),
        F.count(F.lit(1)).alias("n_txn"),
    ).withColumn("span_days", F.date_diff("last_dt", "first_dt"))
    members = train.select("card_no", F.col("label").cast("string").alias("grp")).unionByName(
        target.select("card_no", F.lit("target").alias("grp")))
    return per_card.join(members, "card_no", "left")


def flow_measures() -> list[Column]:
    inflow, outflow = F.col("inflow_amt"), F.col("outflow_amt")
    paid_in, paid_out = F.when(F.col("is_in"), inflow), F.when(F.col("is_out"), outflow)
    return [
        F.count(F.lit(1)).alias("n_txn"),
        F.date_diff(F.max("stm_dt"), F.min("stm_dt")).alias("span_days"),
        F.count_if("is_in").alias("n_in"),
        sum0(inflow).alias("in_sum"),
        F.avg(paid_in).alias("in_mean"),
        F.max(inflow).alias("in_max"),
        F.stddev_samp(paid_in).alias("in_std"),
        F.count_if("is_out").alias("n_out"),
        sum0(outflow).alias("out_sum"),
        F.avg(paid_out).alias("out_mean"),
        F.max(outflow).alias("out_max"),
        F.stddev_samp(paid_out).alias("out_std"),
    ]


def balance_measures() -> list[Column]:
    """Over enriched rows, where the last row of a card is flagged."""
    balance = F.col("acct_bal")
    return [
        F.max(F.when(F.col("rn_end") == 0, balance)).alias("bal_last"),
        F.min(balance).alias("bal_min"),
        F.max(balance).alias("bal_max"),
        F.avg(balance).alias("bal_mean"),
        F.stddev_samp(balance).alias("bal_std"),
    ]


def mix_measures() -> list[Column]:
    clearing = F.col("cntrprt_clear_type")
    return [
        F.avg("cntrprt_prvt_ind").alias("prvt_share"),
        share(clearing == INTERBANK).alias("interbank_share"),
        share(clearing == ON_US).alias("onus_share"),
        share(F.col("txn_cgycd") == CASH_CATEGORY).alias("cash_share"),
        F.avg("rmrk_recharge_withdrawal_ind").alias("rmrk_rw_share"),
        F.avg("rmrk_short_ind").alias("rmrk_short_share"),
        F.avg("rmrk_e_credit_ind").alias("rmrk_ec_share"),
        share(F.col("hour") < 6).alias("night_share"),
    ]


def amount_measures() -> list[Column]:
    amount = F.col("txn_amt")
    return [
        share((amount % 100 == 0) & (amount > 0)).alias("round100_share"),
        share((amount % 1000 == 0) & (amount > 0)).alias("round1000_share"),
        F.count_if(amount >= 10000).alias("n_big1w"),
        F.count_if(amount >= 50000).alias("n_big5w"),
    ]


def calendar_measures() -> list[Column]:
    return [
        share(iso_weekday(F.col("tms")) >= 6).alias("weekend_share"),
        iso_weekday(F.max("tms")).alias("anchor_weekday"),
        F.hour(F.max("tms")).alias("anchor_hour"),
    ]


def flow_aggregates(txn: DataFrame) -> DataFrame:
    block = with_directions(txn).groupBy("card_no").agg(*flow_measures())
    return _with_distinct(block, txn, {"n_days": "stm_dt", "n_accno_used": "cst_accno"})


def balance_aggregates(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("card_no").agg(*balance_measures())


def mix_shares(txn: DataFrame) -> DataFrame:
    """Counterparty, channel, remark and hour-of-day mix."""
    rows = with_directions(txn)
    return _with_distinct(rows.groupBy("card_no").agg(*mix_measures()), rows, {
        "n_cntrprt": "cntrprt_card_no", "n_smy": "smy_cd",
        "n_channel": "txn_channel_type", "n_hours": "hour",
    })


def amount_shape(txn: DataFrame) -> DataFrame:
    return txn.groupBy("card_no").agg(*amount_measures())


def calendar(txn: DataFrame) -> DataFrame:
    return txn.groupBy("card_no").agg(*calendar_measures())


def amount_repetition(txn: DataFrame) -> DataFrame:
    """How often a card repeats the same amount."""
    per_amount = txn.groupBy("card_no", "txn_amt").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return per_amount.groupBy("card_no").agg(
        F.max("n").alias("amt_top1_cnt"),
        F.count(F.lit(1)).alias("n_unique_amt"),
        safe_div(F.max("n"), total).alias("amt_top1_share"),
        safe_div(F.count(F.lit(1)), total).alias("amt_unique_ratio"),
    )
