"""Account-level concentration and balance consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardflow.constants import ACCOUNT_COLUMNS
from cardflow.functions.exprs import safe_div, sum0, sum_where
from cardflow.operators.ranks import nearest_quantile
from cardflow.operators.timeline import SLICE_SECONDS, heavy_and_tasks, split_heavy
from cardflow.sources.store import materialize

# Order inside an account.
ACCOUNT_ORDER = ["tms", "accno_txn_sn"]
ACCOUNT = ["card_no", "cst_accno"]
QUANTILE = 0.9


def account_concentration(txn: DataFrame, card: DataFrame) -> DataFrame:
    """How concentrated the flows of a card are over its accounts, and the primary account's part.

    sum((x / (T + 1))^2) = sum(x^2) / (T + 1)^2, so no window over the accounts is needed. The
    primary flag is a join on (card, account), which is unique on both sides.
    """
    primary = card.select(
        "card_no", F.col("prim_cst_accno").alias("cst_accno"), F.lit(True).alias("is_primary"))
    accounts = (
        txn.groupBy(*ACCOUNT)
        .agg(sum0(F.col("inflow_amt")).alias("paid_in"), sum0(F.col("outflow_amt")).alias("paid_out"))
        .join(primary, ACCOUNT, "left")
    )
    measures = []
    for side, column in (("in", "paid_in"), ("out", "paid_out")):
        amount, total = F.col(column), F.sum(column) + 1
        measures += [
            safe_div(F.sum(amount * amount), total * total).alias(f"AB_acc_{side}_hhi"),
            safe_div(sum_where(F.col("is_primary"), amount), total).alias(f"AB_primary_{side}_share"),
        ]
    return accounts.groupBy("card_no").agg(*measures)


def _neighbours(rows: DataFrame, group: list[str]) -> DataFrame:
    ordered = W.partitionBy(*group).orderBy(*ACCOUNT_ORDER)
    return rows.withColumns({
        "_pos": F.row_number().over(ordered),
        "_prev": F.lag("acct_bal").over(ordered),
        "_next": F.lead("acct_bal").over(ordered),
    })


def _bridged(sliced: DataFrame) -> DataFrame:
    """Neighbour balances of heavy cards: inside a slice by window, across slices by the first and
    last balance of each slice."""
    place = F.struct(*ACCOUNT_ORDER)
    ends = sliced.groupBy(*ACCOUNT, "_slice").agg(
        F.count(F.lit(1)).alias("_size"),
        F.min_by("acct_bal", place).alias("_first"),
        F.max_by("acct_bal", place).alias("_last"),
    )
    slices = W.partitionBy(*ACCOUNT).orderBy("_slice")
    bridges = ends.select(
        F.col("card_no").alias("_card"), F.col("cst_accno").alias("_account"),
        F.col("_slice").alias("_s"), "_size",
        F.lag("_last").over(slices).alias("_carry_prev"),
        F.lead("_first").over(slices).alias("_carry_next"),
    )
    joined = _neighbours(sliced, [*ACCOUNT, "_slice"]).join(
        bridges,
        (F.col("card_no") == F.col("_card"))
        & F.col("cst_accno").eqNullSafe(F.col("_account"))
        & (F.col("_slice") == F.col("_s")))
    return joined.withColumns({
        "_prev": F.when(F.col("_pos") == 1, F.col("_carry_prev")).otherwise(F.col("_prev")),
        "_next": F.when(F.col("_pos") == F.col("_size"), F.col("_carry_next"))
        .otherwise(F.col("_next")),
    })


def _with_residuals(rows: DataFrame) -> DataFrame:
    """Gap between balance movement and booked amount, against the row before and the row after."""
    balance, signed = F.col("acct_bal"), F.col("inflow_amt") - F.col("outflow_amt")
    after = F.abs((balance - F.col("_prev")) - signed)
    return rows.select(
        *ACCOUNT,
        after.alias("after"),
        F.abs((F.col("_next") - balance) - signed).alias("before"),
        safe_div(after, F.abs(signed) + 1).alias("rel"),
    )


def _ordinary_consistency(plain: DataFrame, tasks: int | None) -> DataFrame:
    """One shuffle on the card and one sort of its rows; the quantiles then rank counted values.

    A residual is counted per (account, side, value) first. Running counts over an account's or a card's values
    show which one stands at the quantile, so no row is ranked.
    """
    dealt = plain.repartition("card_no") if tasks is None else plain.repartition(tasks, "card_no")
    rows = _with_residuals(_neighbours(dealt, ACCOUNT))
    sides = F.explode(F.array(
        F.struct(F.lit("after").alias("side"), F.col("after").alias("value"), F.col("rel").alias("rel")),
        F.struct(F.lit("before").alias("side"), F.col("before").alias("value"), F.lit(None).cast("double").alias("rel"))))
    counts = rows.select(*ACCOUNT, sides.alias("s")).select(*ACCOUNT, "s.*").groupBy(*ACCOUNT, "side", "value").agg(
        F.count("value").alias("c"), F.sum("rel").alias("rel"), F.count("rel").alias("rel_n"))

    def at_quantile(group: list[str]) -> Column:
        whole = W.partitionBy(*group, "side")
        upto = F.sum("c").over(
            whole.orderBy(F.col("value").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
        index = F.round((F.sum("c").over(whole) - 1) * F.lit(QUANTILE))
        return F.when((upto > index) & (upto - F.col("c") <= index), F.col("value"))

    picked = counts.withColumns({"_account": at_quantile(ACCOUNT), "_card": at_quantile(["card_no"])})
    of_side = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    per_account = picked.groupBy(*ACCOUNT).agg(
        F.least(of_side("after", "_account"), of_side("before", "_account")).alias("best"),
        of_side("after", "_card").alias("card_p90"),
        F.sum("rel").alias("rel"), F.sum("rel_n").alias("rel_n"),
    )
    return per_account.groupBy("card_no").agg(
        safe_div(F.sum("rel"), F.sum("rel_n")).alias("AB_relresid_after_mean"),
        F.avg("best").alias("AB_acc_resid_best_p90_mean"),
        F.max("card_p90").alias("AB_resid_after_p90"),
    )


def _heavy_consistency(sliced: DataFrame) -> DataFrame:
    """The same measures for heavy cards, by order statistics that never gather a card."""
    rows = materialize(_with_residuals(_bridged(sliced)), "residuals")
    sides = F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("value")) for side in ("after", "before")
    ]))
    long = rows.select(*ACCOUNT, sides.alias("s")).select(*ACCOUNT, "s.side", "s.value")
    best = (
        nearest_quantile(long, [*ACCOUNT, "side"], "value", QUANTILE, "p90")
        .groupBy(*ACCOUNT).agg(F.min("p90").alias("best"))
        .groupBy("card_no").agg(F.avg("best").alias("AB_acc_resid_best_p90_mean"))
    )
    card_p90 = nearest_quantile(rows, ["card_no"], "after", QUANTILE, "AB_resid_after_p90")
    mean = rows.groupBy("card_no").agg(F.avg("rel").alias("AB_relresid_after_mean"))
    return mean.join(best, "card_no", "left").join(card_p90, "card_no", "left")


def balance_consistency(
    txn: DataFrame, heavy: DataFrame | None = None, slice_seconds: int = SLICE_SECONDS, tasks: int | None = None
) -> DataFrame:
    """Card mean of the relative residual, card 90 % residual, and mean over accounts of the smaller
    90 % residual of both directions. `heavy` and `tasks` are as for `timeline.enrich`."""
    if heavy is None:
        heavy, tasks = heavy_and_tasks(txn)
    needed = txn.select(*ACCOUNT, *ACCOUNT_ORDER, "acct_bal", "inflow_amt", "outflow_amt")
    plain, sliced = split_heavy(needed, heavy, slice_seconds)
    ordinary = _ordinary_consistency(plain, tasks)
    return ordinary if sliced is None else ordinary.unionByName(_heavy_consistency(sliced))


def account_features(txn: DataFrame, card: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """The seven account columns in their fixed order."""
    return account_concentration(txn, card).join(
        balance_consistency(txn, heavy), "card_no", "left").select("card_no", *ACCOUNT_COLUMNS)
