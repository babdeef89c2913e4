"""Static profile of a card: customer, accounts, ages and category frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.constants import FREQUENCY_COLUMNS
from cardflow.operators import skew

# Used to build the profile and left out of its result.
_NOT_KEPT = ["prim_cst_accno", "cst_id", "card_create_dt"]


def _with_customer(card: DataFrame, cst: DataFrame, heavy_rows: int) -> DataFrame:
    """Customer columns and cards per customer; one customer may own a large part of the cards.

    A customer column that a card has too is named after the customer.
    """
    both = set(card.columns) & set(cst.columns) - {"cst_id"}
    cst = cst.withColumnsRenamed({c: f"cst_{c}" for c in both})
    owners = card.groupBy("cst_id").agg(F.count(F.lit(1)).alias("cst_n_cards"))
    return skew.spread_join(
        card, owners.join(cst, "cst_id", "left"), ["cst_id"], "cst_n_cards", ["card_no"], heavy_rows)


def static_profile(
    txn: DataFrame, card: DataFrame, cst: DataFrame, accno: DataFrame,
    heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Cards per customer, account count and ages in days; remaining numeric columns pass through."""
    accounts = accno.groupBy("card_no").agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.min("open_accno_dt").alias("_opened_first"),
        F.max("open_accno_dt").alias("_opened_last"),
    )
    anchors = txn.groupBy("card_no").agg(F.max("stm_dt").alias("_anchor"))
    profile = (
        _with_customer(card, cst, heavy_rows)
        .join(accounts, "card_no", "left").join(anchors, "card_no", "left")
    )
    age = lambda since: F.date_diff("_anchor", since)
    return profile.withColumns({
        "card_age_d": age("card_create_dt"),
        "acc_age_max_d": age("_opened_first"),
        "acc_age_min_d": age("_opened_last"),
    }).drop(*_NOT_KEPT, *FREQUENCY_COLUMNS, "_opened_first", "_opened_last", "_anchor")


def frequency_encoding(
    card: DataFrame, cst: DataFrame, columns: list[str] = FREQUENCY_COLUMNS,
    heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """How many cards share the card's category; an unknown category has no frequency.

    All columns go through one long table of (column, value), so one count and one join serve them.
    """
    long = _with_customer(card, cst, heavy_rows).select(
        "card_no",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]),
        )).alias("field", "category"),
    )
    frequencies = long.filter(F.col("category").isNotNull()).groupBy("field", "category").agg(
        F.count(F.lit(1)).alias("freq"))
    counted = skew.spread_join(
        long, frequencies, ["field", "category"], "freq", ["card_no"], heavy_rows)
    return counted.groupBy("card_no").agg(*[
        F.max(F.when(F.col("field") == c, F.col("freq"))).alias(f"{c}_freq") for c in columns
    ])
