"""Stratified folds from a hash, the same for exposure and for model fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import FOLD_SEED, N_FOLDS
from cardflow.operators.ranks import uniform_position

HASH_SPAN = 2**32


def card_hash(seed: int = FOLD_SEED) -> Column:
    return F.pmod(F.xxhash64("card_no", F.lit(seed)), F.lit(HASH_SPAN))


def numeric_card_hash(seed: int = FOLD_SEED) -> Column:
    """Multiplicative hash for numeric card ids; any SQL engine computes the same."""
    # Decimals, so that ids of any length fit.
    spread = F.col("card_no").cast("decimal(24,0)") * F.lit(2654435761).cast("decimal(10,0)") + seed * 40503
    return F.pmod(spread, F.lit(HASH_SPAN).cast("decimal(10,0)")).cast("long")


def stratified_folds(
    train: DataFrame, n_folds: int = N_FOLDS, hashed: Column | None = None
) -> DataFrame:
    """(card_no, label, fold): labels are dealt over the folds in hash order, so every fold gets an
    even part of each. One label holds nearly all cards, hence the bucketed position. Cards whose
    label could not be read are no training cards."""
    spread = train.filter(F.col("label").isNotNull()).select(
        "card_no", "label", (card_hash() if hashed is None else hashed).alias("_h"))
    placed = uniform_position(spread, ["label"], "_h", HASH_SPAN, ["card_no"], "_position")
    return placed.select(
        "card_no", "label", ((F.col("_position") - 1) % n_folds).cast("int").alias("fold"))
