"""Turning scores into ranks, blends, rules and top-fraction figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import RULE_SILENCE_DAYS, TOP_FRACTION
from cardflow.functions.exprs import safe_div
from cardflow.operators.folds import card_hash
from cardflow.operators.ranks import average_rank_share, average_ranks, first_rows
from cardflow.sources.store import materialize


def rank_normalise(
    scores: DataFrame, groups: list[str] | None = None, name: str = "rank", parts: int | None = None,
) -> DataFrame:
    """Average rank of `score` over the number of scores."""
    return average_rank_share(scores, "score", name, groups, ["card_no"], parts)


def fold_mean(scores: DataFrame) -> DataFrame:
    return scores.groupBy("card_no", "family", "seed").agg(F.avg("score").alias("score"))


def family_scores(scores: DataFrame, parts: int | None = None) -> DataFrame:
    """Mean rank over the seeds of each family; `scores` carry one row per (card, family, seed)."""
    ranked = rank_normalise(scores, ["family", "seed"], "_rank", parts)
    return ranked.groupBy("card_no", "family").agg(F.avg("_rank").alias("score"))


def rank_blend(families: DataFrame, parts: int | None = None) -> DataFrame:
    """Rank of the equally weighted mean of the families' ranks.

    The mean is rounded to 12 places: the order of adding must not tell equal means apart.
    """
    ranked = rank_normalise(materialize(families, "families"), ["family"], "_rank", parts)
    mean = materialize(
        ranked.groupBy("card_no").agg(F.round(F.avg("_rank"), 12).alias("score")), "mean-rank")
    return rank_normalise(mean, None, "_blend", parts).select(
        "card_no", F.col("_blend").alias("score"))


def hard_rule(
    scores: DataFrame, silence: DataFrame, days: int = RULE_SILENCE_DAYS
) -> DataFrame:
    """Score 1.0 for cards silent for `days` or more; unknown silence leaves the score."""
    return scores.join(silence.select("card_no", "sil_days"), "card_no", "left").withColumn(
        "score", F.when(F.col("sil_days") >= days, F.lit(1.0)).otherwise(F.col("score"))
    ).drop("sil_days")


def top_fraction(
    scored: DataFrame, fraction: float = TOP_FRACTION, tie: Column | None = None, parts: int | None = None,
) -> DataFrame:
    """The floor(n * fraction) rows with the highest score; rows of one score go by a card hash, then by card."""
    rows = scored.filter(F.col("score").isNotNull()).withColumn("_tie", card_hash() if tie is None else tie)
    return first_rows(rows, [F.desc("score"), F.asc("_tie"), F.asc("card_no")], fraction, parts).drop("_tie")


def top_fraction_f1(
    scored: DataFrame, fraction: float = TOP_FRACTION, tie: Column | None = None
) -> DataFrame:
    """One row: decided cards, hits, precision, recall and F1 of the top fraction of the labelled rows."""
    scored = scored.filter(F.col("label").isNotNull())
    chosen = top_fraction(scored, fraction, tie).agg(
        F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("label"), F.lit(0)).alias("tp"))
    positives = scored.agg(F.sum("label")).scalar()
    graded = chosen.withColumn("positives", positives).withColumns({
        "precision": safe_div(F.col("tp"), F.col("k")),
        "recall": safe_div(F.col("tp"), F.col("positives")),
    })
    p, r = F.col("precision"), F.col("recall")
    return graded.withColumn("f1", 2 * p * r / (p + r + 1e-9))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of the labelled rows from the rank sum of the positives, ties counted half."""
    known = scored.filter(F.col("label").isNotNull() & F.col("score").isNotNull()).select("card_no", "score", "label")
    totals = average_ranks(known, "score", spread_by=["card_no"]).agg(
        F.count_if(F.col("label") == 1).cast("double").alias("pos"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.when(F.col("label") == 1, F.col("avg_rank"))).alias("rank_sum"),
    )
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return totals.select(
        safe_div(F.col("rank_sum") - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def ranked_output(scores: DataFrame, target: DataFrame) -> DataFrame:
    """Every target card once, in target order, with its score."""
    return target.select("card_no", "row_order").join(
        scores.select("card_no", "score"), "card_no", "left").select("row_order", "card_no", "score")


def check_output(output: DataFrame, target: DataFrame) -> DataFrame:
    """One row of counts; a complete output has missing = extra = doubled = 0."""
    keys = output.groupBy("card_no").agg(F.count(F.lit(1)).alias("_n"), F.count("score").alias("_s"))
    both = target.select("card_no", F.lit(True).alias("_t")).join(keys, "card_no", "full")
    return both.agg(
        F.count_if(F.col("_t") & F.coalesce(F.col("_s") == 0, F.lit(True))).alias("missing"),
        F.count_if(F.col("_t").isNull()).alias("extra"),
        F.count_if(F.col("_n") > 1).alias("doubled"),
    )
