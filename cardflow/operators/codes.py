"""Code columns: shares, coverage, top codes and entropy, all from (card, code) counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.functions.exprs import safe_div, sum_where


def code_counts(txn: DataFrame, column: str) -> DataFrame:
    return txn.groupBy("card_no", F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def share_measures(names: dict[str, str]) -> list[Column]:
    coded = F.sum(F.when(F.col("code").isNotNull(), F.col("n")))
    return [
        safe_div(sum_where(F.col("code") == code, F.col("n")), coded).alias(name)
        for code, name in names.items()
    ]


def entropy_measure(name: str) -> Column:
    """-sum(p ln p) = ln N - sum(n ln n) / N: two sums and no window over the card."""
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    return (F.ln(total) - F.sum(n * F.ln(n)) / total).alias(name)


def distinct_measure(name: str) -> Column:
    """Distinct codes, null counted as one."""
    return F.count(F.lit(1)).alias(name)


def code_shares(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """One share column per code (`code -> column`); rows without a code are not counted."""
    return counts.groupBy("card_no").agg(*share_measures(names))


def code_share_rows(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(card_no, code, share) for the codes of a `top_codes` / `covered_codes` result.

    `wanted` is at most as long as its limit, so it is broadcast.
    """
    coded = counts.filter(F.col("code").isNotNull())
    totals = coded.groupBy("card_no").agg(F.sum("n").alias("coded"))
    return (
        coded.join(F.broadcast(wanted.select("code")), "code").join(totals, "card_no")
        .select("card_no", "code", safe_div(F.col("n"), F.col("coded")).alias("share"))
    )


def top_codes(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent codes by row count; ties go to the smaller code."""
    return (
        counts.filter(F.col("code").isNotNull())
        .groupBy("code").agg(F.sum("n").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "code").limit(k)
    )


def covered_codes(counts: DataFrame, floor: int, k: int, exclude: list[str]) -> DataFrame:
    """The k codes seen on most cards, at least `floor` of them and not in `exclude`."""
    wanted = F.col("code").isNotNull()
    if exclude:
        wanted = wanted & ~F.col("code").isin(exclude)
    return (
        counts.filter(wanted)
        .groupBy("code").agg(F.count(F.lit(1)).alias("n_cards"))
        .filter(F.col("n_cards") >= floor)
        .orderBy(F.desc("n_cards"), "code").limit(k)
    )


def code_list(codes: DataFrame) -> list[str]:
    """Codes of a `top_codes` / `covered_codes` result; its limit bounds what reaches the driver."""
    return [row["code"] for row in codes.select("code").collect()]


def entropy(counts: DataFrame, name: str) -> DataFrame:
    """Shannon entropy in nats of the code mix, null being a code of its own."""
    return counts.groupBy("card_no").agg(entropy_measure(name))
