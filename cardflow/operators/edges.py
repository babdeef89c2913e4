"""Directed card - counterparty edges and their variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import LOW_DEGREE_LIMIT
from cardflow.functions.exprs import sum0
from cardflow.operators import skew


@dataclass(frozen=True)
class Variant:
    """A subset of edges with the amount it weighs them by.

    A low-degree variant is another variant (`counts_of`) without hub keys. All edges of a key stay
    or go together, so both share their label counts.
    """

    name: str
    amount: str = "out_sum"
    keep: Column | None = None
    low_degree: bool = False
    counts_of: str | None = None

    @property
    def counts(self) -> str:
        return self.counts_of or self.name

    def flag(self, degree: Column, limit: int) -> Column:
        kept = F.lit(True) if self.keep is None else F.coalesce(self.keep, F.lit(False))
        return kept & (degree <= limit) if self.low_degree else kept


def account_variants() -> list[Variant]:
    paid_out, paid_in = F.col("out_n") > 0, F.col("in_n") > 0
    return [
        Variant("aa"),
        Variant("ao", keep=paid_out),
        Variant("ai", "in_sum", paid_in),
        Variant("aol", keep=paid_out, low_degree=True, counts_of="ao"),
        Variant("aop", keep=paid_out & (F.col("prvt") == 1)),
    ]


def name_variants() -> list[Variant]:
    paid_out = F.col("out_n") > 0
    return [
        Variant("na"),
        Variant("no", keep=paid_out),
        Variant("nol", keep=paid_out, low_degree=True, counts_of="no"),
    ]


def edge_table(txn: DataFrame, key: str) -> DataFrame:
    """(card, key): rows and sums by direction; rows without a key are left out."""
    return (
        txn.filter(F.col(key).isNotNull())
        .groupBy("card_no", F.col(key).alias("key"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("outflow_amt") > 0).alias("out_n"),
            sum0(F.col("outflow_amt")).alias("out_sum"),
            F.count_if(F.col("inflow_amt") > 0).alias("in_n"),
            sum0(F.col("inflow_amt")).alias("in_sum"),
            F.max("cntrprt_prvt_ind").alias("prvt"),
        )
    )


def key_degrees(edges: DataFrame) -> DataFrame:
    """Cards per key over the whole edge table, both directions."""
    return edges.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))


def graded_edges(edges: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """Edges with the degree of their key; hub keys are salted."""
    return skew.spread_join(edges, key_degrees(edges), ["key"], "degree", ["card_no"], heavy_rows)


def low_degree_edges(
    edges: DataFrame, limit: int = LOW_DEGREE_LIMIT, heavy_rows: int = skew.HEAVY_ROWS
) -> DataFrame:
    """Edges whose key is linked to at most `limit` cards (a semi join on the kept keys)."""
    return graded_edges(edges, heavy_rows).filter(F.col("degree") <= limit).drop("degree")


def edge_variants(
    edges: DataFrame, variants: list[Variant], limit: int = LOW_DEGREE_LIMIT,
    heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Every edge once per variant it belongs to, with the variant's amount."""
    memberships = F.array_compact(F.array(*[
        F.when(v.flag(F.col("degree"), limit), F.struct(
            F.lit(v.name).alias("variant"), F.col(v.amount).alias("amt")))
        for v in variants
    ]))
    return graded_edges(edges, heavy_rows).withColumn("_m", F.explode(memberships)).select(
        F.col("_m.variant").alias("variant"), "card_no", "key", "n", F.col("_m.amt").alias("amt"))
