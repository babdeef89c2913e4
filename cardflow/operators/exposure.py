"""Label exposure of cards through shared counterparties, without leaking a card's own fold.

For each key: nf = positive reference cards, nc = reference cards. A card of fold k must only see the
other folds. (card, key) is unique, so the counts without fold k are the key's totals minus the
counts of fold k: one aggregation by key yields every leave-one-fold-out copy of every variant, where
a direct reading of the definition runs one join and two aggregations per fold, variant and side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import LOW_DEGREE_LIMIT, N_FOLDS
from cardflow.functions.exprs import safe_div, sum0
from cardflow.operators import skew
from cardflow.operators.edges import Variant, edge_table
from cardflow.sources.store import materialize

TRAIN, TARGET = "train", "target"


def _seat(side: str, fold: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), fold.cast("int").alias("fold"))


def fold_matched_roles(folds: DataFrame, target: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """One row per card: its label and fold as a reference, and the encodings it needs (`seats`).

    A train card is encoded once, without its own fold; a target card once per fold, so that each
    fold's model meets target values of the same label density.
    """
    targets = target.select("card_no", F.lit(True).alias("_wanted"))
    seats = F.concat(
        F.when(F.col("fold").isNotNull(), F.array(_seat(TRAIN, F.col("fold"))))
        .otherwise(F.array()),
        F.when(F.col("_wanted"), F.array(*[_seat(TARGET, F.lit(k)) for k in range(n_folds)]))
        .otherwise(F.array()),
    )
    return folds.select("card_no", "label", "fold").join(targets, "card_no", "full").select(
        "card_no", "label", "fold", seats.alias("seats"))


def whole_reference_roles(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Targets encoded once against the whole reference set, nothing left out."""
    targets = target.select("card_no", F.lit(True).alias("_wanted"))
    return reference.select("card_no", "label", F.lit(-1).alias("fold")).join(
        targets, "card_no", "full").select(
        "card_no", "label", "fold",
        F.when(F.col("_wanted"), F.array(_seat(TARGET, F.lit(0)))).otherwise(F.array()).alias("seats"))


def edges_with_roles(
    edges: DataFrame, roles: DataFrame, heavy_rows: int = skew.HEAVY_ROWS
) -> DataFrame:
    """Edges with the role of their card; cards in no set keep null roles and only count for degree.

    Written to the shared folder: key counts and encodings both start from it.
    """
    sizes = edges.groupBy("card_no").agg(F.count(F.lit(1)).alias("_edges"))
    lookup = roles.join(sizes, "card_no")
    joined = skew.spread_join(edges, lookup, ["card_no"], "_edges", ["key"], heavy_rows)
    return materialize(joined.drop("_edges"), "edges-with-roles")


def seated_edges(
    txn: DataFrame, key: str, roles: DataFrame, heavy_rows: int | None = None
) -> DataFrame:
    """The edges of a key column with the role of their card, straight from transactions.

    Rows of ordinary cards should lie bucketed by card: edges and roles then meet without moving the rows. With `heavy_rows`,
    cards may have more edges than one task takes, and the join is that of `edges_with_roles`.
    """
    made = edge_table(txn, key)
    if heavy_rows is None:
        return made.join(roles, "card_no", "left")
    return edges_with_roles(materialize(made, "edges"), roles, heavy_rows)


def key_label_counts(
    edges: DataFrame, variants: list[Variant], n_folds: int, limit: int, heavy: DataFrame | None = None
) -> DataFrame:
    """Per key: degree, and per variant the arrays nf[k], nc[k] counted without fold k.

    The counts are many and mostly small: narrow edges move, not wide partial counts, save for the `heavy` keys.
    """
    reference, positive = F.col("label").isNotNull(), F.coalesce(F.col("label") == 1, F.lit(False))
    counted = [v for v in variants if v.counts == v.name]
    measures = [F.count(F.lit(1)).alias("degree")]
    for v in counted:
        member = F.col(f"_{v.name}")
        for stat, who in (("nf", member & positive), ("nc", member & reference)):
            measures.append(F.count_if(who).alias(f"{v.name}_{stat}"))
            measures += [
                F.count_if(who & (F.col("fold") == k)).alias(f"{v.name}_{stat}_{k}")
                for k in range(n_folds)
            ]
    members = [v.flag(F.lit(0), limit).alias(f"_{v.name}") for v in counted]
    totals = skew.grouped(edges.select("key", "label", "fold", *members), "key", ["key"], measures, heavy)
    without = [
        F.array(*[F.col(f"{v.name}_{stat}") - F.col(f"{v.name}_{stat}_{k}") for k in range(n_folds)])
        .alias(f"{v.name}_{stat}")
        for v in counted for stat in ("nf", "nc")
    ]
    return totals.select("key", "degree", *without)


def exposure(
    edges: DataFrame,
    variants: list[Variant],
    n_folds: int = N_FOLDS,
    limit: int = LOW_DEGREE_LIMIT,
    heavy_rows: int = skew.HEAVY_ROWS,
    side: str | None = None,
) -> DataFrame:
    """(side, card_no, fold) with seven statistics per variant, from edges that carry roles.

    Statistics of a variant the card has no edge in are null; a card without an edge in any variant has no row.
    `side` limits the encodings to one side; label counts always come from all edges.
    """
    lookup = key_label_counts(edges, variants, n_folds, limit, _many_edges(edges, "key", heavy_rows))
    wanted = edges.drop("label", "fold")
    if side is not None:
        wanted = wanted.withColumn("seats", F.filter("seats", lambda seat: seat["side"] == side))
    wanted = wanted.filter(F.size("seats") > 0)
    seen = skew.spread_join(wanted, lookup, ["key"], "degree", ["card_no"], heavy_rows)
    seen = seen.filter(reduce(Column.__or__, [v.flag(F.col("degree"), limit) for v in variants]))
    # A card of several seats moves once with the counts of all folds; with one seat, only those of its fold move.
    pairs = list(dict.fromkeys(f"{v.counts}_{stat}" for v in variants for stat in ("nf", "nc")))
    single = F.size("seats") == 1
    own = F.array(*[F.element_at(c, F.get("seats", F.lit(0))["fold"] + 1) for c in pairs])
    counts = F.when(single, own).otherwise(F.flatten(F.array(*pairs))).cast("array<int>")
    columns, measures = {}, []
    for v in variants:
        member = F.col(f"_{v.name}")
        nf, nc = (F.element_at("_counts", F.col("_of") * pairs.index(f"{v.counts}_{stat}") + F.col("_at")).cast("long")
                  for stat in ("nf", "nc"))
        columns[f"_{v.name}_nf"] = F.when(member, nf)
        columns[f"_{v.name}_rate"] = F.when(member, nf / (nc + 1))
        columns[f"_{v.name}_n"] = F.when(member, F.col("n"))
        measures += _statistics(v)
    amounts = sorted({v.amount for v in variants})

    def prepared(rows: DataFrame) -> DataFrame:
        alone = F.size("_seats") == 1
        seated = rows.withColumn("_seat", F.explode("_seats")).withColumns({
            "side": F.when(F.col("_seat") % 2 == 1, TARGET).otherwise(TRAIN),
            "fold": F.floor(F.col("_seat") / 2).cast("int"),
            "_of": F.when(alone, 1).otherwise(n_folds)})
        seated = seated.withColumn("_at", F.when(alone, 1).otherwise(F.col("fold") + 1))
        return seated.select("side", "card_no", "fold", *amounts, *[c.alias(name) for name, c in columns.items()])

    seats = F.transform("seats", lambda seat: seat["fold"] * 2 + (seat["side"] == TARGET).cast("int"))
    members = [v.flag(F.col("degree"), limit).alias(f"_{v.name}") for v in variants]
    return skew.grouped(
        seen.select("card_no", "n", *amounts, *members, seats.alias("_seats"), counts.alias("_counts")), "card_no", ["side", "card_no", "fold"], measures,
        _many_edges(wanted, "card_no", heavy_rows), prepared)


def _many_edges(edges: DataFrame, column: str, heavy_rows: int) -> DataFrame:
    """The values of a column that more than `heavy_rows` edges have."""
    sizes = materialize(edges.groupBy(column).agg(F.count(F.lit(1)).alias("_edges")), "edge-counts")
    return skew.heavy_keys(sizes, [column], "_edges", heavy_rows).select(column)


def _statistics(v: Variant) -> list[Column]:
    nf, rate, n = (F.col(f"_{v.name}_{part}") for part in ("nf", "rate", "n"))
    any_edge = F.count(n) > 0
    linked = nf >= 1
    present = lambda c: F.when(any_edge, c)
    return [
        F.max(nf).alias(f"{v.name}_nf_max"),
        present(F.count_if(linked)).alias(f"{v.name}_ncp_f1"),
        present(F.count_if(nf >= 2)).alias(f"{v.name}_ncp_f2"),
        F.max(rate).alias(f"{v.name}_rate_max"),
        safe_div(F.sum(rate * n), F.sum(n)).alias(f"{v.name}_rate_wavg"),
        present(sum0(F.when(linked, F.col(v.amount)))).alias(f"{v.name}_amt_f"),
        present(safe_div(sum0(F.when(linked, n)), F.sum(n))).alias(f"{v.name}_txnf_share"),
    ]


def exposure_all(
    account_edges: DataFrame,
    name_edges: DataFrame,
    account_kinds: list[Variant],
    name_kinds: list[Variant],
    n_folds: int = N_FOLDS,
    account_limit: int = LOW_DEGREE_LIMIT,
    name_limit: int = LOW_DEGREE_LIMIT,
    heavy_rows: int = skew.HEAVY_ROWS,
    side: str | None = None,
) -> DataFrame:
    """All variants side by side."""
    by_account = exposure(account_edges, account_kinds, n_folds, account_limit, heavy_rows, side)
    by_name = exposure(name_edges, name_kinds, n_folds, name_limit, heavy_rows, side)
    return by_account.join(by_name, ["side", "card_no", "fold"], "full")
