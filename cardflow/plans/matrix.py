"""Feature matrix: all blocks joined on the card, in a fixed column order."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow import constants as K
from cardflow.functions.exprs import finite_or_null, safe_div
from cardflow.operators import (
    accounts, codes, counterparty, daily, edges, exposure, flow, sequence, silence, skew, static,
)
from cardflow.operators.timeline import ROWS_PER_TASK, card_rows, enrich, heavy_cards, total_rows
from cardflow.plans.adapter import CardData
from cardflow.sources.store import bucket_count, materialize, materialize_by_key


@dataclass(frozen=True)
class Settings:
    """Parameters that depend on the data rather than on the method.

    Code lists left at None are read off the data.
    """

    channel_codes: list[str] = field(default_factory=lambda: list(K.CHANNEL_CODES))
    summary_codes: list[str] | None = None
    more_summary_codes: list[str] | None = None
    more_channel_codes: list[str] | None = None
    coverage_floor: int = K.COVERAGE_FLOOR
    account_degree_limit: int = K.LOW_DEGREE_LIMIT
    name_degree_limit: int = K.LOW_DEGREE_LIMIT
    n_folds: int = K.N_FOLDS
    heavy_rows: int = skew.HEAVY_ROWS
    # Last day of the data that silence is counted to; read off the data unless given.
    anchor: datetime.date | None = None


@dataclass(frozen=True)
class Part:
    """Rows and summaries of one kind of cards: the ordinary ones, bucketed by card, or the heavy ones."""

    enriched: DataFrame
    pairs: DataFrame
    days: DataFrame
    heavy: DataFrame  # the cards among them that no single task takes


def together(frames: list[DataFrame]) -> DataFrame:
    """Frames over different cards as one; a single frame keeps its partitioning."""
    return reduce(DataFrame.unionByName, frames)


def _join_blocks(blocks: list[DataFrame]) -> DataFrame:
    """All blocks are grouped by card, hence partitioned alike: the joins shuffle nothing again."""
    return reduce(lambda left, right: left.join(right, "card_no", "left"), blocks)


def code_lists(channel: DataFrame, summary: DataFrame, settings: Settings) -> dict[str, list[str]]:
    """The three open code lists of the settings; those left at None are read off the counts."""
    top = settings.summary_codes
    if top is None:
        top = codes.code_list(codes.top_codes(summary, K.TOP_SUMMARY_CODES))
    more_summary = settings.more_summary_codes
    if more_summary is None:
        more_summary = codes.code_list(codes.covered_codes(
            summary, settings.coverage_floor, K.MAX_SUMMARY_CODES, top))
    more_channel = settings.more_channel_codes
    if more_channel is None:
        more_channel = codes.code_list(codes.covered_codes(
            channel, settings.coverage_floor, K.MAX_CHANNEL_CODES, settings.channel_codes))
    return {"summary_codes": top, "more_summary_codes": more_summary, "more_channel_codes": more_channel}


def _code_names(channel: DataFrame, summary: DataFrame, settings: Settings) -> tuple[dict, dict]:
    """Share columns per code for channels and summary codes."""
    lists = code_lists(channel, summary, settings)
    channel_names = {c: f"ch{c}_share" for c in settings.channel_codes}
    channel_names |= {c: f"ch2_{c}" for c in lists["more_channel_codes"]}
    summary_names = {c: f"smy_{c}_share" for c in lists["summary_codes"]}
    return channel_names, summary_names | {c: f"smy2_{c}" for c in lists["more_summary_codes"]}


def card_ratios(features: DataFrame) -> DataFrame:
    """Ratios between columns of different blocks."""
    c = F.col
    return features.withColumns({
        "out_ratio": safe_div(c("out_sum"), c("in_sum") + c("out_sum") + 1),
        "net_flow": c("in_sum") - c("out_sum"),
        "txn_per_day": safe_div(c("n_txn"), c("n_days")),
        "bal_drain": safe_div(c("bal_last"), c("bal_max") + 1),
        "cntrprt_per_txn": safe_div(c("n_cntrprt"), c("n_txn")),
        "w7_txn_share": safe_div(c("n_txn_w7"), c("n_txn")),
        "w1_txn_share": safe_div(c("n_txn_w1"), c("n_txn")),
        "turnover_rate": safe_div(c("out_sum"), c("bal_max") + 1),
        "in_w1_concentration": safe_div(c("in_sum_w1"), c("in_sum") + 1),
        "d0_out_in_ratio": safe_div(c("d0_out_sum"), c("d0_in_sum") + 1),
        "last5_drain_ratio": safe_div(c("last5_out_sum"), c("in_sum") + 1),
        "lastin_vs_balmax": safe_div(c("last_in_amt"), c("bal_max") + 1),
        "afterin_drain": safe_div(c("afterin_out_sum"), c("last_in_amt") + 1),
        "trailing_out_ratio": safe_div(c("trailing_outs"), c("n_txn") + 1),
        "h24_out_concentration": safe_div(c("h24_out_sum"), c("out_sum") + 1),
        "h1_txn_share": safe_div(c("h1_n"), c("n_txn") + 1),
    })


RATIOS = [
    "out_ratio", "net_flow", "txn_per_day", "bal_drain", "cntrprt_per_txn", "w7_txn_share",
    "w1_txn_share", "turnover_rate", "in_w1_concentration", "d0_out_in_ratio", "last5_drain_ratio",
    "lastin_vs_balmax", "afterin_drain", "trailing_out_ratio", "h24_out_concentration", "h1_txn_share",
]


def inflow_over_held() -> Column:
    return safe_div(F.col("in_sum"), F.abs("mo_da_aum_val") + 100)


def wealth_ratios(df: DataFrame) -> DataFrame:
    """Flows and balances against the assets the customer holds."""
    c = F.col
    held, held_now = F.abs(c("mo_da_aum_val")) + 100, F.abs(c("aum_val")) + 100
    return df.withColumns({
        "in_vs_aum": inflow_over_held(),
        "bal_vs_aum": safe_div(c("bal_last"), held),
        "inmax_vs_aum": safe_div(c("in_max2"), held_now),
        "in_retention": safe_div(c("bal_last"), c("in_sum") + 1),
        "sender_per_in": safe_div(c("n_in_senders"), c("n_in") + 1),
    })


def card_features(data: CardData, parts: list[Part], settings: Settings) -> DataFrame:
    """The behaviour and static columns of every card with transactions (299 on the full code lists).

    Blocks of a card's own rows are made part by part. What looks at other cards, such as degrees, reads
    the summaries of all parts.
    """
    heavy = settings.heavy_rows
    enriched, pairs = together([p.enriched for p in parts]), together([p.pairs for p in parts])
    names = _code_names(
        codes.code_counts(enriched, "txn_channel_type"), codes.code_counts(enriched, "smy_cd"), settings)
    own = together([own_blocks(part, *names) for part in parts])
    return card_ratios(_join_blocks([
        own,
        counterparty.counterparty_degree(pairs, heavy),
        static.static_profile(enriched, data.card, data.cst, data.accno, heavy),
        static.frequency_encoding(data.card, data.cst, heavy_rows=heavy),
    ]))


def own_blocks(part: Part, channel_names: dict[str, str], summary_names: dict[str, str]) -> DataFrame:
    """What a card's own rows say.

    Blocks over the same input share one aggregation, kept below the width at which Spark gives up
    code generation (spark.sql.codegen.maxFields, 100 by default).
    """
    by_card = lambda df, *measures: df.groupBy("card_no").agg(*measures)
    enriched, pairs, days = part.enriched, part.pairs, part.days
    channel = codes.code_counts(enriched, "txn_channel_type")
    summary = codes.code_counts(enriched, "smy_cd")
    return _join_blocks([
        by_card(
            enriched,
            *flow.flow_measures(),
            *flow.balance_measures(),
            *flow.mix_measures(), *flow.amount_measures(), *flow.calendar_measures(),
        ),
        by_card(
            enriched,
            *sequence.flip_measures(),
            *sequence.last_row_measures(), *sequence.last_k_measures(),
            *sequence.balance_path_measures(),
        ),
        sequence.gap_stats(enriched),
        sequence.fast_in_out(enriched),
        by_card(
            pairs,
            *counterparty.party_count_measures(), *counterparty.top_party_measures(),
            *counterparty.after_inflow_measures(), *counterparty.first_contact_measures(),
            *counterparty.inflow_concentration_measures(), *counterparty.second_lookback_measures(),
        ),
        by_card(
            days,
            codes.distinct_measure("n_days"), *daily.lookback_measures(),
            *daily.last_day_measures(), *daily.peak_measures(), *daily.spread_measures(),
        ),
        by_card(
            daily.hour_counts(enriched),
            codes.distinct_measure("n_hours"), codes.entropy_measure("hour_entropy"),
            daily.busiest_hour(),
        ),
        by_card(
            channel, codes.distinct_measure("n_channel"), codes.entropy_measure("channel_entropy"),
            *codes.share_measures(channel_names)),
        by_card(summary, codes.distinct_measure("n_smy"), *codes.share_measures(summary_names)),
        flow.distinct_per_card(enriched, "cst_accno", "n_accno_used"),
        flow.amount_repetition(enriched),
    ])


def inflow_features(parts: list[Part], heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    degrees = counterparty.sender_degree(together([p.enriched for p in parts]), heavy_rows)
    detail = together([counterparty.inflow_detail(p.pairs, p.enriched) for p in parts])
    return degrees.join(detail, "card_no", "full")


def silence_features(base: DataFrame) -> DataFrame:
    """The silence columns under their matrix names."""
    joined = base.join(silence.silence_interactions(base), "card_no").join(
        silence.silence_percentiles(base), "card_no", "left")
    return joined.select("card_no", *[F.col(c).alias(f"S_{c}") for c in K.SILENCE_COLUMNS])


def role_edges(parts: list[DataFrame], roles: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> list[DataFrame]:
    """Account and name edges with roles, written once. The first part has the ordinary cards, bucketed by card, the
    second, if any, the heavy ones."""
    return [
        materialize(together([
            exposure.seated_edges(rows, key, roles, heavy_rows if k else None) for k, rows in enumerate(parts)
        ]), "edges-with-roles")
        for key in ("cntrprt_card_no", "cntrprt_name")]


def exposure_features(
    parts: list[DataFrame], roles: DataFrame, settings: Settings, side: str | None = None,
) -> DataFrame:
    """(side, card_no, fold) exposure of train cards (own fold left out) and target cards (per fold)."""
    heavy = settings.heavy_rows
    return exposure.exposure_all(
        *role_edges(parts, materialize(roles, "roles"), heavy),
        edges.account_variants(), edges.name_variants(), settings.n_folds,
        settings.account_degree_limit, settings.name_degree_limit, heavy, side)


def exposure_columns() -> list[str]:
    return [f"{v}_{s}" for v in K.ACCOUNT_VARIANTS + K.NAME_VARIANTS for s in K.EXPOSURE_STATS]


@dataclass(frozen=True)
class Matrix:
    """Rows keyed (side, card_no, fold) with label; `columns` pins the feature order."""

    rows: DataFrame
    columns: list[str]

    def train(self) -> DataFrame:
        return self.rows.filter(F.col("side") == exposure.TRAIN)

    def target(self) -> DataFrame:
        return self.rows.filter(F.col("side") == exposure.TARGET)


def _finite_floats(df: DataFrame, keys: list[str], columns: list[str], kind: str) -> DataFrame:
    return df.select(*keys, *[
        finite_or_null(F.col(c).cast("double")).cast(kind).alias(c) for c in columns])


def assemble_matrix(
    folds: DataFrame, target: DataFrame, features: DataFrame, encoded: DataFrame,
    inflow: DataFrame, quiet: DataFrame, account: DataFrame | None, settings: Settings,
    kind: str = "float",
) -> Matrix:
    """One long matrix: train cards once, target cards once per fold.

    Cards without transactions stay, with null features and zero exposure. Train and target share
    one column list by construction.
    """
    train_keys = folds.select(
        F.lit(exposure.TRAIN).alias("side"), "card_no", F.col("fold").cast("int"), "label")
    target_keys = target.select(
        F.lit(exposure.TARGET).alias("side"), "card_no",
        F.explode(F.sequence(F.lit(0), F.lit(settings.n_folds - 1))).alias("fold"),
        F.lit(None).cast("byte").alias("label"))
    keys = train_keys.unionByName(target_keys)
    # What belongs to the card is joined and made finite once per card, not once per fold copy.
    blocks = [features, inflow, quiet] + ([] if account is None else [account])
    own = [c for c in features.columns if c != "card_no"]
    tail = [c for c in inflow.columns if c != "card_no"] + K.WEALTH_COLUMNS + [f"S_{c}" for c in K.SILENCE_COLUMNS]
    tail += [] if account is None else K.ACCOUNT_COLUMNS
    cards = _finite_floats(wealth_ratios(_join_blocks(blocks)), ["card_no"], own + tail, kind)
    wide = keys.join(encoded, ["side", "card_no", "fold"], "left").fillna(0, exposure_columns())
    exposed = _finite_floats(wide, ["side", "card_no", "fold", "label"], exposure_columns(), kind)
    columns = own + exposure_columns() + tail
    return Matrix(
        exposed.join(cards, "card_no", "left").select("side", "card_no", "fold", "label", *columns), columns)


def build_matrix(
    data: CardData, folds: DataFrame, settings: Settings = Settings(), kind: str = "float"
) -> Matrix:
    """Whole plan from tables to matrix.

    Inputs read by many blocks are written to the shared folder once: the enriched rows, the
    (card, counterparty) and (card, day) summaries, the edges and the finished blocks. The rows of
    ordinary cards are bucketed by card, and the summaries and blocks built on them shuffle nothing. Cards
    too heavy for one task are kept beside them in tables of their own, in time slices.
    """
    heavy = settings.heavy_rows
    per_card = card_rows(data.txn)
    rows = total_rows(per_card)
    buckets = buckets_of(data.txn.sparkSession, rows)
    by_card = lambda df, name: materialize_by_key(df, name, "card_no", buckets)
    parts = card_parts(data.txn, heavy_cards(per_card, heavy, "_rows"), by_card, tasks_of_buckets(rows, buckets))
    anchor = settings.anchor or silence.anchor_date(together([p.enriched for p in parts])).first()[0]
    quiet_base = by_card(together([silence.silence_base(p.enriched, anchor) for p in parts]), "silence")
    account = together([accounts.account_features(p.enriched, data.card, p.heavy) for p in parts])
    folds = materialize(folds, "folds")
    roles = exposure.fold_matched_roles(folds, data.target, settings.n_folds)
    return assemble_matrix(
        folds, data.target,
        by_card(card_features(data, parts, settings), "features"),
        materialize(exposure_features([p.enriched for p in parts], roles, settings), "exposure"),
        by_card(inflow_features(parts, heavy), "inflow"),
        by_card(silence_features(quiet_base), "silence_features"),
        by_card(account, "account"),
        settings, kind)


def buckets_of(spark: SparkSession, rows: int) -> int:
    """Buckets for `rows` rows and what is summed up from them: one task reads a bucket whatever the number of shuffle
    partitions, so beyond ROWS_PER_TASK rows a bucket their number follows the rows."""
    buckets = bucket_count(spark, rows)
    while rows > ROWS_PER_TASK * buckets:
        buckets *= 2
    return buckets


def tasks_of_buckets(rows: int, buckets: int) -> int:
    """Tasks that `rows` rows need, as a multiple of the buckets, so that each task writes into one."""
    return buckets * max(1, -(-rows // (ROWS_PER_TASK * buckets)))


def enriched_parts(
    txn: DataFrame, busy: DataFrame, by_card: Callable[[DataFrame, str], DataFrame], tasks: int | None = None,
    columns: list[str] | None = None, condition: str = "true",
) -> list[tuple[DataFrame, DataFrame]]:
    """Enriched rows of the ordinary cards, written with `by_card`, and of the `busy` cards if there are any, each with
    the heavy cards among them. Only `columns` of the rows that meet the condition are written."""
    none, hot = busy.limit(0), F.broadcast(busy)
    some = not busy.isEmpty()
    groups = [(txn.join(hot, "card_no", "left_anti") if some else txn, none, by_card)]
    if some:
        groups.append((txn.join(hot, "card_no", "left_semi"), busy, materialize))
    parts = []
    for rows, heavy, write in groups:
        enriched = enrich(rows, heavy, tasks=tasks).filter(condition)
        parts.append((write(enriched.select(*columns) if columns else enriched, "enriched"), heavy))
    return parts


def card_parts(
    txn: DataFrame, busy: DataFrame, by_card: Callable[[DataFrame, str], DataFrame], tasks: int | None = None,
) -> list[Part]:
    """Ordinary cards, written with `by_card`, and the `busy` cards if there are any."""
    parts = []
    for enriched, heavy in enriched_parts(txn, busy, by_card, tasks):
        write = by_card if not parts else materialize
        parts.append(Part(
            enriched, write(counterparty.pair_summary(enriched), "pairs"), write(daily.daily(enriched), "days"), heavy))
    return parts


def coverage_report(data: CardData) -> DataFrame:
    """One row: cards, train and target cards without transactions, label rate, date range."""
    seen = data.txn.select("card_no").distinct()
    unseen = lambda cards: cards.join(seen, "card_no", "left_anti").agg(
        F.count(F.lit(1))).scalar()
    last = data.txn.groupBy("card_no").agg(F.max("stm_dt").alias("last_dt"))
    return last.agg(
        F.count(F.lit(1)).alias("n_cards"),
        F.min("last_dt").alias("first_last_dt"),
        F.max("last_dt").alias("last_last_dt"),
    ).withColumns({
        "train_without_txn": unseen(data.train),
        "target_without_txn": unseen(data.target),
        "label_rate": data.train.agg(F.avg("label")).scalar(),
    })


def uncovered_cards(data: CardData) -> DataFrame:
    """Train and target cards without any transaction."""
    listed = data.train.select(F.lit("train").alias("side"), "card_no").unionByName(
        data.target.select(F.lit("target").alias("side"), "card_no"))
    seen = data.txn.select("card_no").distinct()
    return listed.join(seen, "card_no", "left_anti").select("side", "card_no")


def class_means(rows: DataFrame, column: str = "in_vs_aum") -> DataFrame:
    """Mean of one feature per label, a check that the ratio uses the right denominator."""
    return rows.groupBy("label").agg(F.avg(F.col(column).cast("double")).alias(f"mean_{column}"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when a one-to-one join is safe."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
