"""Silence: how long a card has been quiet at the end of the data, and how that relates to activity."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import SILENCE_BINS, SILENCE_CAP_DAYS
from cardflow.functions.exprs import at_least_zero, iso_weekday, safe_div, seconds_between, sum0
from cardflow.operators import skew
from cardflow.operators.ranks import average_rank_share, quantiles
from cardflow.operators.timeline import event_position
from cardflow.sources.store import materialize

DAY = 86400
BACK_DAYS = (1, 3, 7)


def anchor_date(txn: DataFrame) -> DataFrame:
    """One row: the last transaction date of the whole data."""
    return txn.agg(F.max(F.to_date("tms")).alias("anchor_date"))


def silence_base(enriched: DataFrame, anchor: datetime.date | None = None) -> DataFrame:
    """Silence measures and their helpers per card. The anchor is read off the data unless given."""
    back, at_end = F.col("sec_before"), F.col("rn_end") == 0
    per_card = enriched.groupBy("card_no").agg(
        F.count(F.lit(1)).alias("n_txn"),
        *_whole_measures(),
        *_back_measures(back),
        F.max(F.when(at_end, F.col("acct_bal"))).alias("bal_last"),
        F.max(F.when(at_end, F.col("inflow_amt"))).alias("end_in"),
    )
    return _silence(per_card, F.lit(anchor) if anchor else anchor_date(enriched).scalar())


def silence_of_rows(
    txn: DataFrame, anchor: datetime.date | None = None, heavy_rows: int = skew.HEAVY_ROWS
) -> DataFrame:
    """As `silence_base`, from transactions that are not enriched: nothing is sorted in time.

    What the ends of the cards say is one aggregation; only the card and the time of the rows are joined to it, to count
    the look-backs. Both keep heavy cards out of single tasks.
    """
    end = F.max_by(F.struct("acct_bal", "inflow_amt"), event_position())
    # Rows without a card are one card, as in any grouping: hence a key without nulls.
    keyed = txn.withColumns({"_known": F.col("card_no").isNotNull(), "_card": F.coalesce("card_no", F.lit(""))})
    ends = materialize(keyed.groupBy("_card", "_known").agg(
        F.count(F.lit(1)).alias("n_txn"), *_whole_measures(), end.alias("_end")), "card-ends")
    keys, weights = ["_card", "_known"], ends.select("_card", "_known", "n_txn")
    timed = skew.spread_join(
        keyed.select(*keys, "tms"), ends.select(*keys, "last_tms"), keys, "n_txn", ["tms"], heavy_rows, weights)
    counts = timed.groupBy(*keys).agg(*_back_measures(seconds_between(F.col("tms"), F.col("last_tms"))))
    per_card = ends.join(counts, keys).select(
        F.when(F.col("_known"), F.col("_card")).alias("card_no"), "*",
        F.col("_end.acct_bal").alias("bal_last"), F.col("_end.inflow_amt").alias("end_in"))
    last_day = ends.agg(F.max(F.to_date("last_tms")))
    return _silence(per_card, F.lit(anchor) if anchor else last_day.scalar())


def _whole_measures() -> list[Column]:
    return [
        F.max("tms").alias("last_tms"),
        F.min("tms").alias("first_tms"),
        sum0(F.col("inflow_amt")).alias("in_sum"),
        sum0(F.col("outflow_amt")).alias("out_sum"),
    ]


def _back_measures(back: Column) -> list[Column]:
    return [F.count_if(back <= days * DAY).alias(f"n_t{days}") for days in BACK_DAYS]


def _silence(per_card: DataFrame, anchor_day: Column) -> DataFrame:
    dated = per_card.withColumn("anchor", anchor_day)
    last, hour = F.col("last_tms"), F.hour("last_tms")
    silent = F.date_diff("anchor", F.to_date(last))
    day_end = F.date_add("anchor", 1).cast("timestamp_ntz")
    return dated.select(
        "card_no",
        silent.alias("sil_days"),
        (seconds_between(last, day_end) / 3600.0).alias("sil_hours"),
        (silent >= SILENCE_CAP_DAYS).cast("byte").alias("sil_beyond_norm"),
        F.date_diff("anchor", F.to_date("first_tms")).alias("first_sil_days"),
        hour.alias("last_hour"),
        iso_weekday(last).alias("last_wd"),
        hour.between(9, 16).cast("byte").alias("last_is_bizhour"),
        (hour <= 2).cast("byte").alias("last_is_deepnight"),
        "n_txn", "in_sum", "out_sum", "bal_last",
        F.date_diff(F.to_date(last), F.to_date("first_tms")).alias("span_days"),
        "n_t1", "n_t3", "n_t7",
        (F.col("end_in") > 0).cast("byte").alias("last_is_in"),
    )


def silence_interactions(base: DataFrame) -> DataFrame:
    """Activity times silence."""
    s, n, span = F.col("sil_days"), F.col("n_txn"), F.col("span_days")
    paid_in = F.col("in_sum")
    net = at_least_zero(paid_in - F.col("out_sum"))
    logged = lambda x: F.log1p(x) * s
    measures: dict[str, Column] = {
        "ntxn_x_sil": logged(n),
        "ntxn_div_sil": safe_div(n, s + 1),
        "insum_x_sil": logged(at_least_zero(paid_in)),
        "bal_x_sil": logged(at_least_zero(F.col("bal_last"))),
        "t1share_x_sil": safe_div(F.col("n_t1"), n) * s,
        "t3share_x_sil": safe_div(F.col("n_t3"), n) * s,
        "netflow_x_sil": logged(net),
        "retention_x_sil": safe_div(net, paid_in + 1) * s,
        "txnrate_x_sil": safe_div(n, span + 1) * s,
        "sil_div_span": safe_div(s, span + 1),
    }
    return base.select("card_no", *[c.alias(name) for name, c in measures.items()])


def with_quantile_bin(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Adds the right-closed quantile bin of `value`; equal edges merge, as only the grouping matters."""
    edges = F.lit(quantiles(df, value, [i / bins for i in range(bins + 1)])).cast("array<double>")
    below = F.size(F.filter(edges, lambda edge: edge < F.col(value).cast("double")))
    return df.withColumn(name, F.greatest(below, F.lit(1)))


def silence_percentiles(base: DataFrame, parts: int | None = None) -> DataFrame:
    """Percentile of silence among cards of like activity, and of activity among like silence.

    The four rankings go through one long table, ranked by (measure, bin).
    """
    binned = with_quantile_bin(base, "n_txn", SILENCE_BINS, "activity_bin").withColumn(
        "silence_bin", F.least("sil_days", F.lit(SILENCE_CAP_DAYS)))
    wanted = {
        "sil_pct_in_ntxn_bin": ("activity_bin", "sil_days"),
        "ntxn_pct_in_sil_bin": ("silence_bin", "n_txn"),
        "bal_pct_in_sil_bin": ("silence_bin", "bal_last"),
        "insum_pct_in_sil_bin": ("silence_bin", "in_sum"),
    }
    entries = F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(group).cast("int").alias("bin"),
                 F.col(value).cast("double").alias("value"))
        for name, (group, value) in wanted.items()
    ])
    long = binned.select("card_no", F.explode(entries).alias("e")).select(
        "card_no", "e.measure", "e.bin", "e.value")
    ranked = average_rank_share(long, "value", "pct", ["measure", "bin"], ["card_no"], parts)
    return ranked.groupBy("card_no").agg(*[
        F.max(F.when(F.col("measure") == name, F.col("pct"))).alias(name) for name in wanted
    ])
