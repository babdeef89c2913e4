"""Features of a card's counterparties, from one (card, counterparty) summary.

Counting counterparties under many conditions (last hour, last day, after the last inflow ..)
would take one distinct aggregate each. Grouping on (card, counterparty) once turns all of them into
plain counts over the summary, spreads a busy card over many tasks and shuffles combined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import INTERBANK, LAST_ROW_CHANNELS, SECOND_LOOKBACKS
from cardflow.functions.exprs import count0, safe_div, seconds_between, sum0, sum_where
from cardflow.operators import skew
from cardflow.operators.sequence import LAST_K_PARTIES
from cardflow.operators.timeline import with_directions
from cardflow.sources.store import materialize


def _known():
    return F.col("cntrprt_card_no").isNotNull()


def pair_summary(enriched: DataFrame) -> DataFrame:
    """Every decomposable measure per (card, counterparty); unused ones are pruned by the plan.

    All buffers are numbers, so the plan hash-aggregates. Values of one particular row (the last
    one, the last inflow) are picked by its flag rather than by an ordered maximum.
    """
    is_in, is_out, amount = F.col("is_in"), F.col("is_out"), F.col("inflow_amt")
    private, clearing = F.col("cntrprt_prvt_ind"), F.col("cntrprt_clear_type")
    last_day, after = F.col("days_before") == 0, F.col("after_last_in")
    at_end = lambda c: F.max(F.when(F.col("rn_end") == 0, c.cast("byte")))
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.min("rn_end").alias("rn"),
        # first contact and last day
        F.max("days_before").alias("first_days"),
        F.count_if(last_day & is_out).alias("d0_out_n"),
        sum_where(last_day & is_out, F.col("outflow_amt")).alias("d0_out_sum"),
        at_end(clearing == INTERBANK).alias("end_interbank"),
        *[at_end(F.col("txn_channel_type") == c).alias(f"end_{c}") for c in LAST_ROW_CHANNELS],
        # last inflow and what follows
        F.max(F.when(F.col("is_last_in"), amount)).alias("last_in"),
        F.min(F.when(is_in, F.col("rn_end"))).alias("in_rn"),
        F.min(F.when(is_in, F.col("days_before"))).alias("in_days"),
        F.min(F.when(is_in, F.col("sec_before"))).alias("in_sec"),
        F.count_if(after).alias("after_n"),
        sum_where(after, F.col("outflow_amt")).alias("after_out"),
        F.min(F.when(after, F.col("tms"))).alias("after_from"),
        F.max(F.when(after, F.col("tms"))).alias("after_to"),
        # inflow
        F.count_if(is_in).alias("in_n"),
        sum_where(is_in, amount).alias("in_paid"),
        F.max(F.when(is_in, amount)).alias("in_max"),
        F.count_if(is_in & (private == 1)).alias("in_private_n"),
        F.count_if(is_in & (F.col("hour") < 6)).alias("in_night_n"),
        F.count(F.when(is_in, F.col("hour"))).alias("in_hour_n"),
        F.count_if(is_in & (amount % 1000 == 0)).alias("in_round_n"),
        F.count_if(is_in & (clearing == INTERBANK)).alias("in_interbank_n"),
        F.count(F.when(is_in, clearing)).alias("in_clear_n"),
    ]
    for tag, seconds in SECOND_LOOKBACKS.items():
        recent = F.col("sec_before") < seconds
        measures += [
            F.count_if(recent).alias(f"{tag}_n"),
            sum_where(recent, F.col("outflow_amt")).alias(f"{tag}_out_sum"),
            sum_where(recent, amount).alias(f"{tag}_in_sum"),
            sum_where(recent, private).alias(f"{tag}_private"),
            F.count(F.when(recent, private)).alias(f"{tag}_private_n"),
            F.count_if(recent & (clearing == INTERBANK)).alias(f"{tag}_interbank_n"),
            F.count(F.when(recent, clearing)).alias(f"{tag}_clear_n"),
        ]
    return enriched.groupBy("card_no", "cntrprt_card_no").agg(*measures)


def party_count_measures() -> list[Column]:
    """Counterparties of the whole history and of the last rows, unknown counted as one."""
    recent = [
        F.count_if(F.col("rn") < k).alias(name) for name, k in LAST_K_PARTIES.items()
    ]
    return [F.count(F.lit(1)).alias("n_cntrprt"), *recent]


def top_party_measures() -> list[Column]:
    n = F.when(_known(), F.col("n"))
    return [
        F.max(n).alias("cp_top1_cnt"),
        F.sum(n).alias("cp_cnt_total"),
        safe_div(F.max(n), F.sum(n)).alias("cp_top1_share"),
    ]


def second_lookback_measures() -> list[Column]:
    measures = []
    for tag in SECOND_LOOKBACKS:
        measures += [
            F.sum(f"{tag}_n").alias(f"{tag}_n"),
            F.sum(f"{tag}_out_sum").alias(f"{tag}_out_sum"),
            F.sum(f"{tag}_in_sum").alias(f"{tag}_in_sum"),
            F.count_if(F.col(f"{tag}_n") > 0).alias(f"{tag}_n_cp"),
            safe_div(F.sum(f"{tag}_private"), F.sum(f"{tag}_private_n")).alias(f"{tag}_prvt"),
            safe_div(F.sum(f"{tag}_interbank_n"), F.sum(f"{tag}_clear_n")).alias(f"{tag}_interbank"),
        ]
    return measures


def after_inflow_measures() -> list[Column]:
    """Last inflow and the rows behind it. Null without inflow; sums null when nothing follows."""
    followed = F.sum("after_n") > 0
    return [
        F.min("in_rn").alias("trailing_outs"),
        F.max("last_in").alias("last_in_amt"),
        F.min("in_days").alias("last_in_days_before"),
        F.min("in_sec").alias("sec_lastin_to_end"),
        F.when(followed, F.sum("after_out")).alias("afterin_out_sum"),
        F.when(followed, F.count_if(F.col("after_n") > 0)).alias("afterin_n_cntrprt"),
        seconds_between(F.min("after_from"), F.max("after_to")).alias("afterin_span_sec"),
    ]


def first_contact_measures() -> list[Column]:
    """Is the last counterparty new, how was it reached, and last-day outflow to new ones."""
    new = F.col("first_days") == 0
    known_new = _known() & new
    d0_rows = F.sum(F.when(_known(), F.col("d0_out_n")))
    return [
        F.max("end_interbank").alias("last_interbank"),
        F.max(F.when(_known() & (F.col("rn") == 0), new.cast("byte"))).alias("last_cp_is_new"),
        *[F.max(f"end_{c}").alias(f"last_ch_{c}") for c in LAST_ROW_CHANNELS],
        safe_div(count0(F.when(known_new, F.col("d0_out_n"))), d0_rows).alias("d0_newcp_share"),
        F.when(d0_rows > 0, sum_where(known_new, F.col("d0_out_sum"))).alias("d0_newcp_out_sum"),
    ]


def inflow_concentration_measures() -> list[Column]:
    """Null for cards without an inflow from a known counterparty."""
    sender = _known() & (F.col("in_n") > 0)
    paid = F.when(sender, F.col("in_paid"))
    return [
        F.when(F.count_if(sender) > 0, F.count_if(sender)).alias("n_in_cp"),
        safe_div(F.max(paid), F.sum(paid) + 1).alias("in_cp_top1_share"),
    ]


def inflow_measures() -> list[Column]:
    """Senders and shape of inflow, over pairs that have any."""
    return [
        F.count_if(F.col("in_private_n") > 0).alias("n_in_prvt_senders"),
        F.count(F.lit(1)).alias("n_in_senders"),
        safe_div(F.sum("in_night_n"), F.sum("in_hour_n")).alias("in_night_share"),
        F.max("in_max").alias("in_max2"),
        safe_div(F.sum("in_round_n"), F.sum("in_n")).alias("in_round1k_share"),
        safe_div(F.sum("in_interbank_n"), F.sum("in_clear_n")).alias("in_interbank_share"),
    ]


def top_counterparty(pairs: DataFrame) -> DataFrame:
    return pairs.filter(_known()).groupBy("card_no").agg(*top_party_measures())


def second_lookbacks(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("card_no").agg(*second_lookback_measures())


def after_last_inflow(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("card_no").agg(*after_inflow_measures())


def first_contact(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("card_no").agg(*first_contact_measures())


def inflow_concentration(pairs: DataFrame) -> DataFrame:
    return pairs.filter(_known() & (F.col("in_n") > 0)).groupBy("card_no").agg(
        *inflow_concentration_measures())


def inflow_detail(pairs: DataFrame, enriched: DataFrame) -> DataFrame:
    """Inflow block of the cards that have inflow.

    The largest inflow and its distance from the end come from (card, amount) groups: the amount is
    unique there, so the latest row of the largest amount needs no ordered maximum.
    """
    latest = enriched.filter("is_in").groupBy("card_no", "inflow_amt").agg(
        F.min("sec_before").alias("sec"))
    largest = latest.groupBy("card_no").agg(F.max_by("sec", "inflow_amt").alias("sec_maxin_to_end"))
    block = pairs.filter(F.col("in_n") > 0).groupBy("card_no").agg(*inflow_measures())
    return block.join(largest, "card_no", "left")


def _graded_pairs(txn: DataFrame, heavy_rows: int) -> DataFrame:
    """Distinct (card, counterparty) with the counterparty's degree and whether it is a card itself.

    `txn` may be the pair summary: it names the same pairs and cards in fewer rows.
    """
    # Read for the degrees and for the join.
    pairs = materialize(txn.filter(_known()).select("card_no", "cntrprt_card_no").distinct(), "card-pairs")
    cards = txn.select(F.col("card_no").alias("cntrprt_card_no")).distinct().withColumn(
        "is_sample", F.lit(1))
    degrees = pairs.groupBy("cntrprt_card_no").agg(F.count(F.lit(1)).alias("degree"))
    lookup = degrees.join(cards, "cntrprt_card_no", "left").fillna(0, ["is_sample"])
    return skew.spread_join(
        pairs, lookup, ["cntrprt_card_no"], "degree", ["card_no"], heavy_rows)


def counterparty_degree(txn: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    return _graded_pairs(txn, heavy_rows).groupBy("card_no").agg(
        F.max("degree").alias("cpdeg_max"),
        F.avg("degree").alias("cpdeg_mean"),
        F.avg((F.col("degree") >= 5).cast("double")).alias("cpdeg_hub_share"),
        F.avg("is_sample").alias("cp_is_sample_share"),
    )


def sample_pair_share(txn: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """Share of all pairs whose counterparty is itself a card of the data."""
    return _graded_pairs(txn, heavy_rows).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("is_sample").alias("sample_pair_share"))


def _sender_block(txn: DataFrame, key: str, tag: str, heavy_rows: int) -> DataFrame:
    senders = materialize(
        with_directions(txn).filter(F.col("is_in") & F.col(key).isNotNull())
        .groupBy("card_no", key)
        .agg(F.count(F.lit(1)).alias("n"), sum0(F.col("inflow_amt")).alias("amt")), "senders")
    degrees = senders.groupBy(key).agg(F.count(F.lit(1)).alias("deg"))
    graded = skew.spread_join(senders, degrees, [key], "deg", ["card_no"], heavy_rows)
    deg, amt = F.col("deg"), F.col("amt")
    return graded.groupBy("card_no").agg(
        F.max(deg).alias(f"{tag}_deg_max"),
        F.avg(deg).alias(f"{tag}_deg_mean"),
        safe_div(sum_where(deg >= 2, amt), F.sum(amt) + 1).alias(f"{tag}_amt_deg2_share"),
        safe_div(sum_where(deg >= 5, amt), F.sum(amt) + 1).alias(f"{tag}_amt_deg5_share"),
        F.count_if(deg >= 2).alias(f"{tag}_n_senders_deg2"),
        F.avg((F.col("n") == 1).cast("double")).alias(f"{tag}_oneoff_share"),
    )


def sender_degree(txn: DataFrame, heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """How many cards each sender pays, by account (fa_) and by name (fn_)."""
    by_account = _sender_block(txn, "cntrprt_card_no", "fa", heavy_rows)
    by_name = _sender_block(txn, "cntrprt_name", "fn", heavy_rows)
    return by_account.join(by_name, "card_no", "full")
