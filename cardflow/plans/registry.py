"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.constants import CHANNEL_CODES, MAX_CHANNEL_CODES, MAX_SUMMARY_CODES, TOP_SUMMARY_CODES
from cardflow.operators import (
    accounts, codes, counterparty, daily, edges, exposure, flow, folds, ranking, sequence,
    silence, sketches, static,
)
from cardflow.operators.timeline import card_rows, enrich, heavy_and_tasks, heavy_cards, total_rows
from cardflow.plans import matrix, oracles, scoring
from cardflow.plans.adapter import SOURCES, CardData, card_data
from cardflow.sources import readers, sinks
from cardflow.sources.store import materialize, materialize_by_key, materialize_once, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

SETTINGS = matrix.Settings(
    summary_codes=oracles.MATRIX_TOP_SUMMARY,
    more_summary_codes=oracles.MATRIX_MORE_SUMMARY,
    more_channel_codes=oracles.MATRIX_MORE_CHANNELS,
    coverage_floor=oracles.COVERAGE_FLOOR,
    account_degree_limit=oracles.ACCOUNT_LIMIT,
    name_degree_limit=oracles.NAME_LIMIT,
)
# As a run has them: code lists read off the data. SQL needs fixed column names, hence the lists above.
OPEN_SETTINGS = replace(SETTINGS, summary_codes=None, more_summary_codes=None, more_channel_codes=None)
# Standard deviations differ in their last digits between engines that add in another order.
_COARSE = {"in_std": 4, "out_std": 4, "bal_std": 4, "daily_n_std": 4}


def _rounded(value: Column, digits: int) -> Column:
    """Rounded to 9 digits, then to `digits`: sums added in another order must not round a half differently.

    Values clear of a half need no decimals, which cost a hundred times as much: both ways give the double next to k / 10^digits.
    """
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 2.0**44) & (F.abs(scaled - whole) < 0.49)
    return F.when(clear, whole / 10.0**digits + 0.0).otherwise(F.round(F.round(value, 9), digits))


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded and integers widened, so both engines print the same values."""
    shown = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = _rounded(c.cast("double"), _COARSE.get(f.name, 6))
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        shown.append(c.alias(f.name))
    return df.select(*shown)


@dataclass
class Inputs:
    """Frames the queries start from, each built only when a query asks for it."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def data(self) -> CardData:
        return card_data(self.spark, self.sf_dir)

    @property
    def tables(self) -> list[str]:
        """The parquet tables the card data come from."""
        return [f"{self.sf_dir}/{name}.parquet" for name in SOURCES]

    @property
    def txn(self) -> DataFrame:
        return self.data.txn

    @cached_property
    def written(self) -> DataFrame:
        """Transactions written once, for queries that read them several times."""
        return materialize(self.txn, "txn")

    def narrow(self, *columns: str) -> DataFrame:
        """These columns of the transactions, written once: several scans of them then join no orders again."""
        return materialize(self.txn.select(*columns), "txn-columns")

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich(self.txn)

    def written_parts(self, columns: list[str], condition: str = "true") -> list[DataFrame]:
        """These columns of the enriched rows that meet the condition, written once: the ordinary cards bucketed by card, so
        that what is grouped by card and more shuffles nothing, and heavy cards, if any, apart. Other columns are null."""
        per_card = card_rows(self.txn)
        rows = total_rows(per_card)
        buckets = matrix.buckets_of(self.spark, rows)
        parts = matrix.enriched_parts(
            self.txn, heavy_cards(per_card, counted="_rows"),
            lambda df, name: materialize_by_key(df, name, "card_no", buckets),
            matrix.tasks_of_buckets(rows, buckets), columns, condition)
        return [_with_unread(part, self.enriched_schema) for part, _ in parts]

    @cached_property
    def enriched_schema(self) -> T.StructType:
        return enrich(self.txn, self.spark.createDataFrame([], "card_no string")).schema

    @cached_property
    def pairs(self) -> DataFrame:
        return counterparty.pair_summary(self.enriched)

    @cached_property
    def days(self) -> DataFrame:
        return daily.daily(self.txn)

    @cached_property
    def channel(self) -> DataFrame:
        return codes.code_counts(self.txn, "txn_channel_type")

    @cached_property
    def summary(self) -> DataFrame:
        return codes.code_counts(self.txn, "smy_cd")

    @cached_property
    def account_edges(self) -> DataFrame:
        """Edges, written once: degrees, label counts and encodings all start from them."""
        return materialize(edges.edge_table(self.txn, "cntrprt_card_no"), "edges-account")

    @cached_property
    def name_edges(self) -> DataFrame:
        return materialize(edges.edge_table(self.txn, "cntrprt_name"), "edges-name")

    @cached_property
    def folds(self) -> DataFrame:
        return folds.stratified_folds(self.data.train, hashed=folds.numeric_card_hash())

    @cached_property
    def quiet(self) -> DataFrame:
        """Silence base, written once: rankings read it several times."""
        return materialize(silence.silence_of_rows(self.txn), "silence")

    def matched(self, side: str | None = None) -> DataFrame:
        roles = exposure.fold_matched_roles(self.folds, self.data.target)
        return matrix.exposure_features(self.written_parts(_EDGE_COLUMNS), roles, SETTINGS, side)

    @cached_property
    def matrix(self) -> matrix.Matrix:
        return matrix.build_matrix(self.data, self.folds, SETTINGS, "double")

    @cached_property
    def scores(self) -> DataFrame:
        """Scores without a model: whole-number formulas for three families, one with two seeds."""
        return self._scores()

    def _scores(self, wanted: str | None = None) -> DataFrame:
        """The scores of all families or of the wanted one."""
        formulas = [
            ("boosted", 42, F.expr("n_txn * 3 + sil_days")),
            ("narrow", 42, F.expr("(n_txn * 7 + sil_days * 5) % 101")),
            ("narrow", 2026, F.expr("n_t7 * 2 + last_hour")),
            ("forest", 42, F.expr("cast(bal_last as bigint) % 5000")),
        ]
        entries = F.array(*[
            F.struct(F.lit(family).alias("family"), F.lit(seed).alias("seed"),
                     score.cast("long").alias("base"))
            for family, seed, score in formulas if wanted in (None, family)
        ])
        copies = self.quiet.select("card_no", F.explode(entries).alias("e")).select(
            "card_no", "e.*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
        shift = F.col("fold") * (F.col("card_no").cast("long") % 3)
        return copies.select(
            "card_no", "family", "seed", "fold", (F.col("base") + shift).cast("double").alias("score"))

    @cached_property
    def fold_mean(self) -> DataFrame:
        return materialize(ranking.fold_mean(self.scores), "fold-mean")

    @cached_property
    def one_family(self) -> DataFrame:
        """Fold means of one family, written once; those of the other families are not made."""
        return materialize(ranking.fold_mean(self._scores("boosted")).select("card_no", "score"), "one-family")

    @property
    def labelled(self) -> DataFrame:
        return materialize(self.one_family.join(self.data.train, "card_no"), "labelled")

    @cached_property
    def families(self) -> DataFrame:
        return ranking.family_scores(self.fold_mean)

    @cached_property
    def blend(self) -> DataFrame:
        return materialize(ranking.rank_blend(self.families), "blend")


def _dynamic_codes(i: Inputs) -> DataFrame:
    top = codes.code_list(codes.top_codes(i.summary, TOP_SUMMARY_CODES))
    parts = [
        ("smy_cd", i.summary, MAX_SUMMARY_CODES, top),
        ("txn_channel_type", i.channel, MAX_CHANNEL_CODES, CHANNEL_CODES),
    ]
    found = [
        codes.covered_codes(counts, SETTINGS.coverage_floor, k, taken).select(
            F.lit(field).alias("field"), "code", "n_cards")
        for field, counts, k, taken in parts
    ]
    return found[0].unionByName(found[1])


def _entropies(i: Inputs) -> DataFrame:
    hours = codes.code_counts(i.txn.withColumn("hour", F.hour("tms")), "hour")
    return codes.entropy(hours, "hour_entropy").join(
        codes.entropy(i.channel, "channel_entropy"), "card_no")


def _code_columns(i: Inputs, which: int) -> DataFrame:
    """Shares of the channel (0) or summary (1) codes."""
    return codes.code_shares((i.channel, i.summary)[which], matrix._code_names(i.channel, i.summary, SETTINGS)[which])


def _dynamic_code_shares(i: Inputs) -> DataFrame:
    """The shares of all dynamic codes in long form, one row per card, field and code with a share above 0."""
    names = matrix._code_names(i.channel, i.summary, OPEN_SETTINGS)
    parts = []
    for name, counts, known in (("txn_channel_type", i.channel, names[0]), ("smy_cd", i.summary, names[1])):
        wide = codes.code_shares(counts, known)
        entries = F.array(*[F.struct(F.lit(c).alias("code"), F.col(column).alias("share")) for c, column in known.items()])
        parts.append(wide.select("card_no", F.lit(name).alias("field"), F.explode(entries).alias("e")).select(
            "card_no", "field", "e.code", "e.share").filter(F.col("share") > 0))
    return parts[0].unionAll(parts[1])


def _whole_reference(i: Inputs, kind: str) -> DataFrame:
    roles = exposure.whole_reference_roles(i.data.train, i.data.target)
    if kind == "one":
        account = exposure.edges_with_roles(i.account_edges, roles)
        variant = [v for v in edges.account_variants() if v.name == "ao"]
        one = exposure.exposure(account, variant, 1)
        return one.select("card_no", *[
            F.col(c).alias(c.removeprefix("ao_")) for c in one.columns if c.startswith("ao_")])
    return exposure.exposure_all(
        *matrix.role_edges(i.written_parts(_EDGE_COLUMNS), materialize(roles, "roles")), edges.account_variants(),
        edges.name_variants(), 1, SETTINGS.account_degree_limit, SETTINGS.name_degree_limit,
    ).drop("side", "fold")


def _edge_variants(i: Inputs) -> DataFrame:
    return edges.edge_variants(
        i.account_edges, edges.account_variants(), SETTINGS.account_degree_limit,
    ).unionByName(edges.edge_variants(i.name_edges, edges.name_variants(), SETTINGS.name_degree_limit))


# What the queries read of the enriched rows.
_EDGE_COLUMNS = ["card_no", "cntrprt_card_no", "cntrprt_name", "cntrprt_prvt_ind", "inflow_amt", "outflow_amt"]
_INFLOW_COLUMNS = [
    "card_no", "cntrprt_card_no", "cntrprt_prvt_ind", "cntrprt_clear_type", "hour", "is_in", "inflow_amt", "sec_before",
]
_RATIO_COLUMNS = [
    "card_no", "cntrprt_card_no", "tms", "stm_dt", "hour", "is_in", "is_out", "inflow_amt", "outflow_amt", "txn_amt", "acct_bal",
    "cntrprt_prvt_ind", "cntrprt_clear_type", "days_before", "sec_before", "rn_end", "io_flip", "is_last_in", "after_last_in",
]
_WEALTH_COLUMNS = _INFLOW_COLUMNS + ["stm_dt", "outflow_amt", "is_out", "acct_bal", "rn_end"]


def _with_unread(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows with the other columns of the schema as nulls, for operators of which only some measures are used."""
    return rows.select(*[
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _inflow_detail(i: Inputs) -> DataFrame:
    return matrix.together([
        counterparty.inflow_detail(counterparty.pair_summary(rows), rows)
        for rows in i.written_parts(_INFLOW_COLUMNS, "is_in")])


def _card_ratios(i: Inputs) -> DataFrame:
    by_card = lambda df, *measures: df.groupBy("card_no").agg(*measures)
    blocks = matrix.together([matrix._join_blocks([
        by_card(rows, *flow.flow_measures(), *flow.balance_measures(), *sequence.flip_measures(), *sequence.last_k_measures()),
        by_card(counterparty.pair_summary(rows), *counterparty.party_count_measures(),
                *counterparty.after_inflow_measures(), *counterparty.second_lookback_measures()),
        by_card(daily.daily(rows), codes.distinct_measure("n_days"), *daily.lookback_measures(), *daily.last_day_measures()),
    ]) for rows in i.written_parts(_RATIO_COLUMNS)])
    return matrix.card_ratios(blocks).select("card_no", *matrix.RATIOS)


def _wealth(i: Inputs) -> DataFrame:
    parts = i.written_parts(_WEALTH_COLUMNS)
    own = matrix.together([matrix._join_blocks([
        rows.groupBy("card_no").agg(*flow.flow_measures(), *flow.balance_measures()),
        counterparty.inflow_detail(counterparty.pair_summary(rows), rows),
    ]) for rows in parts])
    profile = static.static_profile(matrix.together(parts), i.data.card, i.data.cst, i.data.accno)
    joined = matrix.wealth_ratios(matrix._join_blocks([own, profile]))
    return joined.select("card_no", *matrix.K.WEALTH_COLUMNS)


def _class_means(i: Inputs) -> DataFrame:
    paid = flow.flow_aggregates(i.txn).select("card_no", "in_sum")
    rows = i.data.train.join(paid, "card_no", "left").join(i.data.card, "card_no", "left")
    return matrix.class_means(rows.withColumn("in_vs_aum", matrix.inflow_over_held()))


def _lenient_parse(i: Inputs) -> DataFrame:
    lines = i.spark.read.parquet(f"{i.sf_dir}/lineitem.parquet")
    text = lines.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_partkey") % 11 == 0, "unknown")
        .otherwise(F.date_format("l_shipdate", readers.TIMESTAMP_PATTERN)).alias("tms"),
        F.when(F.col("l_partkey") % 13 == 0, "")
        .otherwise(F.date_format("l_shipdate", readers.DATE_PATTERN)).alias("stm_dt"))
    return text.withColumns({
        "tms": readers.lenient_timestamp(F.col("tms")), "stm_dt": readers.lenient_date(F.col("stm_dt"))})


def _label_normalise(i: Inputs) -> DataFrame:
    text = F.when(F.col("c_acctbal") < 0, "1.0").otherwise("0.0")
    for rest, odd in enumerate(oracles.ODD_LABELS):
        text = F.when(F.col("c_custkey") % 17 == rest, odd).otherwise(text)
    customers = i.spark.read.parquet(f"{i.sf_dir}/customer.parquet")
    return customers.select("c_custkey", readers.label_value(text).alias("label"))


def _written(df: DataFrame, name: str) -> str:
    """Folder of CSV files with the columns in another order, one column more, and times as text."""
    texts = {c: F.date_format(c, readers.TIMESTAMP_PATTERN if kind == "timestamp_ntz" else readers.DATE_PATTERN)
             for c, kind in df.dtypes if kind in ("timestamp_ntz", "date")}
    path = f"{shared_folder(df.sparkSession)}/cardflow/{name}-{uuid.uuid4().hex}"
    shuffled = sorted(df.columns, key=lambda c: c[::-1])
    df.withColumns(texts | {"further": F.lit(7)}).select("further", *shuffled).write.option("header", True).option("compression", "gzip").csv(path)
    return path


def _scores_roundtrip(i: Inputs) -> DataFrame:
    """The ranked output written as the score file and read back."""
    path = f"{shared_folder(i.spark)}/cardflow/scores-csv-{uuid.uuid4().hex}"
    output = ranking.ranked_output(ranking.hard_rule(i.blend, i.quiet), i.data.target)
    sinks.write_scores_csv(materialize(output, "output"), path)
    return i.spark.read.schema("card_no string, score double").option("header", True).csv(path)


def _anchor_roundtrip(i: Inputs) -> DataFrame:
    path = f"{shared_folder(i.spark)}/cardflow/anchor-{uuid.uuid4().hex}"
    sinks.write_anchor(silence.anchor_date(i.txn), path, sinks.ANCHOR_NOTE)
    return i.spark.read.schema("anchor_date date, note string").json(path)


def _manifest_roundtrip(i: Inputs) -> DataFrame:
    """The most frequent codes of the data as a column manifest, read back and compared in order."""
    path = f"{shared_folder(i.spark)}/cardflow/manifest-{uuid.uuid4().hex}"
    names = codes.code_list(codes.top_codes(i.summary, TOP_SUMMARY_CODES))
    sinks.write_manifest(i.spark, names, path)
    sinks.check_manifest(names, sinks.read_manifest(i.spark, path))
    return i.spark.read.parquet(path)


def _reuse_roundtrip(i: Inputs) -> DataFrame:
    """Card anchors made once under the fingerprint of the tables; the second asking reads what the first has written."""
    made: list[str] = []

    def make() -> DataFrame:
        made.append("made")
        return flow.card_anchor(i.txn, i.data.train, i.data.target)

    key = {"run": uuid.uuid4().hex}
    materialize_once(make, i.spark, "card-anchor", key, i.tables)
    again = materialize_once(make, i.spark, "card-anchor", key, i.tables)
    return again.withColumn("times_made", F.lit(len(made)))


def _sketch_counts(i: Inputs) -> DataFrame:
    """Distinct counterparties of a card and cards of a counterparty: exact, and whether merged batch sketches come near.

    The two halves of the year are sketched and stored apart, as two batches would be.
    """
    rows = i.written.select("card_no", "cntrprt_card_no", F.month("stm_dt") <= 6)
    rows = rows.toDF("card_no", "cntrprt_card_no", "first_half")
    sides = {"card": ("card_no", "cntrprt_card_no"), "counterparty": ("cntrprt_card_no", "card_no")}
    found = []
    for side, (key, value) in sides.items():
        path = f"{shared_folder(i.spark)}/cardflow/sketches-{side}-{uuid.uuid4().hex}"
        known = rows.filter(F.col(key).isNotNull())
        for batch, part in (("first", known.filter("first_half")), ("second", known.filter("first_half IS NULL OR NOT first_half"))):
            sketches.store_batch(sketches.distinct_sketches(part, key, {"n": value}), path, batch)
        exact = known.groupBy(key, value).agg(F.count(F.lit(1))).groupBy(key).agg(F.count(F.lit(1)).alias("n_exact"))
        near = F.abs(F.col("n") - F.col("n_exact")) <= F.ceil(F.col("n_exact") * sketches.BOUND)
        found.append(sketches.estimates(sketches.stored(i.spark, path, key), key).join(exact, key, "full").select(
            F.lit(side).alias("side"), F.col(key).alias("key"), "n_exact", F.coalesce(near, F.lit(False)).cast("int").alias("near")))
    return found[0].unionByName(found[1])


def _vectors_roundtrip(i: Inputs) -> DataFrame:
    path = f"{shared_folder(i.spark)}/cardflow/score-vectors-{uuid.uuid4().hex}"
    sinks.write_score_vectors(i.scores, path)
    return i.spark.read.parquet(path)


def _csv_transactions(i: Inputs) -> DataFrame:
    return readers.read_transactions(i.spark, _written(i.txn, "txn-csv"))


def _csv_side_tables(i: Inputs) -> DataFrame:
    """All side tables read back, one line of text per row."""
    data, spark = i.data, i.spark
    tables = {
        "card": (readers.read_cards, data.card), "cst": (readers.read_customers, data.cst),
        "accno": (readers.read_accounts, data.accno), "train": (readers.read_labels, data.train),
        "target": (readers.read_targets, data.target),
    }
    lines = []
    for name, (read, df) in tables.items():
        back = read(spark, _written(df, f"{name}-csv"))
        shown = [F.coalesce(F.col(c).cast("bigint" if kind == "double" else "string").cast("string"), F.lit("~"))
                 for c, kind in sorted(back.dtypes) if c != "row_order"]
        lines.append(back.select(F.lit(name).alias("tbl"), F.concat_ws("|", *shown).alias("line")))
    return reduce(DataFrame.unionAll, lines)


def _crossfit(i: Inputs) -> DataFrame:
    """Scores of all default recipes on the whole matrix.

    Fitted once per application: `crossfit_coverage` reads what `crossfit_scores` wrote.
    """
    key = {"application": i.spark.sparkContext.applicationId}
    return materialize_once(lambda: scoring.cross_fit(i.matrix), i.spark, "crossfit", key, i.tables)


def _crossfit_coverage(i: Inputs) -> DataFrame:
    """Per side, family, seed and fold: rows, cards, scores outside 0 to 1, and train cards of another fold."""
    scores = _crossfit(i).join(i.folds.select("card_no", F.col("fold").alias("own")), "card_no", "left")
    score = F.col("score")
    return scores.groupBy("side", "family", "seed", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("card_no").alias("n_cards"),
        F.count_if(score.isNull() | F.isnan(score) | (score < 0) | (score > 1)).alias("outside"),
        F.count_if((F.col("side") == "train") & ~F.col("own").eqNullSafe(F.col("fold"))).alias("met"))


# So few rows make a card heavy in the `_split` queries, so that both kinds of cards occur in the given tables.
SPLIT_ROWS = 50


def _enriched_split(i: Inputs) -> DataFrame:
    heavy, tasks = heavy_and_tasks(i.txn, SPLIT_ROWS)
    return enrich(i.txn, heavy, tasks=tasks).select(*_TXN_COLUMNS)


def _consistency_split(i: Inputs) -> DataFrame:
    heavy, tasks = heavy_and_tasks(i.txn, SPLIT_ROWS)
    return accounts.balance_consistency(i.txn, heavy, tasks=tasks)


def _feature_matrix_split(i: Inputs) -> DataFrame:
    return matrix.build_matrix(i.data, i.folds, replace(SETTINGS, heavy_rows=SPLIT_ROWS), "double").rows


def _feature_matrix(i: Inputs) -> DataFrame:
    return i.matrix.rows


_TXN_COLUMNS = [
    "card_no", "cst_accno", "accno_txn_sn", "tms", "stm_dt", "hour", "is_in", "is_out", "anchor_dt",
    "anchor_tms", "days_before", "sec_before", "rn_end", "gap_sec", "out_after_in_sec", "io_flip",
    "after_last_in",
]

_MIX_COLUMNS = [
    "card_no", "tms", "inflow_amt", "outflow_amt", "cntrprt_card_no", "cntrprt_prvt_ind", "cntrprt_clear_type", "txn_channel_type",
    "txn_cgycd", "smy_cd", "rmrk_recharge_withdrawal_ind", "rmrk_short_ind", "rmrk_e_credit_ind",
]

_BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {
    "lenient_parse": _lenient_parse,
    "label_normalise": _label_normalise,
    "card_anchor": lambda i: flow.card_anchor(i.txn, i.data.train, i.data.target),
    "enriched_txn": lambda i: i.enriched.select(*_TXN_COLUMNS),
    "flow_aggregates": lambda i: flow.flow_aggregates(
        i.narrow("card_no", "cst_accno", "tms", "stm_dt", "inflow_amt", "outflow_amt")),
    "balance_aggregates": lambda i: flow.balance_aggregates(i.enriched),
    "mix_shares": lambda i: flow.mix_shares(i.narrow(*_MIX_COLUMNS)),
    "gap_stats": lambda i: sequence.gap_stats(i.enriched),
    "fast_in_out": lambda i: sequence.fast_in_out(i.enriched),
    "amount_shape": lambda i: flow.amount_shape(i.txn),
    "day_lookbacks": lambda i: daily.day_lookbacks(i.days),
    "channel_shares": lambda i: _code_columns(i, 0),
    "summary_shares": lambda i: _code_columns(i, 1),
    "dynamic_code_shares": _dynamic_code_shares,
    "top_codes": lambda i: codes.top_codes(i.summary, TOP_SUMMARY_CODES),
    "top_code_shares": lambda i: codes.code_share_rows(
        i.summary, codes.top_codes(i.summary, TOP_SUMMARY_CODES)),
    "dynamic_codes": _dynamic_codes,
    "top_counterparty": lambda i: counterparty.top_counterparty(i.pairs),
    "card_ratios": _card_ratios,
    "static_profile": lambda i: static.static_profile(i.txn, i.data.card, i.data.cst, i.data.accno),
    "frequency_encoding": lambda i: static.frequency_encoding(i.data.card, i.data.cst),
    "last_row": lambda i: sequence.last_row(i.txn),
    "last_k": lambda i: sequence.last_k(i.txn),
    "last_day": lambda i: daily.last_day(i.days),
    "daily_peak": lambda i: daily.daily_peak(i.days),
    "entropy": _entropies,
    "amount_repetition": lambda i: flow.amount_repetition(i.txn),
    "counterparty_degree": lambda i: counterparty.counterparty_degree(i.written),
    "sample_pair_share": lambda i: counterparty.sample_pair_share(i.txn),
    "after_last_inflow": lambda i: counterparty.after_last_inflow(i.pairs),
    "io_flips": lambda i: sequence.io_flips(i.enriched),
    "first_contact": lambda i: counterparty.first_contact(i.pairs),
    "fan_out": lambda i: daily.fan_out(i.days, i.txn),
    "balance_path": lambda i: sequence.balance_path(i.enriched),
    "second_lookbacks": lambda i: counterparty.second_lookbacks(i.pairs),
    "inflow_concentration": lambda i: counterparty.inflow_concentration(i.pairs),
    "calendar": lambda i: flow.calendar(i.txn),
    "edge_account": lambda i: edges.edge_table(i.txn, "cntrprt_card_no"),
    "edge_name": lambda i: edges.edge_table(i.txn, "cntrprt_name"),
    "edge_variants": _edge_variants,
    "semi_low_degree": lambda i: edges.low_degree_edges(i.account_edges, SETTINGS.account_degree_limit),
    "stratified_folds": lambda i: i.folds,
    "exposure_ref": lambda i: _whole_reference(i, "one"),
    "exposure_all": lambda i: _whole_reference(i, "all"),
    "exposure_oof": lambda i: i.matched(exposure.TRAIN).drop("side"),
    "exposure_target_foldmatched": lambda i: i.matched(exposure.TARGET).drop("side"),
    "sender_degree": lambda i: counterparty.sender_degree(i.written),
    "inflow_detail": _inflow_detail,
    "silence_anchor": lambda i: silence.anchor_date(i.txn),
    "silence_base": lambda i: silence.silence_of_rows(i.txn),
    "silence_interactions": lambda i: silence.silence_interactions(silence.silence_of_rows(i.txn)),
    "silence_percentiles": lambda i: silence.silence_percentiles(i.quiet),
    "account_concentration": lambda i: accounts.account_concentration(i.txn, i.data.card),
    "balance_consistency": lambda i: accounts.balance_consistency(i.txn),
    "wealth_ratios": _wealth,
    "feature_matrix": _feature_matrix,
    "enriched_txn_split": _enriched_split,
    "balance_consistency_split": _consistency_split,
    "feature_matrix_split": _feature_matrix_split,
    "coverage_report": lambda i: matrix.coverage_report(i.data),
    "class_means": _class_means,
    "anti_uncovered": lambda i: matrix.uncovered_cards(i.data),
    "fold_mean": lambda i: ranking.fold_mean(i.scores),
    "rank_normalise": lambda i: ranking.rank_normalise(i.one_family),
    "family_scores": lambda i: i.families,
    "rank_blend": lambda i: i.blend,
    "hard_rule": lambda i: ranking.hard_rule(i.blend, i.quiet),
    "top_fraction": lambda i: ranking.top_fraction(i.one_family, tie=folds.numeric_card_hash()),
    "top_frac_f1": lambda i: ranking.top_fraction_f1(i.labelled, tie=folds.numeric_card_hash()),
    "auc": lambda i: ranking.auc(i.labelled),
    "ranked_output": lambda i: ranking.ranked_output(
        ranking.hard_rule(i.blend, i.quiet), i.data.target),
    "output_check": lambda i: ranking.check_output(
        ranking.ranked_output(ranking.hard_rule(i.blend, i.quiet), i.data.target), i.data.target),
    "duplicate_keys": lambda i: matrix.duplicate_keys(i.txn, ["card_no", "stm_dt"]),
    "anchor_roundtrip": _anchor_roundtrip,
    "manifest_roundtrip": _manifest_roundtrip,
    "reuse_roundtrip": _reuse_roundtrip,
    "sketch_counts": _sketch_counts,
    "scores_csv_roundtrip": _scores_roundtrip,
    "score_vectors_roundtrip": _vectors_roundtrip,
    "csv_transactions": _csv_transactions,
    "csv_side_tables": _csv_side_tables,
    "crossfit_scores": _crossfit,
    "crossfit_coverage": _crossfit_coverage,
}


def _query(build: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: presented(build(Inputs(spark, sf_dir)))


def all_queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in _BUILDERS.items()}
