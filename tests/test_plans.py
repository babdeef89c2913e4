"""Plan shapes and value ranges."""

import pytest
from pyspark.sql import functions as F

from cardflow import constants as K
from cardflow.operators import codes, counterparty, crossfit, daily, flow, folds, sequence
from cardflow.operators.timeline import enrich, heavy_cards
from cardflow.plans import matrix, oracles
from cardflow.plans.registry import SETTINGS
from cardflow.sources.store import bucket_count, materialize, materialize_by_key


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> int:
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


@pytest.fixture(scope="module")
def enriched(data):
    return materialize_by_key(enrich(data.txn), "enriched", "card_no", 8)


def test_enrichment_shuffles_rows_once(spark, data):
    txn = materialize(data.txn, "txn")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(enrich(txn))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_blocks_on_bucketed_rows_shuffle_nothing(enriched):
    summary = codes.code_counts(enriched, "smy_cd")
    for block in (
        enriched.groupBy("card_no").agg(*flow.flow_measures()),
        sequence.gap_stats(enriched),
        counterparty.second_lookbacks(counterparty.pair_summary(enriched)),
        daily.day_lookbacks(daily.daily(enriched)),
        codes.entropy(summary, "h"),
    ):
        assert shuffles(plan_of(block)) == 0


def test_bucket_count_divides_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert bucket_count(spark, 10) == 125
        assert bucket_count(spark, 600_000_000) == 1000
        assert bucket_count(spark, 10**12) == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pair_summary_hash_aggregates(enriched):
    plan = plan_of(counterparty.pair_summary(enriched))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_residuals_sort_rows_once(enriched):
    from cardflow.operators import accounts

    plan = plan_of(accounts.balance_consistency(enriched))
    # The plan reads upwards: what stands below the lowest aggregation works on rows.
    of_rows = plan[plan.rindex("HashAggregate"):]
    assert shuffles(plan) == 0 and of_rows.count("Sort ") == 1 and plan.count("Sort ") <= 3


def test_medians_and_balances_hash_aggregate(enriched):
    for block in (sequence.gap_stats(enriched), sequence.fast_in_out(enriched), flow.balance_aggregates(enriched)):
        plan = plan_of(block)
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and shuffles(plan) == 0


def test_one_heavy_card_leaves_the_others_bucketed(data):
    biggest = data.txn.groupBy("card_no").count().orderBy(F.desc("count")).first()["count"]
    busy = heavy_cards(data.txn, biggest - 1)
    parts = matrix.card_parts(data.txn, busy, lambda df, name: materialize_by_key(df, name, "card_no", 8))
    assert len(parts) == 2 and parts[1].enriched.select("card_no").distinct().count() == busy.count() > 0
    ordinary = parts[0]
    for block in (
        matrix.own_blocks(ordinary, {"0001": "ch0001_share"}, {"0001": "smy_0001_share"}),
        accounts_of(ordinary),
    ):
        assert shuffles(plan_of(block)) == 0


def accounts_of(part):
    from cardflow.operators import accounts

    return accounts.balance_consistency(part.enriched, part.heavy)


def test_scans_are_pruned_and_filters_pushed(spark, data):
    txn = materialize(data.txn, "txn")
    plan = plan_of(counterparty.counterparty_degree(txn))
    assert "acct_bal" not in plan and "IsNotNull(cntrprt_card_no)" in plan


@pytest.fixture(scope="module")
def built(data):
    return matrix.build_matrix(
        data, folds.stratified_folds(data.train), SETTINGS)


def test_matrix_shape(data, built):
    fixed = 35 + 56 + 19 + 5 + 22 + 7
    assert len(built.columns) == len(set(built.columns)) and len(built.columns) > fixed
    assert built.columns[-7:] == K.ACCOUNT_COLUMNS
    assert built.columns[-29:-7] == [f"S_{c}" for c in K.SILENCE_COLUMNS]
    rows = built.rows
    assert built.train().count() == data.train.count()
    assert built.target().count() == K.N_FOLDS * data.target.count()
    assert {t for c, t in rows.dtypes if c in built.columns} == {"float"}
    assert matrix.duplicate_keys(rows, ["side", "card_no", "fold"]).count() == 0


def test_cards_without_transactions_stay(data, built):
    silent = matrix.uncovered_cards(data).select("card_no")
    rows = built.rows.join(silent, "card_no", "left_semi")
    assert rows.count() > 0
    assert rows.filter("n_txn is not null or aa_nf_max <> 0 or nol_amt_f <> 0").count() == 0


def test_shares_are_shares(built):
    shares = [c for c in built.columns
              if c.endswith("_share") or c.endswith("_hhi") or c.startswith(("ch2_", "smy2_", "S_sil_pct"))]
    assert len(shares) > 50
    spread = built.rows.agg(
        F.min(F.least(*shares)).alias("low"), F.max(F.greatest(*shares)).alias("high")).first()
    assert spread.low >= 0 and spread.high <= 1.0000001


def test_code_lists_come_from_the_data(data, enriched):
    open_settings = matrix.Settings(coverage_floor=10)
    channel, summary = (codes.code_counts(enriched, c) for c in ("txn_channel_type", "smy_cd"))
    channels, summaries = matrix._code_names(channel, summary, open_settings)
    assert [c for c in channels if c not in K.CHANNEL_CODES] and len(summaries) > K.TOP_SUMMARY_CODES
    assert set(oracles.MATRIX_MORE_CHANNELS) >= {c for c, n in channels.items() if n.startswith("ch2_")}


def test_cross_fitting_scores_every_card(built, data):
    recipes = [crossfit.Recipe("boosted", [1], settings={"maxIter": 1, "maxDepth": 2})]
    scores = crossfit.cross_fitted_scores(
        built.train(), built.target(), ["in_sum", "S_sil_days", "ao_rate_wavg"], recipes)
    train = scores.filter("side = 'train'")
    assert train.count() == train.select("card_no").distinct().count() == data.train.count()
    assert scores.filter("side = 'target'").count() == K.N_FOLDS * data.target.count()
    assert scores.filter("score is null or score < 0 or score > 1").count() == 0


def test_scores_to_ranked_output(built, data):
    from cardflow.operators import ranking, silence
    from cardflow.plans import scoring

    few = ["in_sum", "S_sil_days", "ao_rate_wavg"]
    recipes = [
        crossfit.Recipe("boosted", [1], settings={"maxIter": 1, "maxDepth": 2}, columns=few),
        crossfit.Recipe("forest", [1, 2], crossfit.RandomForestClassifier, {"numTrees": 2}, few),
    ]
    wide = scoring.with_columns_of(built, crossfit.DEFAULT_RECIPES)
    assert {r.family: len(r.columns) for r in wide} == {
        "boosted": len(built.columns) - 7, "narrow": len(built.columns), "forest": len(built.columns) - 7}
    scores = scoring.cross_fit(built, recipes)
    quiet = materialize(silence.silence_base(enrich(data.txn)), "quiet")
    output = materialize(scoring.predict(scores, quiet, data.target), "output")
    assert tuple(ranking.check_output(output, data.target).first()) == (0, 0, 0)
    ruled = output.join(quiet.filter("sil_days >= 32"), "card_no")
    assert ruled.count() > 0 and ruled.filter("score <> 1.0").count() == 0
    figures = scoring.offline_figures(scores, data.train, 0.1).first()
    assert figures.k == int(data.train.count() * 0.1) and 0 <= figures.f1 <= 1


@pytest.mark.parametrize("name", ["inflow_detail", "card_ratios"])
def test_rows_of_several_blocks_are_written_once(spark, name):
    """Blocks of a card's own rows start from rows written bucketed by card: nothing is joined to orders or shuffled again."""
    from conftest import SMALL

    from cardflow.plans.registry import Inputs, _BUILDERS

    plan = plan_of(_BUILDERS[name](Inputs(spark, SMALL)))
    assert shuffles(plan) == 0 and "l_orderkey" not in plan


def test_buckets_follow_the_rows(spark):
    """Beyond the rows of one task, a bucket does not grow with the table."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert matrix.buckets_of(spark, 1000) == bucket_count(spark, 1000)
    assert matrix.buckets_of(spark, 400_000 * partitions + 1) == 2 * partitions
    assert matrix.buckets_of(spark, 400_000 * partitions * 50) == 64 * partitions


def test_card_columns_are_made_finite_once_per_card(spark, built):
    """Above the join with the fold copies stands only the choice of columns."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    try:
        plan = plan_of(built.rows)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "isnan" in plan and "isnan" not in plan[:plan.index("Join")]


def test_medians_hash_no_rows_by_value(enriched):
    for block in (sequence.gap_stats(enriched), sequence.fast_in_out(enriched)):
        plan = plan_of(block)
        assert plan.count("HashAggregate") == 2 and plan.count("Sort ") == 1


def test_rounding_clear_of_halves_needs_no_decimals(spark):
    """The short way and the two roundings of decimals give the same doubles, on halves, large numbers and odd values too."""
    from cardflow.plans.registry import _rounded

    rows = spark.range(0, 100_000).selectExpr(
        "rand(1) as a", "randn(2) * exp(rand(3) * 40 - 20) as b", "id / 640 as c", "-id / 3200 as d", "(id - 50000) * 5e-7 as e",
        "case id % 4 when 0 then double('NaN') when 1 then double('-Infinity') when 2 then -0e0 end as f", "id * 50e0 as g",
        "round(rand(5) * 1000, 6) + 5e-7 as h", "-1e-9 * id as i", "if(id % 2 = 0, 0.1234565, 0.1234564995) * 1e0 as j")
    for digits in (4, 6):
        wrong = [
            F.count_if(~_rounded(F.col(c), digits).cast("string").eqNullSafe(F.round(F.round(c, 9), digits).cast("string"))).alias(c)
            for c in rows.columns]
        assert set(rows.agg(*wrong).first()) == {0}
