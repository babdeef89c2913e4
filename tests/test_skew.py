"""Heavy keys give the same results as light ones, and leakage-free exposure stays leakage-free."""

import pytest
from comparing import same
from pyspark.sql import functions as F

from cardflow.constants import N_FOLDS
from cardflow.operators import counterparty, edges, exposure, folds, silence, skew, static
from cardflow.operators.timeline import enrich
from cardflow.sources.store import materialize


def test_spread_join_with_heavy_and_missing_keys(spark):
    rows = spark.createDataFrame(
        [(i, None if i % 10 == 0 else ("hot" if i % 3 else f"k{i}")) for i in range(900)], "id int, k string")
    lookup = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("w"))
    plain = rows.join(lookup, "k", "left")
    for heavy_rows in (0, 100, 10**6):
        assert same(skew.spread_join(rows, lookup, ["k"], "w", ["id"], heavy_rows), plain)


def test_hot_counterparty(spark, data):
    one_party = F.when(F.col("cntrprt_card_no").cast("int") % 3 == 0, "HUB").otherwise(
        F.col("cntrprt_card_no"))
    txn = data.txn.withColumn("cntrprt_card_no", one_party)
    for operator in (counterparty.counterparty_degree, counterparty.sender_degree):
        assert same(operator(txn, 5), operator(txn))


def test_static_blocks_with_hot_customer(data):
    owner = F.when(F.col("card_no").cast("int") % 3 == 0, "U0").otherwise(F.col("cst_id"))
    card = data.card.withColumn("cst_id", owner)
    assert same(static.frequency_encoding(card, data.cst, heavy_rows=3),
                static.frequency_encoding(card, data.cst))
    assert same(static.static_profile(data.txn, card, data.cst, data.accno, 3),
                static.static_profile(data.txn, card, data.cst, data.accno))


def test_percentiles_with_heavy_values(data):
    base = materialize(silence.silence_base(enrich(data.txn)), "base")
    assert same(silence.silence_percentiles(base, 2), silence.silence_percentiles(base))


@pytest.fixture(scope="module")
def setting(data):
    account = materialize(edges.edge_table(data.txn, "cntrprt_card_no"), "edges")
    return account, materialize(folds.stratified_folds(data.train), "folds")


def _encode(account, assigned, target, heavy_rows=skew.HEAVY_ROWS):
    roles = exposure.fold_matched_roles(assigned, target)
    return exposure.exposure(
        exposure.edges_with_roles(account, roles, heavy_rows), edges.account_variants(), N_FOLDS, 30,
        heavy_rows)


def test_heavy_keys_do_not_change_exposure(data, setting):
    account, assigned = setting
    assert same(_encode(account, assigned, data.target, 3), _encode(account, assigned, data.target))


def test_own_fold_labels_do_not_matter(data, setting):
    account, assigned = setting
    before = _encode(account, assigned, data.target)
    flipped = assigned.withColumn(
        "label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    after = _encode(account, flipped, data.target)
    own = "side = 'train' and fold = 2"
    assert same(before.filter(own), after.filter(own))
    assert before.exceptAll(after).count() > 0
    # target copy 2 never meets fold 2 either
    copy = "side = 'target' and fold = 2"
    assert same(before.filter(copy), after.filter(copy))


def test_subtraction_equals_five_passes(data, setting):
    """Fold by fold with the whole-reference form, as the definition reads."""
    account, assigned = setting
    one_pass = _encode(account, assigned, data.target)
    for k in range(N_FOLDS):
        others = assigned.filter(F.col("fold") != k)
        for side, cards in (("train", assigned.filter(F.col("fold") == k)), ("target", data.target)):
            roles = exposure.whole_reference_roles(others, cards.select("card_no"))
            direct = exposure.exposure(
                exposure.edges_with_roles(account, roles), edges.account_variants(), 1, 30)
            here = one_pass.filter((F.col("side") == side) & (F.col("fold") == k))
            assert same(here.drop("side", "fold"), direct.drop("side", "fold"))
