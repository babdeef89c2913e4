"""Order statistics against brute force."""

import random

import pandas as pd
import pytest
from comparing import same
from pyspark.sql import functions as F

from cardflow.operators import ranking
from cardflow.operators.folds import HASH_SPAN, card_hash, stratified_folds
from cardflow.operators.ranks import average_rank_share, in_ranges, nearest_quantile, quantiles, uniform_position


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "big" if i % 3 else f"g{i % 7}"
        value = None if i % 50 == 0 else rng.choice([0.0, 1.0, -3.5, rng.random(), rng.gauss(0, 1e4)])
        rows.append((str(i), group, value))
    return pd.DataFrame(rows, columns=["card_no", "grp", "v"])


@pytest.mark.parametrize("parts", [None, 1, 20])
def test_average_rank_share(spark, values, parts):
    df = spark.createDataFrame(values, "card_no string, grp string, v double").withColumn(
        "v", F.nanvl("v", F.lit(None)))
    got = average_rank_share(df, "v", "pct", ["grp"], ["card_no"], parts)
    frame = values.copy()
    frame["pct"] = frame.groupby("grp")["v"].rank(pct=True)
    want = spark.createDataFrame(frame, "card_no string, grp string, v double, pct double")
    clean = lambda d: d.select("card_no", "grp", F.nanvl("v", F.lit(None)).alias("v"),
                               F.nanvl("pct", F.lit(None)).alias("pct"))
    assert same(clean(got), clean(want))


def test_global_rank_of_single_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "card_no string, score double")
    assert [r["rank"] for r in ranking.rank_normalise(df).collect()] == [0.75, 0.75]


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_one_value_over_many_ranges(spark, parts):
    rows = [(str(i), "a" if i % 4 else None, 5.0 if i % 3 else float(i % 11)) for i in range(900)]
    df = spark.createDataFrame(rows, "card_no string, grp string, v double")
    whole = pd.Series([v for _, _, v in rows]).rank(pct=True)
    got = {r.card_no: r.pct for r in average_rank_share(df, "v", "pct", None, None, parts).collect()}
    assert got == pytest.approx({c: p for (c, _, _), p in zip(rows, whole, strict=True)})
    if parts > 2:
        ranges = in_ranges(df, ["v", "card_no"], parts).filter("v = 5").groupBy("_part").count()
        assert ranges.count() > 2
    # Rows of an unknown group have no rank; the group's own rows are ranked among themselves.
    by_group = {r.card_no: r.pct for r in average_rank_share(df, "v", "pct", ["grp"], None, parts).collect()}
    inside = pd.DataFrame(rows, columns=["c", "g", "v"]).groupby("g").v.rank(pct=True)
    assert all(by_group[c] is None if g is None else by_group[c] == pytest.approx(inside[i]) for i, (c, g, _) in enumerate(rows))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_equal_exact_percentiles(spark, values, parts):
    fractions = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]
    known = values.v.dropna()
    df = spark.createDataFrame(values, "card_no string, grp string, v double").withColumn("v", F.nanvl("v", F.lit(None)))
    assert quantiles(df, "v", fractions, parts) == pytest.approx([known.quantile(f) for f in fractions], rel=1e-12)
    ties = spark.createDataFrame([(3,)] * 50 + [(4,)], "v int")
    assert quantiles(ties, "v", [0, 0.5, 1], parts) == [3, 3, 4]
    assert quantiles(ties.filter("v > 9"), "v", [0.5], parts) == []


def test_nearest_quantile(spark, values):
    frame = values.assign(v=values.v.abs()).dropna()
    df = spark.createDataFrame(frame, "card_no string, grp string, v double")
    got = {r.grp: r.q for r in nearest_quantile(df, ["grp"], "v", 0.9, "q").collect()}
    for group, part in frame.groupby("grp"):
        ordered = sorted(part.v)
        assert got[group] == ordered[int((len(ordered) - 1) * 0.9 + 0.5)]


def test_nearest_quantile_groups_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 5.0), ("k", 2.0)], "k string, v double")
    got = {r.k: r.q for r in nearest_quantile(df, ["k"], "v", 0.9, "q").collect()}
    assert got == {None: 5.0, "k": 2.0}


def test_uniform_position(spark, values):
    df = spark.createDataFrame(values, "card_no string, grp string, v double").withColumn(
        "h", card_hash())
    placed = uniform_position(df, ["grp"], "h", HASH_SPAN, ["card_no"], "pos").toPandas()
    ordered = placed.sort_values(["grp", "h", "card_no"])
    assert (ordered.groupby("grp").cumcount() + 1 == ordered.pos).all()


def test_folds_are_even_and_disjoint(spark, data):
    folds = stratified_folds(data.train).toPandas()
    assert folds.card_no.is_unique and len(folds) == data.train.count()
    sizes = folds.groupby(["label", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_auc_and_f1_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(str(i), rng.randint(0, 1), float(rng.randint(0, 30))) for i in range(600)]
    df = spark.createDataFrame(rows, "card_no string, label int, score double")
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ranking.auc(df).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))
    hashed = {r.card_no: r.h for r in df.select("card_no", card_hash().alias("h")).collect()}
    chosen = sorted(rows, key=lambda r: (-r[2], hashed[r[0]], r[0]))[:60]
    got = ranking.top_fraction_f1(df, 0.1).first()
    tp = sum(y for _, y, _ in chosen)
    p, r = tp / 60, tp / len(pos)
    assert (got.k, got.tp) == (60, tp)
    assert got.f1 == pytest.approx(2 * p * r / (p + r + 1e-9))
    top = {r.card_no for r in ranking.top_fraction(df, 0.1).collect()}
    assert top == {c for c, _, _ in chosen}


def test_hard_rule_ignores_unknown_silence(spark):
    scores = spark.createDataFrame([("a", .1), ("b", .2), ("c", .3)], "card_no string, score double")
    silence = spark.createDataFrame([("a", 40), ("b", None)], "card_no string, sil_days int")
    got = {r.card_no: r.score for r in ranking.hard_rule(scores, silence).collect()}
    assert got == {"a": 1.0, "b": .2, "c": .3}


def test_output_check_counts_faults(spark):
    target = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "card_no string, row_order int")
    output = spark.createDataFrame(
        [("a", .5), ("a", .5), ("b", None), ("x", .1)], "card_no string, score double")
    assert tuple(ranking.check_output(output, target).first()) == (2, 1, 1)


def test_unlabelled_rows_are_left_out_of_the_figures(spark):
    from cardflow.operators import ranking

    rows = [("1", 0.9, 1), ("2", 0.8, 0), ("3", 0.7, 1), ("4", 0.1, 0), ("5", 0.95, None), ("6", 0.85, None)]
    scored = spark.createDataFrame(rows, "card_no string, score double, label int")
    assert ranking.auc(scored).first().auc == 0.75
    figures = ranking.top_fraction_f1(scored, 0.5).first()
    assert (figures.k, figures.tp, figures.positives) == (2, 1, 2)


def test_numeric_hash_takes_long_ids(spark):
    from cardflow.operators import folds

    row = spark.createDataFrame([("9223372036854775807",), ("12",)], "card_no string").select(
        folds.numeric_card_hash().alias("h")).collect()
    assert [r.h for r in row] == [(int(c) * 2654435761 + 42 * 40503) % 2**32 for c in ("9223372036854775807", "12")]
