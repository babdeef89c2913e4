"""From CSV files to models and scores, and a second batch with frozen state."""

import dataclasses
import pathlib

import pytest
from pyspark.sql import functions as F

from cardflow.operators import crossfit
from cardflow.plans import matrix, runs
from cardflow.plans.registry import _written
from cardflow.sources import sinks

RECIPES = [
    crossfit.Recipe("boosted", [1], settings={"maxIter": 1, "maxDepth": 2}),
    crossfit.Recipe("forest", [1, 2], crossfit.RandomForestClassifier, {"numTrees": 2, "maxDepth": 2}),
]


@pytest.fixture(scope="module")
def paths(data):
    tables = {name: getattr(data, name) for name in runs.READERS}
    return runs.Paths(**{name: _written(df.drop("row_order"), f"run-{name}") for name, df in tables.items()})


@pytest.fixture(scope="module")
def trained(spark, paths, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("trained"))
    figures = runs.train(spark, paths, folder, matrix.Settings(coverage_floor=10), RECIPES)
    return folder, figures


def scores_of(spark, path):
    return spark.read.schema("card_no string, score double").option("header", True).csv(path)


def test_training_freezes_what_later_batches_need(spark, trained):
    folder, figures = trained
    assert 0 <= figures["f1"] <= 1
    settings = runs.read_settings(spark, f"{folder}/settings")
    assert settings.anchor is not None and settings.summary_codes and settings.more_channel_codes is not None
    assert len(sinks.read_manifest(spark, f"{folder}/manifest")) > 300
    assert spark.read.parquet(f"{folder}/scores").select("family", "seed", "fold").distinct().count() == 15


def test_prediction_scores_the_target_list_in_order_and_leaves_nothing(spark, paths, trained, data, tmp_path):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "cardflow"
    before, tables = set(shared.iterdir()), {t.name for t in spark.catalog.listTables()}
    out = str(tmp_path / "scores")
    runs.predict(spark, paths, trained[0], out, RECIPES)
    assert set(shared.iterdir()) == before and {t.name for t in spark.catalog.listTables()} == tables
    scored = scores_of(spark, out)
    assert scored.count() == data.target.count() and scored.join(data.target, "card_no", "left_anti").count() == 0
    silent = scored.join(data.card, "card_no").filter("score is null")
    assert silent.count() == 0


def test_a_second_batch_keeps_anchor_and_columns(spark, paths, trained, data, tmp_path):
    last = data.txn.agg(F.max("stm_dt")).first()[0]
    earlier = data.txn.filter(F.col("stm_dt") < last)
    half = data.target.drop("row_order").filter("length(card_no) < 3")
    batch = runs.Paths(**{
        **vars(paths), "txn": _written(earlier, "run-earlier"), "target": _written(half, "run-half")})
    out = str(tmp_path / "second")
    runs.predict(spark, batch, trained[0], out, RECIPES)
    assert scores_of(spark, out).count() == half.count()


def test_a_batch_without_the_train_cards_takes_their_rows_from_training(spark, data):
    dealt = data.train.select("card_no", F.lit(0).alias("fold"))
    batch = data.txn.join(data.target, "card_no", "left_semi").drop("row_order")
    log = data.txn.drop("row_order")
    got = runs.completed(batch, log, dealt)
    wanted = log.join(data.train.select("card_no").union(data.target.select("card_no")).distinct(), "card_no", "left_semi")
    assert got.count() > batch.count()
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    assert runs.completed(log, log.limit(0), dealt.join(log, "card_no", "left_semi")) is log


def test_doubled_keys_and_incomplete_outputs_raise(spark, paths, data, tmp_path):
    doubled = runs.Paths(**{**vars(paths), "card": _written(data.card.unionAll(data.card.limit(1)), "run-doubled")})
    with pytest.raises(ValueError, match="card has 2 rows"):
        runs.ingest(spark, doubled, str(tmp_path / "doubled"))
    some = data.target.limit(3).withColumn("score", F.lit(0.5))
    with pytest.raises(ValueError, match="not the target list"):
        runs.require_complete(some, data.target)


def test_a_fixed_anchor_is_kept_and_a_changed_run_is_refused(spark, paths, trained, tmp_path):
    import datetime
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(trained[0], copy)
    settings = runs.read_settings(spark, f"{copy}/settings")
    assert sinks.read_anchor(spark, f"{copy}/anchor") == settings.anchor
    runs.write_settings(spark, dataclasses.replace(settings, anchor=datetime.date(2030, 1, 1)), f"{copy}/settings")
    with pytest.raises(ValueError, match="changed since the run was sealed: settings"):
        runs.predict(spark, paths, copy, str(tmp_path / "refused"), RECIPES)
    fixed = runs.frozen(runs.stored(spark, trained[0]), matrix.Settings(anchor=datetime.date(2030, 1, 1)))
    assert fixed.anchor == datetime.date(2030, 1, 1)
