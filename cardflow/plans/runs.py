"""From CSV files to models, and from models to a score file.

`train` freezes what later runs must not change (code lists, column order, silence anchor, folds) and keeps it
with the models and typed tables in one folder. `predict` reads that folder and never fits anything.
Working tables of a run are dropped when it ends.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.operators import codes, crossfit, folds, ranking, silence
from cardflow.plans import matrix, scoring
from cardflow.plans.adapter import CardData
from cardflow.sources import readers, sinks
from cardflow.sources.store import materialize, scratch

READERS = {
    "txn": readers.read_transactions, "card": readers.read_cards, "cst": readers.read_customers,
    "accno": readers.read_accounts, "train": readers.read_labels, "target": readers.read_targets,
}
# Tables with one row per key; a doubled key would double cards in the joins.
UNIQUE = {"card": ["card_no"], "cst": ["cst_id"], "train": ["card_no"], "target": ["card_no"]}


@dataclass(frozen=True)
class Paths:
    """CSV files or folders of the input tables."""

    txn: str
    card: str
    cst: str
    accno: str
    train: str
    target: str


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    doubled = matrix.duplicate_keys(df, keys).first()
    if doubled is not None:
        raise ValueError(f"{name} has {doubled['n']} rows for {', '.join(str(doubled[k]) for k in keys)}")


def ingest(spark: SparkSession, paths: Paths, folder: str) -> CardData:
    """CSV once to typed parquet under the folder; everything later reads the parquet."""
    for name, read in READERS.items():
        sinks.write_table(read(spark, getattr(paths, name)), f"{folder}/tables/{name}")
    data = stored(spark, folder)
    for name, keys in UNIQUE.items():
        require_unique(getattr(data, name), keys, name)
    return data


def stored(spark: SparkSession, folder: str) -> CardData:
    return CardData(**{name: readers.read_table(spark, f"{folder}/tables/{name}") for name in READERS})


def frozen(data: CardData, settings: matrix.Settings) -> matrix.Settings:
    """Settings with the code lists and the anchor read off the data where they are open."""
    counts = {c: codes.code_counts(data.txn, c) for c in ("txn_channel_type", "smy_cd")}
    lists = matrix.code_lists(counts["txn_channel_type"], counts["smy_cd"], settings)
    return replace(settings, **lists, anchor=settings.anchor or silence.anchor_date(data.txn).first()[0])


def completed(batch: DataFrame, trained: DataFrame, dealt: DataFrame) -> DataFrame:
    """The batch's transactions, and from the training log those of train cards that the batch does not name.

    Exposure counts the train cards of a counterparty over the log. A batch that brings target cards alone would
    find none of them and score every card as unexposed. A card the batch names is taken from the batch only.
    """
    absent = materialize(
        dealt.select("card_no").distinct().join(batch.select("card_no").distinct(), "card_no", "left_anti"), "absent-cards")
    if absent.isEmpty():
        return batch
    # Read by many blocks of the matrix.
    return materialize(batch.unionByName(trained.join(absent, "card_no", "left_semi")), "completed-log")


def write_settings(spark: SparkSession, settings: matrix.Settings, path: str) -> None:
    text = json.dumps(asdict(settings), default=str)
    spark.createDataFrame([(text,)], "settings string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> matrix.Settings:
    known = json.loads(spark.read.text(path).first()[0])
    anchor = known.pop("anchor")
    names = {f.name for f in fields(matrix.Settings)}
    return matrix.Settings(
        **{k: v for k, v in known.items() if k in names},
        anchor=datetime.date.fromisoformat(anchor) if anchor else None)


def sealed(spark: SparkSession, folder: str) -> dict[str, str]:
    """What `train` has frozen in the folder, as texts: settings, anchor, columns, and folds by a sum that no order changes."""
    dealt = readers.read_table(spark, f"{folder}/folds").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("card_no", "label", "fold").cast("decimal(20,0)")).alias("sum")).first()
    return {
        "settings": spark.read.text(f"{folder}/settings").first()[0],
        "anchor": str(sinks.read_anchor(spark, f"{folder}/anchor")),
        "columns": json.dumps(sinks.read_manifest(spark, f"{folder}/manifest")),
        "folds": f"{dealt['n']} {dealt['sum']}",
    }


def train(
    spark: SparkSession, paths: Paths, folder: str, settings: matrix.Settings | None = None,
    recipes: list[crossfit.Recipe] = crossfit.DEFAULT_RECIPES,
) -> dict[str, float]:
    """Fit on the train cards and keep everything a later `predict` needs; figures of the out-of-fold blend."""
    with scratch(spark):
        data = ingest(spark, paths, folder)
        settings = frozen(data, settings or matrix.Settings())
        sinks.write_table(folds.stratified_folds(data.train, settings.n_folds), f"{folder}/folds")
        dealt = readers.read_table(spark, f"{folder}/folds")
        built = matrix.build_matrix(data, dealt, settings)
        write_settings(spark, settings, f"{folder}/settings")
        sinks.write_manifest(spark, built.columns, f"{folder}/manifest")
        anchor = spark.createDataFrame([(settings.anchor,)], "anchor_date date")
        sinks.write_anchor(anchor, f"{folder}/anchor", sinks.ANCHOR_NOTE)
        sinks.write_seal(spark, sealed(spark, folder), f"{folder}/seal")
        scores = scoring.cross_fit(built, recipes, settings.n_folds, f"{folder}/models")
        sinks.write_score_vectors(scores, f"{folder}/scores")
        return scoring.offline_figures(scores, data.train).first().asDict()


def predict(
    spark: SparkSession, paths: Paths, folder: str, out: str,
    recipes: list[crossfit.Recipe] = crossfit.DEFAULT_RECIPES,
) -> None:
    """Score the target list with the models of `folder` and write the CSV of scores in its order.

    The batch may bring other transactions and another target list; folds, settings and columns are the trained
    ones. Train cards that the batch does not name keep their transactions of the training log. Raises if they are not what `train` sealed, the columns differ from the manifest or a target card is missing, extra or doubled.
    """
    with scratch(spark):
        data = ingest(spark, paths, f"{out}-work")
        sinks.check_seal(spark, sealed(spark, folder), f"{folder}/seal")
        settings = read_settings(spark, f"{folder}/settings")
        if settings.anchor != sinks.read_anchor(spark, f"{folder}/anchor"):
            raise ValueError("the anchor differs from the one in the settings")
        dealt = readers.read_table(spark, f"{folder}/folds")
        data = replace(data, txn=completed(data.txn, stored(spark, folder).txn, dealt))
        built = matrix.build_matrix(data, dealt, settings)
        sinks.check_manifest(built.columns, sinks.read_manifest(spark, f"{folder}/manifest"))
        used = scoring.with_columns_of(built, recipes)
        rows = crossfit.vectors(built.train().limit(0), built.target(), used, built.columns)
        models = crossfit.load(spark, f"{folder}/models", used, settings.n_folds)
        scores = crossfit.score(rows, models, used, built.columns, settings.n_folds, ("target",))
        quiet = silence.silence_of_rows(data.txn, settings.anchor)
        scored = scoring.predict(scores, quiet, data.target)
        require_complete(scored, data.target)
        sinks.write_scores_csv(scored, out)


def require_complete(scored: DataFrame, target: DataFrame) -> None:
    found = ranking.check_output(scored, target).select(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("missing", "extra", "doubled")]).first()
    if any(found):
        raise ValueError(f"the output is not the target list: {found.asDict()}")
