"""Sinks: parquet tables, score files, the anchor note and the column manifest."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ANCHOR_NOTE = "silence is counted to this day; use the same one for every later batch"


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_scores_csv(scored: DataFrame, path: str, order: str = "row_order") -> None:
    """CSV of (card_no, score) in the row order of the target list.

    A range-partitioned sort: part files follow each other in order, and no task holds all rows.
    """
    (
        scored.orderBy(order).select("card_no", "score")
        .write.mode("overwrite").option("header", True).csv(path)
    )


def write_anchor(anchor: DataFrame, path: str, note: str) -> None:
    """One JSON row with the silence anchor and how to treat it."""
    (
        anchor.select(F.col("anchor_date").cast("string").alias("anchor_date"), F.lit(note).alias("note"))
        .write.mode("overwrite").json(path)
    )


def read_anchor(spark: SparkSession, path: str) -> datetime.date:
    return spark.read.schema("anchor_date date, note string").json(path).first()["anchor_date"]


def _checksum(parts: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def write_seal(spark: SparkSession, parts: dict[str, str], path: str) -> None:
    """Binds what a run has frozen: a digest of every part and one over all of them, as one JSON line."""
    digests = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in parts.items()}
    line = json.dumps({"parts": digests, "checksum": _checksum(digests)}, sort_keys=True)
    spark.createDataFrame([(line,)], "seal string").coalesce(1).write.mode("overwrite").text(path)


def check_seal(spark: SparkSession, parts: dict[str, str], path: str) -> None:
    """Raises if the seal or any part of it is not what was written."""
    sealed = json.loads(spark.read.text(path).first()[0])
    if sealed["checksum"] != _checksum(sealed["parts"]):
        raise ValueError("the seal of the run has been changed")
    digests = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in parts.items()}
    changed = sorted(n for n in digests.keys() | sealed["parts"].keys() if digests.get(n) != sealed["parts"].get(n))
    if changed:
        raise ValueError(f"changed since the run was sealed: {', '.join(changed)}")


def write_manifest(spark: SparkSession, columns: list[str], path: str) -> None:
    rows = [(i, c) for i, c in enumerate(columns)]
    spark.createDataFrame(rows, "pos int, name string").write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Column names in order; a manifest is as long as a table is wide."""
    return [r["name"] for r in spark.read.parquet(path).orderBy("pos").collect()]


def check_manifest(columns: list[str], manifest: list[str]) -> None:
    if list(columns) != list(manifest):
        raise ValueError("feature columns or their order differ from the manifest")


def write_score_vectors(scores: DataFrame, path: str) -> None:
    """Scores keyed by (card_no, family, seed, fold), one folder per family."""
    scores.write.mode("overwrite").partitionBy("family").parquet(path)
