"""From raw documents to encoded, clean ones: five stages, each written as Parquet and read by the next.

`run` takes whole texts through language ID, line dedup, SimHash near-dedup, benchmark decontamination and BPE. Null and
empty texts leave at the first stage. Further columns pass through; `n_chars` follows the text where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm import bpe, decontam, langid, line_dedup, simhash
from cardflow.llm.common import fresh
from cardflow.llm.queries import vocabulary_path
from cardflow.sources.store import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found; those without letters or without any known gram go."""
    model = langid.learn(docs, F.lit(True))
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    kept = langid.identify(docs, model, name, score).filter((F.col(name) != langid.UNKNOWN) & (F.col(score) > 0))
    return kept.drop(name, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    index = line_dedup.create(docs)
    lines, dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    kept = line_dedup.dedup(docs, index, lines, dropped)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-equal fingerprints."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and the digests of both: what a trainer reads and what checks it."""
    return bpe.encode_corpus(docs, vocabulary_path(), keep=True)


STAGES = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("encoding", encoding),
]
# SQL cannot learn languages, hash shingles or encode pairs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
