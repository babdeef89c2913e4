"""Registered queries against SQL, and the pipeline's stages one by one."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from comparing import differences
from llm_cases import as_rows, empty, frame
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from cardflow.llm import decontam, line_dedup, simhash
from cardflow.llm.oracles import ORACLES
from cardflow.llm.queries import vocabulary_path

SMALL = "/root/testdata/sf0.001"


def test_one_query_for_every_operator():
    names = list(driver.queries())
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    assert differences(driver.queries()[name](spark, SMALL), con, ORACLES[name]) == []


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "encoding"]


def test_every_stage_keeps_the_columns_and_takes_odd_rows(spark):
    docs = frame(spark)
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SMALL)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert 0 < kept.count() <= docs.count()
        assert function(spark, empty(spark), SMALL).count() == 0
    coded = stage("encoding")(spark, docs, SMALL)
    assert coded.count() == docs.count()


def test_language_stage_keeps_every_lettered_document_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.unionByName(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !?", "en", "s", 8)], docs.schema))
    kept = stage("language")(spark, rows, SMALL)
    assert {r["doc_id"] for r in rows.collect()} - {r["doc_id"] for r in kept.collect()} == {9001, 9002}


def test_line_stage_drops_what_the_operator_drops(spark):
    docs = frame(spark)
    kept = stage("lines")(spark, docs, SMALL)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    got = sorted(map(repr, kept.select("doc_id", digest).collect()))
    assert got == sorted(map(repr, line_dedup.dedup_corpus(docs).select("doc_id", "kept_sha256").collect()))
    cut = kept.filter("text IS NOT NULL AND n_chars IS NOT NULL AND n_chars <> length(text)")
    assert cut.count() == 0


def test_decontamination_stage_equals_the_operator(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    clean = {r["doc_id"] for r in decontam.find_leaks(docs, benchmark).filter("NOT contaminated").collect()}
    assert {r["doc_id"] for r in stage("decontamination")(spark, docs, SMALL).collect()} == clean < {
        r["doc_id"] for r in docs.collect()}


def test_near_duplicate_stage_keeps_the_smallest_of_each_group(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in stage("near_duplicates")(spark, docs, SMALL).collect()}
    assert kept == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}


def test_encoding_stage_keeps_ids_and_texts_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    docs = frame(spark)
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r["doc_id"], len(ids), ids, decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(decoded.encode()).hexdigest()))
    found = as_rows(stage("encoding")(spark, docs, SMALL), "doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=repr)


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SMALL)
    expected = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, driver.queries()["pipeline"](spark, SMALL).collect())) == expected
