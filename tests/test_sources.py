"""Typed scans, lenient parsing, sinks and the table store."""

import datetime as dt
import json
import pathlib

import pytest

from cardflow.operators.silence import anchor_date
from cardflow.sources import readers, sinks, store


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_transactions_csv(spark, tmp_path):
    names = ",".join(f.name for f in readers.schemas.TXN)
    path = write(
        tmp_path / "txn.csv", names,
        "0012,0012-1,7,2025-12-01 10:00:00,2025-12-01,1.5,100,100,0,c,n,1,interbank_txn,0097,01,0295,0,0,0",
        "0013,0013-1,8,not a time,2025-13-99,NaN,,0,5,,,0,on_us_bank_txn,0056,02,,1,0,0")
    good, bad = readers.read_transactions(spark, path).orderBy("card_no").collect()
    assert good.card_no == "0012" and good.txn_channel_type == "0097" and good.smy_cd == "0295"
    assert good.tms == dt.datetime(2025, 12, 1, 10) and good.stm_dt == dt.date(2025, 12, 1)
    assert bad.tms is None and bad.stm_dt is None
    assert bad.acct_bal is None and bad.txn_amt is None and bad.cntrprt_card_no is None


def test_side_tables_csv(spark, tmp_path):
    card = readers.read_cards(spark, write(
        tmp_path / "card.csv", "card_no,prim_cst_accno,cst_id,crdisu_lvl1_insid,crdisu_lvl2_insid,"
        "card_create_dt,aum_val,mo_da_aum_val", "01,01-1,U1,001,0002,2020-02-30,1.5,2"))
    assert tuple(card.first()) == ("01", "01-1", "U1", "001", "0002", None, 1.5, 2.0)
    accno = readers.read_accounts(spark, write(
        tmp_path / "accno.csv", "card_no,cst_accno,open_accno_dt", "01,01-1,2021-03-04"))
    assert accno.first().open_accno_dt == dt.date(2021, 3, 4)
    cst = readers.read_customers(spark, write(
        tmp_path / "cst.csv", "cst_id,gender,marital_status,occupation,industry", "U1,01,,x,007"))
    assert tuple(cst.first()) == ("U1", "01", None, "x", "007")


def test_label_text(spark, tmp_path):
    path = write(tmp_path / "train.csv", "card_no,label", "a,0.0", "b,1.0", "c,?", "d,300", "e,1e0", "f,NaN", "g,0.7", "h,")
    labels = {r.card_no: r.label for r in readers.read_labels(spark, path).collect()}
    assert labels == {"a": 0, "b": 1, "c": None, "d": None, "e": 1, "f": None, "g": None, "h": None}


def test_columns_bind_by_name(spark, tmp_path):
    cst = readers.read_customers(spark, write(
        tmp_path / "cst.csv", "gender,cst_id,points,industry,occupation,marital_status", "M,U1,12.5,i9,o7,m1",
        "F,U2,none,i8,o6,m0"))
    assert [tuple(r) for r in cst.orderBy("cst_id").collect()] == [
        ("U1", "M", "m1", "o7", "i9", 12.5), ("U2", "F", "m0", "o6", "i8", None)]
    accno = readers.read_accounts(spark, write(
        tmp_path / "accno.csv", "further,open_accno_dt,cst_accno,card_no", "B,2021-03-04,01-1,01"))
    assert tuple(accno.first()) == ("01", "01-1", dt.date(2021, 3, 4))
    with pytest.raises(ValueError, match="open_accno_dt"):
        readers.read_accounts(spark, write(tmp_path / "short.csv", "card_no,cst_accno", "01,01-1"))


def test_files_of_one_table_must_agree(spark, tmp_path):
    folder = tmp_path / "accno"
    folder.mkdir()
    write(folder / "a.csv", "card_no,cst_accno,open_accno_dt", "01,01-1,2021-03-04")
    write(folder / "b.csv", "cst_accno,card_no,open_accno_dt", "02-1,02,2021-03-04")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_accounts(spark, str(folder)).collect()


def test_scores_keep_target_order(spark, tmp_path):
    names = [f"c{(i * 7919) % 10007:05d}" for i in range(5000)]
    path = write(tmp_path / "testa.csv", "card_no", *names)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        target = readers.read_targets(spark, path)
        assert target.rdd.getNumPartitions() > 1
        from pyspark.sql import functions as F

        scored = target.withColumn("score", F.length("card_no").cast("double"))
        out = tmp_path / "scores"
        sinks.write_scores_csv(scored.repartition(5, "card_no"), str(out))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    written = []
    for part in sorted(pathlib.Path(out).glob("part-*.csv")):
        written += [line.split(",")[0] for line in part.read_text().splitlines()[1:]]
    assert written == names


def test_anchor_note(spark, data, tmp_path):
    sinks.write_anchor(anchor_date(data.txn), str(tmp_path / "anchor"), "keep this anchor")
    (part,) = (tmp_path / "anchor").glob("part-*.json")
    note = json.loads(part.read_text())
    assert note == {"anchor_date": note["anchor_date"], "note": "keep this anchor"}
    assert dt.date.fromisoformat(note["anchor_date"]).year >= 2025


def test_manifest(spark, tmp_path):
    columns = [f"f{i}" for i in range(20)]
    sinks.write_manifest(spark, columns, str(tmp_path / "m"))
    kept = sinks.read_manifest(spark, str(tmp_path / "m"))
    assert kept == columns
    sinks.check_manifest(columns, kept)
    with pytest.raises(ValueError):
        sinks.check_manifest(columns[::-1], kept)


def test_tables_and_score_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", "f1", 42, 0, .5), ("b", "f2", 42, 1, .6)],
                               "card_no string, family string, seed int, fold int, score double")
    sinks.write_table(df, str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), ["card_no"]).columns == ["card_no"]
    sinks.write_score_vectors(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("family = 'f1'").count() == 1


def test_store_reuses_by_parameters(spark):
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    read = lambda df, k: store.materialize_once(lambda: df, spark, "demo", {"k": k}).first().x
    assert [read(one, 1), read(two, 1), read(two, 2)] == [1, 1, 2]


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    df = spark.range(100).selectExpr("id AS card_no", "id % 7 AS x")
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError), store.scratch(spark):
        with store.scratch(spark):
            store.materialize_by_key(df, "inner", "card_no", 4)
        assert not list((tmp_path / "cardflow").iterdir())
        assert store.materialize(df, "outer", partition_by=["x"]).count() == 100
        raise RuntimeError
    assert not list((tmp_path / "cardflow").iterdir())
    assert {t.name for t in spark.catalog.listTables()} == before



def test_reuse_ends_when_an_input_changes(spark, tmp_path):
    source, made = str(tmp_path / "input"), []

    def write(n, mode="overwrite"):
        spark.range(n).selectExpr("id AS x").write.mode(mode).parquet(source)

    def total():
        def make():
            made.append(1)
            return spark.read.parquet(source).selectExpr("sum(x) AS s")

        return store.materialize_once(make, spark, "total", {"of": "x"}, [source]).first().s

    write(10)
    assert (total(), total(), len(made)) == (45, 45, 1)
    write(10, "append")
    assert (total(), total(), len(made)) == (90, 90, 2)
    write(20)
    assert (total(), len(made)) == (190, 3)


def test_a_seal_tells_which_part_has_changed(spark, tmp_path):
    path, parts = str(tmp_path / "seal"), {"anchor": "2025-12-31", "columns": "[1, 2]"}
    sinks.write_seal(spark, parts, path)
    sinks.check_seal(spark, parts, path)
    with pytest.raises(ValueError, match="changed since the run was sealed: anchor"):
        sinks.check_seal(spark, parts | {"anchor": "2026-01-01"}, path)
    with pytest.raises(ValueError, match="folds"):
        sinks.check_seal(spark, parts | {"folds": "x"}, path)
    line = spark.read.text(path).first()[0].replace('"checksum": "', '"checksum": "0')
    spark.createDataFrame([(line,)], "seal string").coalesce(1).write.mode("overwrite").text(path)
    with pytest.raises(ValueError, match="the seal of the run"):
        sinks.check_seal(spark, parts, path)


def test_round_trip_files_are_compressed(spark, data):
    """The text of the whole log is the largest thing that the CSV queries write."""
    import os

    from cardflow.plans.registry import _written

    path = _written(data.target, "target-csv").removeprefix("file:")
    assert {f.split(".", 1)[1] for f in os.listdir(path) if f.startswith("part-")} == {"csv.gz"}
