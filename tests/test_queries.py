"""Every registered query against its SQL on the smallest tables."""

import pytest
from comparing import differences, duck
from conftest import SMALL

import __spark_entry__ as driver
from cardflow.plans.oracles import all_oracles
from cardflow.plans.registry import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_only_model_fitting_has_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"crossfit_scores"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert differences(result, con, ORACLES[name]) == []


def test_driver_has_them_all():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_both_engines_round_halves_alike(spark):
    """Shares such as 41 / 640 lie halfway between two results; both engines must take the upper one."""
    from cardflow.plans.oracles import _r
    from cardflow.plans.registry import presented

    shares = presented(spark.range(1, 3200).selectExpr("id as p", "id / 640 as x", "-id / 3200 as y"))
    import duckdb

    sql = f"select p, {_r('p / 640', 'x')}, {_r('-p / 3200', 'y')} from range(1, 3200) r(p)"
    assert differences(shares, duckdb.connect(), sql) == []


def test_cards_that_only_take_in_have_no_outgoing_exposure(spark, tmp_path):
    """Their edges belong to no outgoing variant: no row of their own in `exposure_ref`, nulls beside the others in `exposure_all`."""
    import os

    from pyspark.sql import functions as F

    for name in ("customer", "supplier", "part", "orders", "events", "region", "nation"):
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines, orders = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("lineitem", "orders"))
    taking = orders.filter("o_custkey % 20 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("R").alias("_taken"))
    lines.join(taking, "l_orderkey", "left").withColumn("l_returnflag", F.coalesce("_taken", "l_returnflag")).drop(
        "_taken").coalesce(1).write.parquet(str(tmp_path / "lines"))
    [part] = (tmp_path / "lines").glob("part-*.parquet")
    os.symlink(part, tmp_path / "lineitem.parquet")
    con, found = duck(str(tmp_path)), {}
    for name in ("exposure_ref", "exposure_all"):
        found[name] = QUERIES[name](spark, str(tmp_path))
        assert differences(found[name], con, ORACLES[name]) == []
    assert 0 < found["exposure_ref"].count() < found["exposure_all"].count()
