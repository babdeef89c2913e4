"""Steps that many queries share move each row once and give the same results on the paths for heavy keys."""

from comparing import same
from conftest import SMALL
from pyspark.sql import functions as F

from cardflow.operators import exposure, silence
from cardflow.operators.timeline import enrich
from cardflow.plans.registry import _BUILDERS, Inputs
from cardflow.sources.store import materialize


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_silence_sorts_no_rows_in_time(spark):
    """The ends of cards come from aggregations: no window, and the anchor needs no further pass over the rows."""
    plan = executed(_BUILDERS["silence_base"](Inputs(spark, SMALL)))
    assert "Window" not in plan and plan.count("lineitem.parquet") <= 1


def test_silence_of_rows_equals_enriched(spark, data):
    """With heavy cards, rows without a card, and cards of which some or all rows have no time."""
    number = F.col("accno_txn_sn") % 7
    card = F.when(F.col("card_no").cast("int") % 3 == 0, "HOT").when(number > 0, F.col("card_no"))
    untimed = (number == 2) | (F.col("card_no").cast("int") % 10 == 1)
    txn = materialize(data.txn.withColumns({"card_no": card, "tms": F.when(~untimed, F.col("tms"))}), "odd-txn")
    wanted = materialize(silence.silence_base(enrich(txn)), "wanted")
    assert wanted.filter("card_no is null").count() == 1 and wanted.filter("sil_days is null").count() > 0
    for heavy_rows in (20, 10**6):
        assert same(silence.silence_of_rows(txn, heavy_rows=heavy_rows), wanted)


def test_exposure_reads_rows_written_once(spark):
    """Account and name edges come from one bucketed copy of the transactions; counts of all folds move unexpanded."""
    made = executed(Inputs(spark, SMALL).matched(exposure.TARGET))
    assert "Generate explode" in made and "lineitem" not in made
    below = made[made.index("Generate explode"):]
    assert "REPARTITION_BY_COL" in below and "partial_" not in below[:below.index("REPARTITION_BY_COL")]
