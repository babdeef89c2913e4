"""Event order on hand-made rows, and heavy cards against the plain path."""

import datetime as dt

import pytest
from comparing import same
from pyspark.sql import functions as F

from cardflow.operators import sequence
from cardflow.operators.accounts import balance_consistency
from cardflow.operators.timeline import enrich, heavy_cards, tail_rows
from cardflow.sources import schemas

COLUMNS = ("card_no string, cst_accno string, accno_txn_sn long, tms timestamp_ntz, stm_dt date, "
           "acct_bal double, txn_amt double, inflow_amt double, outflow_amt double, "
           "cntrprt_card_no string, cntrprt_name string, cntrprt_prvt_ind double, "
           "cntrprt_clear_type string, txn_channel_type string, txn_cgycd string, smy_cd string")


def row(card, acc, sn, tms, bal, paid_in, paid_out):
    when = dt.datetime.fromisoformat(tms) if tms else None
    return (card, acc, sn, when, when.date() if when else None, bal, paid_in or paid_out, paid_in,
            paid_out, None, None, None, None, None, None, None)


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        # same second, two accounts, equal serials: the account number decides
        row("A", "a2", 1, "2025-12-01 10:00:00", 5.0, 0.0, 10.0),
        row("A", "a1", 1, "2025-12-01 10:00:00", 4.0, 100.0, 0.0),
        row("A", "a1", 2, "2025-12-01 10:00:30", 3.0, 0.0, 20.0),
        row("A", "a1", 3, "2025-12-02 12:00:30", None, 0.0, 20.0),
        # no inflow, and a row without a time
        row("B", "b1", 1, None, 1.0, 0.0, 5.0),
        row("B", "b1", 2, "2025-12-05 00:00:00", 2.0, 0.0, 5.0),
        # one row, both directions
        row("C", "c1", 1, "2025-12-06 00:00:00", 9.0, 7.0, 3.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by_place(df):
    return {(r.card_no, r.cst_accno, r.accno_txn_sn): r for r in df.collect()}


def test_event_order_and_gaps(small):
    rows = by_place(enrich(small))
    assert [rows["A", a, s].rn_end for a, s in (("a1", 1), ("a2", 1), ("a1", 2), ("a1", 3))] == [3, 2, 1, 0]
    assert rows["A", "a1", 1].is_first and not rows["A", "a2", 1].is_first
    assert rows["A", "a1", 1].gap_sec is None
    assert rows["A", "a2", 1].gap_sec == 0
    assert rows["A", "a1", 3].gap_sec == 93600
    assert rows["A", "a1", 3].days_before == 0 and rows["A", "a1", 2].days_before == 1


def test_inflow_state(small):
    rows = by_place(enrich(small))
    assert rows["A", "a2", 1].io_flip and not rows["A", "a1", 2].io_flip
    assert rows["A", "a1", 1].is_last_in
    assert [rows["A", "a1", s].after_last_in for s in (1, 2, 3)] == [False, True, True]
    assert rows["A", "a1", 2].out_after_in_sec == 30
    # a card without inflow has nothing after it
    assert not rows["B", "b1", 2].after_last_in and rows["B", "b1", 2].out_after_in_sec is None
    # a row that pays in and out counts itself as the latest inflow
    assert rows["C", "c1", 1].out_after_in_sec == 0 and rows["C", "c1", 1].is_last_in


def test_row_without_time_comes_first(small):
    rows = by_place(enrich(small))
    assert rows["B", "b1", 1].rn_end == 1 and rows["B", "b1", 1].sec_before is None
    assert rows["B", "b1", 2].gap_sec is None


def test_last_row_keeps_null(small):
    last = {r.card_no: r for r in sequence.last_row(small).collect()}
    assert last["A"].last_bal2 is None and last["A"].last_is_out == 1
    path = {r.card_no: r for r in sequence.balance_path(enrich(small)).collect()}
    assert path["A"].bal_first == 4.0 and path["A"].bal_prev1 == 3.0 and path["A"].bal_delta is None
    assert path["C"].bal_prev1 is None


def test_single_row_account_has_no_residual(small):
    rows = {r.card_no: r for r in balance_consistency(small).collect()}
    assert rows["C"].AB_resid_after_p90 is None and rows["C"].AB_acc_resid_best_p90_mean is None
    # (2 - 1) - (0 - 5) = 6
    assert rows["B"].AB_resid_after_p90 == 6.0


@pytest.mark.parametrize("slice_seconds", [60, 86400])
def test_heavy_card_equals_plain_path(hot_txn, slice_seconds):
    busy = heavy_cards(hot_txn, 500)
    assert [r.card_no for r in busy.collect()] == ["HOT"]
    none = heavy_cards(hot_txn, 10**9)
    assert same(enrich(hot_txn, busy, slice_seconds), enrich(hot_txn, none))


def test_every_card_heavy_equals_plain_path(small):
    columns = [c for c in enrich(small).columns]
    sliced = enrich(small, heavy_cards(small, 0), 60).select(*columns)
    assert same(sliced, enrich(small))


def test_heavy_accounts_equal_plain_path(hot_txn):
    assert same(
        balance_consistency(hot_txn, heavy_cards(hot_txn, 500), 86400),
        balance_consistency(hot_txn, heavy_cards(hot_txn, 10**9)))
    assert same(
        balance_consistency(hot_txn, heavy_cards(hot_txn, 0), 3600),
        balance_consistency(hot_txn, heavy_cards(hot_txn, 10**9)))


def test_tail_limits_before_the_shuffle(hot_txn):
    plan = tail_rows(hot_txn, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    counts = tail_rows(hot_txn, 5).groupBy("card_no").count()
    assert counts.agg(F.max("count")).first()[0] == 5


def test_schemas_name_all_columns():
    assert len(schemas.TXN) == 19


def test_tasks_follow_the_rows(spark, data, monkeypatch):
    """Twice the rows take twice the tasks, whatever the number of shuffle partitions, and give the same values."""
    from cardflow.operators import accounts, timeline

    n = data.txn.count()
    whole = enrich(data.txn), accounts.balance_consistency(data.txn)
    monkeypatch.setattr(timeline, "ROWS_PER_TASK", -(-n // 40))
    assert timeline.task_count(spark, 2 * n) == 2 * timeline.task_count(spark, n) == 80
    cut = enrich(data.txn), accounts.balance_consistency(data.txn)
    for few, many in zip(whole, cut):
        assert many.rdd.getNumPartitions() == 40 and same(few, many)
