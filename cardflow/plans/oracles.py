"""Independent SQL for every registered query, runnable by DuckDB on the same parquet tables."""

from __future__ import annotations

from cardflow.constants import (
    ACCOUNT_VARIANTS, CHANNEL_CODES, EXPOSURE_STATS, FREQUENCY_COLUMNS, LAST_ROW_CHANNELS,
    NAME_VARIANTS, SILENCE_COLUMNS,
)
from cardflow.sources.sinks import ANCHOR_NOTE

# Limits that fit the adapter data; the registry uses the same.
ACCOUNT_LIMIT = 30
NAME_LIMIT = 500
COVERAGE_FLOOR = 50
# Label texts of every 17th customer and its followers.
ODD_LABELS = ["n/a", "300", "NaN", "0.7", "1e0"]
MATRIX_TOP_SUMMARY = [f"{i:04d}" for i in range(15)]
MATRIX_MORE_SUMMARY = [f"{i:04d}" for i in range(15, 40)]
MATRIX_MORE_CHANNELS = ["0002", "0004", "0005", "0007"]

_PRELUDE = """
s as (
  select *, timestamp '2025-12-01 00:00:00' + to_seconds(
      date_diff('day', date '1995-01-01', cast(l_shipdate as date)) * 1080
      + (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 613) % 1080
      - 86400 * (case when o_custkey % 50 = 0 then 35 else o_custkey % 12 end)) as tms
  from lineitem join orders on l_orderkey = o_orderkey),
txn as (
  select cast(o_custkey as varchar) as card_no,
    concat(cast(o_custkey as varchar), '-', substr(o_orderpriority, 1, 1)) as cst_accno,
    ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as accno_txn_sn,
    tms, cast(tms as date) as stm_dt,
    cast(floor(l_extendedprice) - floor(l_quantity) as double) as acct_bal,
    cast(floor(l_extendedprice / 50) * 50 as double) as txn_amt,
    cast(case when l_returnflag = 'R' then floor(l_extendedprice / 50) * 50 else 0 end as double) as inflow_amt,
    cast(case when l_returnflag = 'R' then 0 else floor(l_extendedprice / 50) * 50 end as double) as outflow_amt,
    case when l_linenumber = 7 then null else cast(l_partkey as varchar) end as cntrprt_card_no,
    case when l_linenumber = 6 then null else concat('S', cast(l_suppkey as varchar)) end as cntrprt_name,
    cast(l_suppkey % 2 as double) as cntrprt_prvt_ind,
    case when l_linestatus = 'O' then 'interbank_txn' else 'on_us_bank_txn' end as cntrprt_clear_type,
    lpad(cast(l_linenumber as varchar), 4, '0') as txn_channel_type,
    case when l_partkey % 10 = 0 then '01' else '02' end as txn_cgycd,
    case when l_partkey % 41 = 40 then null else lpad(cast(l_partkey % 41 as varchar), 4, '0') end as smy_cd,
    cast(l_partkey % 3 = 0 as int) * 1e0 as rmrk_recharge_withdrawal_ind,
    cast(l_partkey % 5 = 0 as int) * 1e0 as rmrk_short_ind,
    cast(l_partkey % 7 = 0 as int) * 1e0 as rmrk_e_credit_ind
  from s),
card as (
  select cast(c_custkey as varchar) as card_no, concat(cast(c_custkey as varchar), '-1') as prim_cst_accno,
    concat('U', cast(c_custkey - c_custkey % 2 as varchar)) as cst_id,
    cast(c_nationkey % 5 as varchar) as crdisu_lvl1_insid, cast(c_nationkey as varchar) as crdisu_lvl2_insid,
    cast(date '2020-01-01' + to_days(cast(c_custkey % 1500 as int)) as date) as card_create_dt,
    floor(c_acctbal) * 1e0 as aum_val, floor(c_acctbal / 2) * 1e0 as mo_da_aum_val
  from customer
  union all select cast(1000000000 + s_suppkey as varchar), concat(cast(1000000000 + s_suppkey as varchar), '-1'),
    concat('U', cast(s_suppkey as varchar)), cast(s_nationkey % 5 as varchar), cast(s_nationkey as varchar),
    cast(date '2020-01-01' + to_days(cast(s_suppkey % 1500 as int)) as date),
    floor(s_acctbal) * 1e0, floor(s_acctbal / 2) * 1e0
  from supplier),
cst as (
  select concat('U', cast(c_custkey as varchar)) as cst_id,
    case when c_custkey % 7 = 0 then null else cast(c_custkey % 3 as varchar) end as gender,
    cast(c_custkey % 4 as varchar) as marital_status, c_mktsegment as occupation,
    cast(c_nationkey % 6 as varchar) as industry
  from customer),
accno as (
  select distinct cast(o_custkey as varchar) as card_no,
    concat(cast(o_custkey as varchar), '-', substr(o_orderpriority, 1, 1)) as cst_accno,
    cast(date '2021-01-01' + to_days(cast(o_custkey % 700
      + cast(substr(o_orderpriority, 1, 1) as int) * 30 as int)) as date) as open_accno_dt
  from orders),
listed as (
  select c_custkey as id, c_acctbal as held from customer
  union all select 1000000000 + s_suppkey, s_acctbal from supplier),
train as (
  select cast(id as varchar) as card_no, cast(case when held < 0 then 1 else 0 end as bigint) as label
  from listed where id % 5 <> 0),
target as (
  select cast(id as varchar) as card_no, id as row_order from listed where id % 5 = 0),
e0 as (
  select *, hour(tms) as hour, inflow_amt > 0 as is_in, outflow_amt > 0 as is_out,
    max(stm_dt) over (partition by card_no) as anchor_dt,
    max(tms) over (partition by card_no) as anchor_tms,
    row_number() over (partition by card_no order by tms desc, accno_txn_sn desc, cst_accno desc) - 1 as rn_end,
    lag(tms) over w as prev_tms,
    lag(inflow_amt > 0) over w as prev_in,
    last_value(case when inflow_amt > 0 then tms end ignore nulls) over (
      partition by card_no order by tms, accno_txn_sn, cst_accno
      rows between unbounded preceding and current row) as last_in_tms
  from txn window w as (partition by card_no order by tms, accno_txn_sn, cst_accno)),
e as (
  select *, date_diff('day', stm_dt, anchor_dt) as days_before,
    date_sub('second', tms, anchor_tms) as sec_before,
    date_sub('second', prev_tms, tms) as gap_sec,
    case when is_out then date_sub('second', last_in_tms, tms) end as out_after_in_sec,
    is_out and prev_in as io_flip,
    min(case when is_in then rn_end end) over (partition by card_no) as last_in_rn
  from e0),
ordered as (select *, {t: tms, n: accno_txn_sn, a: cst_accno} as place from e)
"""


def _r(expr: str, name: str, digits: int = 6) -> str:
    # Rounding to 9 places first lets both engines agree on values halfway between two results. The second rounding is
    # one of decimals: DuckDB rounds a double by multiplying it, which takes 41 / 640 = 0.0640625 down to 0.064062.
    return f"cast(round(cast(round({expr}, 9) as decimal(38, 9)), {digits}) as double) as {name}"


def _uniques(column: str, where: str | None = None) -> str:
    """Distinct values, null counted as one."""
    keep = f" filter (where {where})" if where else ""
    return (f"count(distinct {column}){keep} + "
            f"coalesce(max(case when {column} is null then 1 else 0 end){keep}, 0)")


def _sum0(column: str, where: str) -> str:
    return f"coalesce(sum({column}) filter (where {where}), 0)"


def _share(pred: str, where: str | None = None) -> str:
    keep = f" filter (where {where})" if where else ""
    return f"avg(cast({pred} as double)){keep}"


def _lines(parts: list[str]) -> str:
    return ",\n    ".join(parts)


def _lookback_days() -> str:
    parts = []
    for w in (1, 3, 7):
        near = f"days_before < {w}"
        parts += [f"count(*) filter (where {near}) as n_txn_w{w}",
                  f"{_sum0('inflow_amt', near)} as in_sum_w{w}",
                  f"{_sum0('outflow_amt', near)} as out_sum_w{w}"]
    return _lines(parts)


def _lookback_seconds() -> str:
    parts = []
    for tag, seconds in (("h1", 3600), ("h6", 21600), ("h24", 86400)):
        near = f"sec_before < {seconds}"
        parts += [
            f"count(*) filter (where {near}) as {tag}_n",
            f"{_sum0('outflow_amt', near)} as {tag}_out_sum",
            f"{_sum0('inflow_amt', near)} as {tag}_in_sum",
            f"{_uniques('cntrprt_card_no', near)} as {tag}_n_cp",
            _r(f"avg(cntrprt_prvt_ind) filter (where {near})", f"{tag}_prvt"),
            _r(_share("cntrprt_clear_type = 'interbank_txn'", near), f"{tag}_interbank")]
    return _lines(parts)


def _last_k() -> str:
    parts = []
    for k in (3, 20):
        near = f"rn_end < {k}"
        parts += [
            _r(_share("is_out", near), f"last{k}_out_share"),
            f"{_sum0('outflow_amt', near)} as last{k}_out_sum",
            f"{_uniques('cntrprt_card_no', near)} as last{k}_n_cp",
            _r(f"avg(cntrprt_prvt_ind) filter (where {near})", f"last{k}_prvt"),
            _r(f"avg(txn_amt) filter (where {near})", f"last{k}_amt_mean")]
    five, ten = "rn_end < 5", "rn_end < 10"
    parts += [
        _r(_share("is_out", five), "last5_out_share"),
        f"{_sum0('outflow_amt', five)} as last5_out_sum",
        f"{_sum0('inflow_amt', five)} as last5_in_sum",
        _r(f"avg(txn_amt) filter (where {five})", "last5_amt_mean"),
        f"min(acct_bal) filter (where {five}) as last5_bal_min",
        _r(_share("is_out", ten), "last10_out_share"),
        f"{_sum0('outflow_amt', ten)} as last10_out_sum",
        f"{_uniques('cntrprt_card_no', ten)} as last10_n_cntrprt",
        _r(f"avg(cntrprt_prvt_ind) filter (where {ten})", "last10_prvt_share"),
        _r(_share("cntrprt_clear_type = 'interbank_txn'", ten), "last10_interbank"),
        f"max(txn_amt) filter (where {ten}) as last10_amt_max",
        _r(f"avg(hour) filter (where {ten})", "last10_hour_mean")]
    return _lines(parts)


def _code_columns(column: str, names: dict[str, str]) -> str:
    return _lines([_r(_share(f"{column} = '{c}'"), n) for c, n in names.items()])


_CHANNEL_NAMES = {c: f"ch{c}_share" for c in CHANNEL_CODES} | {c: f"ch2_{c}" for c in MATRIX_MORE_CHANNELS}
_SUMMARY_NAMES = ({c: f"smy_{c}_share" for c in MATRIX_TOP_SUMMARY}
                  | {c: f"smy2_{c}" for c in MATRIX_MORE_SUMMARY})


def _sender(key: str, tag: str) -> str:
    return f"""
  select card_no, max(deg) as {tag}_deg_max, {_r('avg(deg)', f'{tag}_deg_mean')},
    {_r('coalesce(sum(amt) filter (where deg >= 2), 0) / (sum(amt) + 1)', f'{tag}_amt_deg2_share')},
    {_r('coalesce(sum(amt) filter (where deg >= 5), 0) / (sum(amt) + 1)', f'{tag}_amt_deg5_share')},
    count(*) filter (where deg >= 2) as {tag}_n_senders_deg2,
    {_r('avg(cast(n = 1 as double))', f'{tag}_oneoff_share')}
  from (select *, count(*) over (partition by k) as deg from (
    select card_no, {key} as k, count(*) as n, sum(inflow_amt) as amt
    from e where is_in and {key} is not null group by 1, 2)) group by 1"""


def _edge(key: str) -> str:
    return f"""
select card_no, {key} as key, count(*) as n, count(*) filter (where outflow_amt > 0) as out_n,
  sum(outflow_amt) as out_sum, count(*) filter (where inflow_amt > 0) as in_n, sum(inflow_amt) as in_sum,
  max(cntrprt_prvt_ind) as prvt
from txn where {key} is not null group by 1, 2"""


_VARIANT_ROWS = f"""
select 'aa' as variant, card_no, key, n, out_sum as amt from edge_account
union all select 'ao', card_no, key, n, out_sum from edge_account where out_n > 0
union all select 'ai', card_no, key, n, in_sum from edge_account where in_n > 0
union all select 'aol', card_no, key, n, out_sum from edge_account where out_n > 0 and key in
  (select key from edge_account group by key having count(distinct card_no) <= {ACCOUNT_LIMIT})
union all select 'aop', card_no, key, n, out_sum from edge_account where out_n > 0 and prvt = 1
union all select 'na', card_no, key, n, out_sum from edge_name
union all select 'no', card_no, key, n, out_sum from edge_name where out_n > 0
union all select 'nol', card_no, key, n, out_sum from edge_name where out_n > 0 and key in
  (select key from edge_name group by key having count(distinct card_no) <= {NAME_LIMIT})"""

_STATS = f"""
max(nf) as nf_max, count(*) filter (where nf >= 1) as ncp_f1, count(*) filter (where nf >= 2) as ncp_f2,
{_r('max(nf / (nc + 1))', 'rate_max')}, {_r('sum(nf / (nc + 1) * n) / sum(n)', 'rate_wavg')},
coalesce(sum(amt) filter (where nf >= 1), 0) as amt_f,
{_r('coalesce(sum(n) filter (where nf >= 1), 0) / sum(n)', 'txnf_share')}"""


def _exposure_wide(keys: str, source: str) -> str:
    columns = [f"max({s}) filter (where variant = '{v}') as {v}_{s}"
               for v in ACCOUNT_VARIANTS + NAME_VARIANTS for s in EXPOSURE_STATS]
    return f"select {keys}, {_lines(columns)} from {source} group by {keys}"


# Direct reading of the definition: label counts of the other folds, for each fold.
_EXPOSURE_LONG = f"""
select variant, side, card_no, fold, {_STATS} from (
  select v.variant, seat.side, v.card_no, seat.fold, v.n, v.amt,
    coalesce(cp.nf, 0) as nf, coalesce(cp.nc, 0) as nc
  from edge_variants v
  join (select 'train' as side, card_no, fold from stratified_folds
        union all select 'target', card_no, k from target, range(5) r(k)) seat on v.card_no = seat.card_no
  left join (
    select v.variant, v.key, k, count(distinct v.card_no) filter (where f.label = 1) as nf,
      count(distinct v.card_no) as nc
    from edge_variants v join stratified_folds f on v.card_no = f.card_no, range(5) r(k)
    where f.fold <> k group by 1, 2, 3) cp
  on cp.variant = v.variant and cp.key = v.key and cp.k = seat.fold)
group by 1, 2, 3, 4"""

_EXPOSURE_WHOLE = f"""
select variant, card_no, {_STATS} from (
  select v.variant, v.card_no, v.n, v.amt, coalesce(cp.nf, 0) as nf, coalesce(cp.nc, 0) as nc
  from edge_variants v join target using (card_no)
  left join (
    select v.variant, v.key, count(distinct v.card_no) filter (where t.label = 1) as nf,
      count(distinct v.card_no) as nc
    from edge_variants v join train t using (card_no) group by 1, 2) cp
  on cp.variant = v.variant and cp.key = v.key)
group by 1, 2"""


def _pct(bin_name: str, value: str, name: str) -> str:
    return (f"case when {value} is not null then round((rank() over (partition by {bin_name} order by {value}) "
            f"+ (count(*) over (partition by {bin_name}, {value}) - 1) / 2.0) "
            f"/ count({value}) over (partition by {bin_name}), 6) end as {name}")


def _nearest(value: str) -> str:
    return (f"list_sort(list({value}) filter (where {value} is not null))"
            f"[cast(round((count({value}) - 1) * 0.9e0) as bigint) + 1]")


_INTERACTIONS = _lines([
    _r("ln(1 + n_txn) * sil_days", "ntxn_x_sil"),
    _r("n_txn / (sil_days + 1)", "ntxn_div_sil"),
    _r("ln(1 + case when in_sum < 0 then 0 else in_sum end) * sil_days", "insum_x_sil"),
    _r("ln(1 + case when bal_last < 0 then 0 else bal_last end) * sil_days", "bal_x_sil"),
    _r("n_t1 / n_txn * sil_days", "t1share_x_sil"),
    _r("n_t3 / n_txn * sil_days", "t3share_x_sil"),
    _r("ln(1 + case when in_sum < out_sum then 0 else in_sum - out_sum end) * sil_days", "netflow_x_sil"),
    _r("case when in_sum < out_sum then 0 else in_sum - out_sum end / (in_sum + 1) * sil_days", "retention_x_sil"),
    _r("n_txn / (span_days + 1) * sil_days", "txnrate_x_sil"),
    _r("sil_days / (span_days + 1)", "sil_div_span"),
])

# Whole-number scores that need no model: three families, one of them with two seeds.
_SCORES = """
select card_no, family, seed, fold, cast(score + fold * (cast(card_no as bigint) % 3) as double) as score from (
  select card_no, 'boosted' as family, 42 as seed, n_txn * 3 + sil_days as score from silence_base
  union all select card_no, 'narrow', 42, (n_txn * 7 + sil_days * 5) % 101 from silence_base
  union all select card_no, 'narrow', 2026, n_t7 * 2 + last_hour from silence_base
  union all select card_no, 'forest', 42, cast(bal_last as bigint) % 5000 from silence_base
), range(5) r(fold)"""

_RANK = "(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count(*) over (partition by {by})"

_BODIES: dict[str, tuple[list[str], str]] = {
    "card_anchor": ([], """
select t.*, m.grp from (
  select card_no, max(stm_dt) as last_dt, min(stm_dt) as first_dt, count(*) as n_txn,
    date_diff('day', min(stm_dt), max(stm_dt)) as span_days from txn group by 1) t
left join (select card_no, cast(label as varchar) as grp from train
           union all select card_no, 'target' from target) m using (card_no)"""),
    "enriched_txn": ([], """
select card_no, cst_accno, accno_txn_sn, tms, stm_dt, hour, is_in, is_out, anchor_dt, anchor_tms, days_before,
  sec_before, rn_end, gap_sec, out_after_in_sec, io_flip, coalesce(rn_end < last_in_rn, false) as after_last_in
from e"""),
    "flow_aggregates": ([], f"""
select card_no, count(*) as n_txn, {_uniques('stm_dt')} as n_days, max(days_before) as span_days,
  {_uniques('cst_accno')} as n_accno_used, count(*) filter (where is_in) as n_in, sum(inflow_amt) as in_sum,
  {_r('avg(inflow_amt) filter (where is_in)', 'in_mean')}, max(inflow_amt) as in_max,
  {_r('stddev_samp(inflow_amt) filter (where is_in)', 'in_std', 4)},
  count(*) filter (where is_out) as n_out, sum(outflow_amt) as out_sum,
  {_r('avg(outflow_amt) filter (where is_out)', 'out_mean')}, max(outflow_amt) as out_max,
  {_r('stddev_samp(outflow_amt) filter (where is_out)', 'out_std', 4)}
from e group by 1"""),
    "balance_aggregates": ([], f"""
select card_no, arg_max_null(acct_bal, place) as bal_last, min(acct_bal) as bal_min, max(acct_bal) as bal_max,
  {_r('avg(acct_bal)', 'bal_mean')}, {_r('stddev_samp(acct_bal)', 'bal_std', 4)}
from ordered group by 1"""),
    "mix_shares": ([], f"""
select card_no, {_uniques('cntrprt_card_no')} as n_cntrprt, {_r('avg(cntrprt_prvt_ind)', 'prvt_share')},
  {_r(_share("cntrprt_clear_type = 'interbank_txn'"), 'interbank_share')},
  {_r(_share("cntrprt_clear_type = 'on_us_bank_txn'"), 'onus_share')},
  {_r(_share("txn_cgycd = '01'"), 'cash_share')}, {_uniques('smy_cd')} as n_smy,
  {_uniques('txn_channel_type')} as n_channel, {_r('avg(rmrk_recharge_withdrawal_ind)', 'rmrk_rw_share')},
  {_r('avg(rmrk_short_ind)', 'rmrk_short_share')}, {_r('avg(rmrk_e_credit_ind)', 'rmrk_ec_share')},
  {_r(_share('hour < 6'), 'night_share')}, {_uniques('hour')} as n_hours
from e group by 1"""),
    "gap_stats": ([], f"""
select card_no, {_r('avg(gap_sec)', 'gap_mean')}, {_r('median(gap_sec)', 'gap_median')}, min(gap_sec) as gap_min,
  count(*) filter (where gap_sec < 60) as n_burst60 from e group by 1"""),
    "fast_in_out": ([], f"""
select card_no, min(out_after_in_sec) as fio_min, {_r('median(out_after_in_sec)', 'fio_median')},
  count(*) filter (where out_after_in_sec < 3600) as n_fastout_1h,
  count(*) filter (where out_after_in_sec < 86400) as n_fastout_1d from e group by 1"""),
    "amount_shape": ([], f"""
select card_no, {_r(_share('txn_amt % 100 = 0 and txn_amt > 0'), 'round100_share')},
  {_r(_share('txn_amt % 1000 = 0 and txn_amt > 0'), 'round1000_share')},
  count(*) filter (where txn_amt >= 10000) as n_big1w, count(*) filter (where txn_amt >= 50000) as n_big5w
from txn group by 1"""),
    "day_lookbacks": ([], f"select card_no, {_lookback_days()} from e group by 1"),
    "channel_shares": ([], f"select card_no, {_code_columns('txn_channel_type', _CHANNEL_NAMES)} from txn group by 1"),
    "summary_shares": ([], f"select card_no, {_code_columns('smy_cd', _SUMMARY_NAMES)} from txn group by 1"),
    "top_codes": ([], """
select smy_cd as code, count(*) as n_rows from txn where smy_cd is not null group by 1
order by n_rows desc, code limit 15"""),
    "top_code_shares": (["top_codes"], """
select card_no, smy_cd as code, round(count(*) / any_value(coded), 6) as share
from (select *, count(smy_cd) over (partition by card_no) as coded from txn)
where smy_cd in (select code from top_codes) group by 1, 2"""),
    "dynamic_codes": (["top_codes"], f"""
select * from (select 'smy_cd' as field, smy_cd as code, count(distinct card_no) as n_cards from txn
  where smy_cd is not null and smy_cd not in (select code from top_codes)
  group by 2 having count(distinct card_no) >= {COVERAGE_FLOOR} order by n_cards desc, code limit 80)
union all
select * from (select 'txn_channel_type' as field, txn_channel_type as code, count(distinct card_no) as n_cards
  from txn where txn_channel_type is not null
    and txn_channel_type not in ({", ".join(f"'{c}'" for c in CHANNEL_CODES)})
  group by 2 having count(distinct card_no) >= {COVERAGE_FLOOR} order by n_cards desc, code limit 40)"""),
    "top_counterparty": ([], f"""
select card_no, max(n) as cp_top1_cnt, cast(sum(n) as bigint) as cp_cnt_total,
  {_r('max(n) / sum(n)', 'cp_top1_share')}
from (select card_no, cntrprt_card_no, count(*) as n from txn where cntrprt_card_no is not null group by 1, 2)
group by 1"""),
    "static_profile": ([], """
select c.card_no, c.aum_val, c.mo_da_aum_val, n.cst_n_cards, a.n_accounts,
  date_diff('day', c.card_create_dt, t.anchor) as card_age_d,
  date_diff('day', a.opened_first, t.anchor) as acc_age_max_d,
  date_diff('day', a.opened_last, t.anchor) as acc_age_min_d
from card c left join (select cst_id, count(*) as cst_n_cards from card group by 1) n using (cst_id)
left join (select card_no, count(*) as n_accounts, min(open_accno_dt) as opened_first,
             max(open_accno_dt) as opened_last from accno group by 1) a using (card_no)
left join (select card_no, max(stm_dt) as anchor from txn group by 1) t using (card_no)"""),
    "frequency_encoding": ([], f"""
select card_no, {_lines([f"case when {c} is not null then count(*) over (partition by {c}) end as {c}_freq"
                         for c in FREQUENCY_COLUMNS])}
from card left join cst using (cst_id)"""),
    "last_row": ([], """
select card_no, cast(is_out as bigint) as last_is_out, txn_amt as last_amt, acct_bal as last_bal2,
  hour as last_hour, cntrprt_prvt_ind as last_prvt from e where rn_end = 0"""),
    "last_k": ([], f"select card_no, {_last_k()} from e group by 1"),
    "last_day": ([], f"""
select card_no, count(*) as d0_n, sum(inflow_amt) as d0_in_sum, sum(outflow_amt) as d0_out_sum,
  {_uniques('cntrprt_card_no')} as d0_n_cntrprt, min(hour) as d0_hour_min, max(hour) as d0_hour_max
from e where days_before = 0 group by 1"""),
    "daily_peak": ([], f"""
select card_no, max(n) as daily_n_max, max(o) as daily_out_max, max(i) as daily_in_max,
  {_r('stddev_samp(n)', 'daily_n_std', 4)}
from (select card_no, stm_dt, count(*) as n, sum(outflow_amt) as o, sum(inflow_amt) as i from txn group by 1, 2)
group by 1"""),
    "entropy": ([], """
select h.card_no, h.hour_entropy, c.channel_entropy from (
  select card_no, round(sum(p * ln(1 / p)), 6) as hour_entropy from (
    select card_no, count(*) / sum(count(*)) over (partition by card_no) as p from e group by card_no, hour)
  group by 1) h
join (
  select card_no, round(sum(p * ln(1 / p)), 6) as channel_entropy from (
    select card_no, count(*) / sum(count(*)) over (partition by card_no) as p from e
    group by card_no, txn_channel_type) group by 1) c using (card_no)"""),
    "amount_repetition": ([], f"""
select card_no, max(n) as amt_top1_cnt, count(*) as n_unique_amt, {_r('max(n) / sum(n)', 'amt_top1_share')},
  {_r('count(*) / sum(n)', 'amt_unique_ratio')}
from (select card_no, txn_amt, count(*) as n from txn group by 1, 2) group by 1"""),
    "counterparty_degree": ([], f"""
select card_no, max(deg) as cpdeg_max, {_r('avg(deg)', 'cpdeg_mean')},
  {_r(_share('deg >= 5'), 'cpdeg_hub_share')}, {_r(_share('known'), 'cp_is_sample_share')}
from (select *, count(*) over (partition by cntrprt_card_no) as deg,
        cntrprt_card_no in (select card_no from txn) as known
      from (select distinct card_no, cntrprt_card_no from txn where cntrprt_card_no is not null)) group by 1"""),
    "sample_pair_share": ([], f"""
select count(*) as n_pairs, {_r(_share('cntrprt_card_no in (select card_no from txn)'), 'sample_pair_share')}
from (select distinct card_no, cntrprt_card_no from txn where cntrprt_card_no is not null)"""),
    "after_last_inflow": ([], f"""
select card_no, min(rn_end) filter (where is_in) as trailing_outs,
  arg_max_null(inflow_amt, place) filter (where is_in) as last_in_amt,
  min(days_before) filter (where is_in) as last_in_days_before,
  date_sub('second', max(tms) filter (where is_in), any_value(anchor_tms)) as sec_lastin_to_end,
  sum(outflow_amt) filter (where rn_end < last_in_rn) as afterin_out_sum,
  case when count(*) filter (where rn_end < last_in_rn) > 0
    then {_uniques('cntrprt_card_no', 'rn_end < last_in_rn')} end as afterin_n_cntrprt,
  date_sub('second', min(tms) filter (where rn_end < last_in_rn),
    max(tms) filter (where rn_end < last_in_rn)) as afterin_span_sec
from ordered group by 1"""),
    "io_flips": ([], "select card_no, count(*) filter (where io_flip) as n_io_flips from e group by 1"),
    "first_contact": ([], f"""
with f as (select card_no, cntrprt_card_no, max(days_before) as first_days from e
           where cntrprt_card_no is not null group by 1, 2),
l as (select e.*, f.first_days from e left join f
      on e.card_no = f.card_no and e.cntrprt_card_no = f.cntrprt_card_no)
select a.*, b.d0_newcp_share, b.d0_newcp_out_sum from (
  select card_no, cast(cntrprt_clear_type = 'interbank_txn' as bigint) as last_interbank,
    cast(first_days = 0 as bigint) as last_cp_is_new,
    {_lines([f"cast(txn_channel_type = '{c}' as bigint) as last_ch_{c}" for c in LAST_ROW_CHANNELS])}
  from l where rn_end = 0) a
left join (
  select card_no, {_r(_share('first_days = 0'), 'd0_newcp_share')},
    {_sum0('outflow_amt', 'first_days = 0')} as d0_newcp_out_sum
  from l where days_before = 0 and is_out and cntrprt_card_no is not null group by 1) b using (card_no)"""),
    "fan_out": ([], f"""
select a.card_no, a.hourly_out_max, b.fanout_day_max, b.fanout_day_mean from (
  select card_no, max(n) as hourly_out_max from (
    select card_no, stm_dt, hour, count(*) as n from e where is_out group by 1, 2, 3) group by 1) a
left join (
  select card_no, max(n) as fanout_day_max, {_r('avg(n)', 'fanout_day_mean')} from (
    select card_no, stm_dt, count(distinct cntrprt_card_no) as n from e
    where is_out and cntrprt_card_no is not null group by 1, 2) group by 1) b using (card_no)"""),
    "balance_path": ([], """
select card_no, arg_min_null(acct_bal, place) as bal_first, max(acct_bal) filter (where rn_end = 1) as bal_prev1,
  arg_max_null(acct_bal, place) - arg_min_null(acct_bal, place) as bal_delta from ordered group by 1"""),
    "second_lookbacks": ([], f"select card_no, {_lookback_seconds()} from e group by 1"),
    "inflow_concentration": ([], f"""
select card_no, count(*) as n_in_cp, {_r('max(x) / (sum(x) + 1)', 'in_cp_top1_share')}
from (select card_no, cntrprt_card_no, sum(inflow_amt) as x from e
      where is_in and cntrprt_card_no is not null group by 1, 2) group by 1"""),
    "calendar": ([], f"""
select card_no, {_r(_share('isodow(tms) >= 6'), 'weekend_share')}, isodow(max(tms)) as anchor_weekday,
  hour(max(tms)) as anchor_hour from e group by 1"""),
    "edge_account": ([], _edge("cntrprt_card_no")),
    "edge_name": ([], _edge("cntrprt_name")),
    "edge_variants": (["edge_account", "edge_name"], _VARIANT_ROWS),
    "semi_low_degree": (["edge_account"], f"""
select * from edge_account where key in (
  select key from edge_account group by key having count(distinct card_no) <= {ACCOUNT_LIMIT})"""),
    "stratified_folds": ([], """
select card_no, label, (row_number() over (partition by label order by
  (cast(card_no as bigint) * 2654435761 + 42 * 40503) % 4294967296, card_no) - 1) % 5 as fold from train"""),
    "exposure_ref": (["edge_account", "edge_name", "edge_variants"],
                     f"select * exclude (variant) from ({_EXPOSURE_WHOLE}) where variant = 'ao'"),
    "exposure_all": (["edge_account", "edge_name", "edge_variants"],
                     _exposure_wide("card_no", f"({_EXPOSURE_WHOLE})")),
    "exposure_long": (["edge_account", "edge_name", "edge_variants", "stratified_folds"], _EXPOSURE_LONG),
    "exposure_oof": (["edge_account", "edge_name", "edge_variants", "stratified_folds", "exposure_long"],
                     _exposure_wide("card_no, fold", "(select * from exposure_long where side = 'train')")),
    "exposure_target_foldmatched": (
        ["edge_account", "edge_name", "edge_variants", "stratified_folds", "exposure_long"],
        _exposure_wide("card_no, fold", "(select * from exposure_long where side = 'target')")),
    "sender_degree": ([], f"""
select * from ({_sender('cntrprt_card_no', 'fa')}) full join ({_sender('cntrprt_name', 'fn')}) using (card_no)"""),
    "inflow_detail": ([], f"""
select card_no, {_uniques('cntrprt_card_no', 'cntrprt_prvt_ind = 1')} as n_in_prvt_senders,
  {_uniques('cntrprt_card_no')} as n_in_senders, {_r(_share('hour < 6'), 'in_night_share')},
  max(inflow_amt) as in_max2, {_r(_share('inflow_amt % 1000 = 0'), 'in_round1k_share')},
  {_r(_share("cntrprt_clear_type = 'interbank_txn'"), 'in_interbank_share')},
  date_sub('second', arg_max(tms, {{a: inflow_amt, p: place}}), any_value(anchor_tms)) as sec_maxin_to_end
from ordered where is_in group by 1"""),
    "silence_anchor": ([], "select max(cast(tms as date)) as anchor_date from txn"),
    "silence_base": ([], f"""
select card_no, date_diff('day', last_dt, anchor) as sil_days,
  {_r("date_sub('second', last_tms, cast(anchor + 1 as timestamp)) / 3600.0", 'sil_hours')},
  cast(date_diff('day', last_dt, anchor) >= 32 as bigint) as sil_beyond_norm,
  date_diff('day', first_dt, anchor) as first_sil_days, hour(last_tms) as last_hour, isodow(last_tms) as last_wd,
  cast(hour(last_tms) between 9 and 16 as bigint) as last_is_bizhour,
  cast(hour(last_tms) <= 2 as bigint) as last_is_deepnight,
  n_txn, in_sum, out_sum, bal_last, date_diff('day', first_dt, last_dt) as span_days, n_t1, n_t3, n_t7,
  cast(end_in > 0 as bigint) as last_is_in
from (
  select card_no, count(*) as n_txn, max(tms) as last_tms, min(tms) as first_tms,
    cast(max(tms) as date) as last_dt, cast(min(tms) as date) as first_dt,
    sum(inflow_amt) as in_sum, sum(outflow_amt) as out_sum,
    {_lines([f"count(*) filter (where date_sub('second', tms, anchor_tms) / 86400.0 <= {d}) as n_t{d}" for d in (1, 3, 7)])},
    arg_max_null(acct_bal, place) as bal_last, arg_max_null(inflow_amt, place) as end_in
  from ordered group by 1), (select max(cast(tms as date)) as anchor from txn)"""),
    "silence_interactions": (["silence_base"], f"select card_no, {_INTERACTIONS} from silence_base"),
    "silence_percentiles": (["silence_base"], f"""
select card_no, {_pct('nb', 'sil_days', 'sil_pct_in_ntxn_bin')}, {_pct('sb', 'n_txn', 'ntxn_pct_in_sil_bin')},
  {_pct('sb', 'bal_last', 'bal_pct_in_sil_bin')}, {_pct('sb', 'in_sum', 'insum_pct_in_sil_bin')}
from (
  select b.*, least(sil_days, 32) as sb, greatest(len(list_filter(edges, lambda x: x < n_txn)), 1) as nb
  from silence_base b, (select quantile_cont(n_txn, [{", ".join(str(i / 20) for i in range(21))}]) as edges
                        from silence_base))"""),
    "account_concentration": ([], f"""
select card_no, {_r('sum(si * si)', 'AB_acc_in_hhi')},
  {_r('coalesce(sum(si) filter (where prim), 0)', 'AB_primary_in_share')}, {_r('sum(so * so)', 'AB_acc_out_hhi')},
  {_r('coalesce(sum(so) filter (where prim), 0)', 'AB_primary_out_share')}
from (
  select card_no, i / (sum(i) over (partition by card_no) + 1) as si,
    o / (sum(o) over (partition by card_no) + 1) as so, prim
  from (select card_no, cst_accno, sum(inflow_amt) as i, sum(outflow_amt) as o,
          bool_or(coalesce(cst_accno = prim_cst_accno, false)) as prim
        from txn left join card using (card_no) group by 1, 2)) group by 1"""),
    "balance_consistency": ([], f"""
with r as (
  select card_no, cst_accno, abs((acct_bal - lag(acct_bal) over w) - (inflow_amt - outflow_amt)) as ra,
    abs((lead(acct_bal) over w - acct_bal) - (inflow_amt - outflow_amt)) as rb,
    abs(inflow_amt - outflow_amt) as size
  from txn window w as (partition by card_no, cst_accno order by tms, accno_txn_sn)),
a as (select card_no, cst_accno, least({_nearest('ra')}, {_nearest('rb')}) as best from r group by 1, 2)
select c.*, b.AB_acc_resid_best_p90_mean from (
  select card_no, {_r('avg(ra / (size + 1))', 'AB_relresid_after_mean')}, {_nearest('ra')} as AB_resid_after_p90
  from r group by 1) c
left join (select card_no, {_r('avg(best)', 'AB_acc_resid_best_p90_mean')} from a group by 1) b using (card_no)"""),
}

# Blocks of the behaviour features, in matrix order.
_FEATURE_BLOCKS = [
    "flow_aggregates", "balance_aggregates", "mix_shares", "gap_stats", "fast_in_out", "amount_shape",
    "day_lookbacks", "channel_shares", "summary_shares", "top_counterparty", "static_profile",
    "frequency_encoding", "last_row", "last_k", "last_day", "daily_peak", "entropy", "amount_repetition",
    "counterparty_degree", "after_last_inflow", "io_flips", "first_contact", "fan_out", "balance_path",
    "second_lookbacks", "inflow_concentration", "calendar",
]
_RATIO_COLUMNS = _lines([
    _r("out_sum / (in_sum + out_sum + 1)", "out_ratio"),
    "in_sum - out_sum as net_flow",
    _r("n_txn / n_days", "txn_per_day"),
    _r("bal_last / nullif(bal_max + 1, 0)", "bal_drain"),
    _r("n_cntrprt / n_txn", "cntrprt_per_txn"),
    _r("n_txn_w7 / n_txn", "w7_txn_share"),
    _r("n_txn_w1 / n_txn", "w1_txn_share"),
    _r("out_sum / nullif(bal_max + 1, 0)", "turnover_rate"),
    _r("in_sum_w1 / (in_sum + 1)", "in_w1_concentration"),
    _r("d0_out_sum / (d0_in_sum + 1)", "d0_out_in_ratio"),
    _r("last5_out_sum / (in_sum + 1)", "last5_drain_ratio"),
    _r("last_in_amt / nullif(bal_max + 1, 0)", "lastin_vs_balmax"),
    _r("afterin_out_sum / (last_in_amt + 1)", "afterin_drain"),
    _r("trailing_outs / (n_txn + 1)", "trailing_out_ratio"),
    _r("h24_out_sum / (out_sum + 1)", "h24_out_concentration"),
    _r("h1_n / (n_txn + 1)", "h1_txn_share"),
])
_RATIO_BLOCKS = ["flow_aggregates", "balance_aggregates", "mix_shares", "day_lookbacks", "last_day", "last_k",
                 "after_last_inflow", "second_lookbacks"]
_WEALTH = _lines([
    _r("in_sum / (abs(mo_da_aum_val) + 100)", "in_vs_aum"),
    _r("bal_last / (abs(mo_da_aum_val) + 100)", "bal_vs_aum"),
    _r("in_max2 / (abs(aum_val) + 100)", "inmax_vs_aum"),
    _r("bal_last / (in_sum + 1)", "in_retention"),
    _r("n_in_senders / (n_in + 1)", "sender_per_in"),
])


def _chain(blocks: list[str]) -> str:
    return blocks[0] + "".join(f" left join {b} using (card_no)" for b in blocks[1:])


_EXPOSURE_NAMES = [f"{v}_{s}" for v in ACCOUNT_VARIANTS + NAME_VARIANTS for s in EXPOSURE_STATS]
_EXPOSURE_DEPS = ["edge_account", "edge_name", "edge_variants", "stratified_folds", "exposure_long",
                  "exposure_oof", "exposure_target_foldmatched"]
_SILENCE_DEPS = ["silence_base", "silence_interactions", "silence_percentiles"]

_BODIES |= {
    "card_ratios": (_RATIO_BLOCKS, f"select card_no, {_RATIO_COLUMNS} from {_chain(_RATIO_BLOCKS)}"),
    "wealth_ratios": (["flow_aggregates", "balance_aggregates", "static_profile", "inflow_detail"], f"""
select card_no, {_WEALTH}
from {_chain(["flow_aggregates", "balance_aggregates", "static_profile", "inflow_detail"])}"""),
    "features": (_FEATURE_BLOCKS, f"""
select *, {_RATIO_COLUMNS} from {_chain(_FEATURE_BLOCKS)}"""),
    "feature_matrix": (
        [*_FEATURE_BLOCKS, "features", *_EXPOSURE_DEPS, "sender_degree", "inflow_detail", *_SILENCE_DEPS,
         "account_concentration", "balance_consistency"],
        f"""
select k.side, k.card_no, k.fold, k.label, f.* exclude (card_no),
  {_lines([f"cast(coalesce(x.{c}, 0) as double) as {c}" for c in _EXPOSURE_NAMES])},
  sd.* exclude (card_no), i.* exclude (card_no), {_WEALTH},
  q.* exclude (card_no),
  ac.* exclude (card_no), bc.* exclude (card_no)
from (select 'train' as side, card_no, fold, label from stratified_folds
      union all select 'target', card_no, k, null from target, range(5) r(k)) k
left join features f on f.card_no = k.card_no
left join (select 'train' as side, * from exposure_oof
           union all by name select 'target' as side, * from exposure_target_foldmatched) x
  on x.side = k.side and x.card_no = k.card_no and x.fold = k.fold
left join sender_degree sd on sd.card_no = k.card_no
left join inflow_detail i on i.card_no = k.card_no
left join (select card_no, {_lines([f"{c} as S_{c}" for c in SILENCE_COLUMNS])}
           from silence_base left join silence_interactions using (card_no)
           left join silence_percentiles using (card_no)) q on q.card_no = k.card_no
left join account_concentration ac on ac.card_no = k.card_no
left join balance_consistency bc on bc.card_no = k.card_no"""),
    "coverage_report": ([], f"""
select count(*) as n_cards, min(last_dt) as first_last_dt, max(last_dt) as last_last_dt,
  (select count(*) from train where card_no not in (select card_no from txn)) as train_without_txn,
  (select count(*) from target where card_no not in (select card_no from txn)) as target_without_txn,
  {_r('(select avg(label) from train)', 'label_rate')}
from (select card_no, max(stm_dt) as last_dt from txn group by 1)"""),
    "class_means": (["flow_aggregates", "static_profile"], f"""
select label, {_r('avg(in_sum / (abs(mo_da_aum_val) + 100))', 'mean_in_vs_aum')}
from train left join flow_aggregates using (card_no) left join static_profile using (card_no) group by 1"""),
    "anti_uncovered": ([], """
select 'train' as side, card_no from train where card_no not in (select card_no from txn)
union all select 'target', card_no from target where card_no not in (select card_no from txn)"""),
    "scores": (["silence_base"], _SCORES),
    "fold_mean": (["silence_base", "scores"], """
select card_no, family, cast(seed as bigint) as seed, avg(score) as score from scores group by 1, 2, 3"""),
    "rank_normalise": (["silence_base", "scores", "fold_mean"], f"""
select card_no, score, round({_RANK.format(by='1', x='score')}, 6) as rank from fold_mean where family = 'boosted'"""),
    "family_means": (["silence_base", "scores", "fold_mean"], f"""
select card_no, family, avg(r) as score from (
  select *, {_RANK.format(by='family, seed', x='score')} as r from fold_mean) group by 1, 2"""),
    "family_scores": (["silence_base", "scores", "fold_mean", "family_means"], """
select card_no, family, round(score, 6) as score from family_means"""),
    "rank_blend": (["silence_base", "scores", "fold_mean", "family_means"], f"""
select card_no, round({_RANK.format(by='1', x='score')}, 6) as score from (
  select card_no, round(avg(r), 12) as score from (
    select *, {_RANK.format(by='family', x='score')} as r from family_means) group by 1)"""),
    "hard_rule": (["silence_base", "scores", "fold_mean", "family_means", "rank_blend"], """
select card_no, case when sil_days >= 32 then 1.0 else round(score, 6) end as score
from rank_blend left join silence_base using (card_no)"""),
    "top_fraction": (["silence_base", "scores", "fold_mean"], """
select card_no, score from (
  select *, row_number() over (order by score desc,
      (cast(card_no as bigint) * 2654435761 + 42 * 40503) % 4294967296, card_no) as pos, count(*) over () as n
  from fold_mean where family = 'boosted') where pos <= floor(n * 0.01e0)"""),
    "top_frac_f1": (["silence_base", "scores", "fold_mean"], """
with g as (select f.card_no, f.score, t.label, row_number() over (order by score desc,
      (cast(card_no as bigint) * 2654435761 + 42 * 40503) % 4294967296, card_no) as pos, count(*) over () as n
    from fold_mean f join train t using (card_no) where family = 'boosted'),
c as (select count(*) filter (where pos <= floor(n * 0.01e0)) as k,
        cast(sum(label) filter (where pos <= floor(n * 0.01e0)) as bigint) as tp,
        cast(sum(label) as bigint) as positives from g)
select k, tp, positives, round(tp / k, 6) as precision, round(tp / positives, 6) as recall,
  round(2 * (tp / k) * (tp / positives) / (tp / k + tp / positives + 1e-9), 6) as f1 from c"""),
    "auc": (["silence_base", "scores", "fold_mean"], f"""
with g as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r
           from fold_mean join train using (card_no) where family = 'boosted')
select {_r('''(sum(r) filter (where label = 1) - count(*) filter (where label = 1)
  * (count(*) filter (where label = 1) + 1) / 2.0)
  / (count(*) filter (where label = 1) * count(*) filter (where label = 0))''', 'auc')} from g"""),
    "ranked_output": (["silence_base", "scores", "fold_mean", "family_means", "rank_blend", "hard_rule"], """
select row_order, card_no, score from target left join hard_rule using (card_no) order by row_order"""),
    "output_check": (["silence_base", "scores", "fold_mean", "family_means", "rank_blend", "hard_rule", "ranked_output"], """
select count(*) filter (where o.card_no is null or o.score is null) as missing,
  (select count(*) from ranked_output where card_no not in (select card_no from target)) as extra,
  (select count(*) from (select card_no from ranked_output group by 1 having count(*) > 1)) as doubled
from target left join ranked_output o using (card_no)"""),
    "csv_transactions": ([], "select * from txn"),
    "duplicate_keys": ([], "select card_no, stm_dt, count(*) as n from txn group by 1, 2 having count(*) > 1"),
    "scores_csv_roundtrip": (
        ["silence_base", "scores", "fold_mean", "family_means", "rank_blend", "hard_rule", "ranked_output"],
        "select card_no, score from ranked_output"),
    "score_vectors_roundtrip": (["silence_base", "scores"], "select * from scores"),
    "dynamic_code_shares": ([], f"""
select card_no, field, code, round(round(n / total, 9), 6) as share from (
  select card_no, 'txn_channel_type' as field, txn_channel_type as code, count(*) as n,
    sum(count(*)) over (partition by card_no) as total from txn where txn_channel_type is not null group by 1, 3
  union all
  select card_no, 'smy_cd', smy_cd, count(*), sum(count(*)) over (partition by card_no)
  from txn where smy_cd is not null group by 1, 3)
where list_contains({[*CHANNEL_CODES, *MATRIX_MORE_CHANNELS]}, code) and field = 'txn_channel_type'
  or list_contains({[*MATRIX_TOP_SUMMARY, *MATRIX_MORE_SUMMARY]}, code) and field = 'smy_cd'"""),
    "csv_side_tables": ([], """
select 'card' as tbl, concat_ws('|', cast(aum_val as bigint), card_create_dt, card_no, crdisu_lvl1_insid, crdisu_lvl2_insid,
  cst_id, 7, cast(mo_da_aum_val as bigint), prim_cst_accno) as line from card
union all select 'cst', concat_ws('|', cst_id, 7, coalesce(gender, '~'), industry, marital_status, occupation) from cst
union all select 'accno', concat_ws('|', card_no, cst_accno, open_accno_dt) from accno
union all select 'train', concat_ws('|', card_no, label) from train
union all select 'target', card_no from target"""),
    "crossfit_coverage": (["stratified_folds"], """
with recipe as (select * from (values ('boosted', 42), ('narrow', 42), ('narrow', 2026), ('forest', 42)) r(family, seed)),
rows as (
  select 'train' as side, fold, count(*) as n from stratified_folds group by 2
  union all select 'target', k, (select count(*) from target) from range(5) r(k))
select side, family, seed, fold, n as n_rows, n as n_cards, 0 as outside, 0 as met from rows, recipe"""),
    "anchor_roundtrip": ([], f"select max(cast(tms as date)) as anchor_date, '{ANCHOR_NOTE}' as note from txn"),
    "manifest_roundtrip": (["top_codes"], """
select row_number() over (order by n_rows desc, code) - 1 as pos, code as name from top_codes"""),
    "reuse_roundtrip": (["card_anchor"], "select *, 1 as times_made from card_anchor"),
    "sketch_counts": ([], """
select 'card' as side, card_no as key, count(distinct coalesce(cntrprt_card_no, '~')) as n_exact, 1 as near from txn group by 2
union all
select 'counterparty', cntrprt_card_no, count(distinct card_no), 1 from txn where cntrprt_card_no is not null group by 2"""),
    "lenient_parse": ([], """
select l_orderkey, l_linenumber, try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') as tms,
  cast(try_strptime(dt_text, '%Y-%m-%d') as date) as stm_dt
from (select l_orderkey, l_linenumber,
  case when l_partkey % 11 = 0 then 'unknown' else strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') end as ts_text,
  case when l_partkey % 13 = 0 then '' else strftime(l_shipdate, '%Y-%m-%d') end as dt_text from lineitem)"""),
    "label_normalise": ([], f"""
select c_custkey, case when try_cast(txt as double) = 1 then 1 when try_cast(txt as double) = 0 then 0 end as label from (
  select c_custkey, case {' '.join(f"when c_custkey % 17 = {i} then '{t}'" for i, t in enumerate(ODD_LABELS))}
    when c_acctbal < 0 then '1.0' else '0.0' end as txt
  from customer)"""),
}

# Parts of other queries, not registered themselves.
_PARTS = {"exposure_long", "features", "scores", "family_means"}


def build(key: str) -> str:
    deps, body = _BODIES[key]
    ctes = [_PRELUDE.strip()] + [f"{d} as ({_BODIES[d][1].strip()})" for d in deps]
    return "with " + ",\n".join(ctes) + f"\nselect * from ({body.strip()})"


# Queries that take another path to the same rows.
_SAME = {f"{key}_split": key for key in ("enriched_txn", "balance_consistency", "feature_matrix")}


def all_oracles() -> dict[str, str]:
    own = {key: build(key) for key in _BODIES if key not in _PARTS}
    return own | {key: own[same] for key, same in _SAME.items()}
