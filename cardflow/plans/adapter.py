"""Views in the shape of the card data, derived by Spark from the given order tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TMS = """timestampadd(SECOND, cast(
    datediff(l_shipdate, date'1995-01-01') * 1080
    + (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 613) % 1080
    - 86400 * (case when o_custkey % 50 = 0 then 35 else o_custkey % 12 end) as int),
    timestamp_ntz'2025-12-01 00:00:00')"""

_TXN = """
cast(o_custkey as string) as card_no
concat(cast(o_custkey as string), '-', substr(o_orderpriority, 1, 1)) as cst_accno
((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as accno_txn_sn
tms
cast(tms as date) as stm_dt
cast(floor(l_extendedprice) - floor(l_quantity) as double) as acct_bal
cast(floor(l_extendedprice / 50) * 50 as double) as txn_amt
cast(case when l_returnflag = 'R' then floor(l_extendedprice / 50) * 50 else 0 end as double) as inflow_amt
cast(case when l_returnflag = 'R' then 0 else floor(l_extendedprice / 50) * 50 end as double) as outflow_amt
case when l_linenumber = 7 then null else cast(l_partkey as string) end as cntrprt_card_no
case when l_linenumber = 6 then null else concat('S', cast(l_suppkey as string)) end as cntrprt_name
cast(l_suppkey % 2 as double) as cntrprt_prvt_ind
case when l_linestatus = 'O' then 'interbank_txn' else 'on_us_bank_txn' end as cntrprt_clear_type
lpad(cast(l_linenumber as string), 4, '0') as txn_channel_type
case when l_partkey % 10 = 0 then '01' else '02' end as txn_cgycd
case when l_partkey % 41 = 40 then null else lpad(cast(l_partkey % 41 as string), 4, '0') end as smy_cd
cast(l_partkey % 3 = 0 as int) * 1e0 as rmrk_recharge_withdrawal_ind
cast(l_partkey % 5 = 0 as int) * 1e0 as rmrk_short_ind
cast(l_partkey % 7 = 0 as int) * 1e0 as rmrk_e_credit_ind
""".strip().splitlines()

_CARD = """
cast(c_custkey as string) as card_no
concat(cast(c_custkey as string), '-1') as prim_cst_accno
concat('U', cast(c_custkey - c_custkey % 2 as string)) as cst_id
cast(c_nationkey % 5 as string) as crdisu_lvl1_insid
cast(c_nationkey as string) as crdisu_lvl2_insid
date_add(date'2020-01-01', cast(c_custkey % 1500 as int)) as card_create_dt
floor(c_acctbal) * 1e0 as aum_val
floor(c_acctbal / 2) * 1e0 as mo_da_aum_val
""".strip().splitlines()

# Cards that never transact: one per supplier.
_QUIET_KEY = "1000000000 + s_suppkey"
_QUIET_CARD = f"""
cast({_QUIET_KEY} as string) as card_no
concat(cast({_QUIET_KEY} as string), '-1') as prim_cst_accno
concat('U', cast(s_suppkey as string)) as cst_id
cast(s_nationkey % 5 as string) as crdisu_lvl1_insid
cast(s_nationkey as string) as crdisu_lvl2_insid
date_add(date'2020-01-01', cast(s_suppkey % 1500 as int)) as card_create_dt
floor(s_acctbal) * 1e0 as aum_val
floor(s_acctbal / 2) * 1e0 as mo_da_aum_val
""".strip().splitlines()

_CST = """
concat('U', cast(c_custkey as string)) as cst_id
case when c_custkey % 7 = 0 then null else cast(c_custkey % 3 as string) end as gender
cast(c_custkey % 4 as string) as marital_status
c_mktsegment as occupation
cast(c_nationkey % 6 as string) as industry
""".strip().splitlines()

_ACCNO = """
cast(o_custkey as string) as card_no
concat(cast(o_custkey as string), '-', substr(o_orderpriority, 1, 1)) as cst_accno
date_add(date'2021-01-01', cast(o_custkey % 700 + cast(substr(o_orderpriority, 1, 1) as int) * 30 as int)) as open_accno_dt
""".strip().splitlines()


@dataclass(frozen=True)
class CardData:
    """The input tables of the engine."""

    txn: DataFrame
    card: DataFrame
    cst: DataFrame
    accno: DataFrame
    train: DataFrame
    target: DataFrame


# The given tables that `card_data` reads.
SOURCES = ("lineitem", "orders", "customer", "supplier")


def card_data(spark: SparkSession, sf_dir: str) -> CardData:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lineitem, orders, customer, supplier = map(table, SOURCES)
    sold = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # One card in five is to be predicted, the others are labelled.
    listed = customer.selectExpr("c_custkey as id", "c_acctbal as held").unionByName(
        supplier.selectExpr(f"{_QUIET_KEY} as id", "s_acctbal as held"))
    train = listed.filter("id % 5 <> 0").selectExpr(
        "cast(id as string) as card_no", "cast(case when held < 0 then 1 else 0 end as byte) as label")
    target = listed.filter("id % 5 = 0").selectExpr("cast(id as string) as card_no", "id as row_order")
    return CardData(
        txn=sold.withColumn("tms", F.expr(_TMS)).selectExpr(*_TXN),
        card=customer.selectExpr(*_CARD).unionByName(supplier.selectExpr(*_QUIET_CARD)),
        cst=customer.selectExpr(*_CST),
        accno=orders.selectExpr(*_ACCNO).distinct(),
        train=train,
        target=target,
    )
