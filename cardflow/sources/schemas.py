"""One explicit schema per input table; nothing is inferred, so codes keep their leading zeros."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_text, _long, _real = T.StringType(), T.LongType(), T.DoubleType()

# Times arrive as text and are parsed leniently after the scan.
TXN = _struct(
    card_no=_text, cst_accno=_text, accno_txn_sn=_long, tms=_text, stm_dt=_text,
    acct_bal=_real, txn_amt=_real, inflow_amt=_real, outflow_amt=_real,
    cntrprt_card_no=_text, cntrprt_name=_text, cntrprt_prvt_ind=_real,
    cntrprt_clear_type=_text, txn_channel_type=_text, txn_cgycd=_text, smy_cd=_text,
    rmrk_recharge_withdrawal_ind=_real, rmrk_short_ind=_real, rmrk_e_credit_ind=_real,
)
CARD = _struct(
    card_no=_text, prim_cst_accno=_text, cst_id=_text, crdisu_lvl1_insid=_text,
    crdisu_lvl2_insid=_text, card_create_dt=_text, aum_val=_real, mo_da_aum_val=_real,
)
CST = _struct(
    cst_id=_text, gender=_text, marital_status=_text, occupation=_text, industry=_text,
)
ACCNO = _struct(card_no=_text, cst_accno=_text, open_accno_dt=_text)
TRAIN = _struct(card_no=_text, label=_text)
TARGET = _struct(card_no=_text)
