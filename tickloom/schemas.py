"""Explicit schemas. Nothing in the library infers a type from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _D, _F, _I, _L, _B = StringType(), DoubleType(), FloatType(), IntegerType(), LongType(), BooleanType()
_DATE, _TS = DateType(), TimestampType()


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


DAILY_BAR = _struct(
    code=_S, dt=_DATE, open=_D, high=_D, low=_D, close=_D, vol=_D, chg=_D, pct_chg=_D, turnover=_D,
    company=_S, market=_S, mkt_cap=_D, mkt_cap_rank=_D,
)
INDEX_BAR = _struct(code=_S, name=_S, dt=_DATE, open=_D, high=_D, low=_D, close=_D, vol=_D, chg=_D, pct_chg=_D, turnover=_D)
FUTURES_BAR = _struct(code=_S, dt=_DATE, open=_D, high=_D, low=_D, close=_D, vol=_D, open_interest=_D)
MINUTE_BAR = _struct(code=_S, dt=_DATE, time=_S, open=_F, high=_F, low=_F, close=_F, vol=_F, month=_S)
ADJUST_FACTOR = _struct(code=_S, valid_from=_DATE, factor=_D)
RELEASE = _struct(
    code=_S, company=_S, dt=_DATE, category=_S, num_shares=_D, num_shares_released=_D, mkcap_released=_D,
    pct_shares=_D, index=_L,
)
NAME_CHANGE = _struct(code=_S, dt=_DATE, company=_S)
LISTING = _struct(code=_S, name=_S, sector=_S, listdate=_S, total_share=_D, float_share=_D)
QUOTE = _struct(
    code=_S, company=_S, ts=_TS, open=_D, high=_D, low=_D, close=_D, vol=_D, pct_chg=_D, chg=_D, turnover=_D
)
ASK_BID = _struct(code=_S, buy=ArrayType(_D), sell=ArrayType(_D), buy_vol=ArrayType(_D), sell_vol=ArrayType(_D))
ORDER = _struct(
    id=_S, timestamp=_TS, code=_S, price=_D, vol=_L, filled_price=_D, filled_vol=_L, status=_S, direction=_S,
    tags=MapType(_S, _S),
)
POSITION = _struct(id=_S, timestamp=_DATE, code=_S, price=_D, vol=_L, latest_price=_D, avail_vol=_L, yesterday_vol=_L)
ACCOUNT = _struct(free_cash_amount=_D, frozen_cash_amount=_D, market_value=_D)
TRADE_LOG = _struct(
    timestamp=_DATE, action=_S, id=_S, code=_S, vol=_L, price=_D, total_value=_D, chg=_D, pct_chg=_D, total_return=_D
)
CAPITAL_LOG = _struct(timestamp=_DATE, market_value=_D, free_cash_amount=_D, frozen_cash_amount=_D)
RUN = _struct(
    id=_S, batch_id=_S, repetition=_I, dataset_path=_S, params=MapType(_S, _D), metrics=MapType(_S, _D)
)
CALENDAR = _struct(dt=_DATE, idx=_L)
BLACKLIST = _struct(code=_S, until=_DATE)
