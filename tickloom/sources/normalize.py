"""Vendor tables → the library's columns: rename, project, convert dates, scale units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import scalar as S
from tickloom.functions.dates import from_compact
from tickloom.operators.series import CODE, DT, with_positions

HUNDRED_MILLION = 1e-8

# Vendor column → library column, per kind of table.
KINDS: dict[str, dict[str, str]] = {
    "daily_hist": {
        "日期": "dt", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low",
        "成交量": "vol", "涨跌幅": "pct_chg", "涨跌额": "chg", "换手率": "turnover",
    },
    "sector_listing": {
        "板块名称": "name", "板块代码": "code", "最新价": "close", "涨跌额": "chg",
        "涨跌幅": "pct_chg", "总市值": "mkcap", "换手率": "turnover",
    },
    "sector_bars": {
        "日期": "dt", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low",
        "涨跌幅": "pct_chg", "涨跌额": "chg", "成交量": "vol", "换手率": "turnover",
    },
    "sector_quote": {
        "最新": "close", "最高": "high", "最低": "low", "开盘": "open", "成交量": "vol",
        "换手率": "turnover", "涨跌额": "chg", "涨跌幅": "pct_chg", "代码": "code",
    },
    "index_ticks": {"date": "dt", "volume": "vol"},
    "minute_bars": {"时间": "ts", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "vol"},
    "current_quote": {
        "代码": "code", "名称": "company", "涨跌幅": "pct_chg", "涨跌额": "chg", "成交量": "vol",
        "最新价": "close", "最高": "high", "最低": "low", "今开": "open", "换手率": "turnover",
    },
    "index_quote": {
        "最新价": "close", "最高": "high", "最低": "low", "今开": "open", "成交量": "vol",
        "代码": "code", "名称": "name", "涨跌额": "chg", "涨跌幅": "pct_chg",
    },
    "etf_quote": {
        "代码": "code", "名称": "name", "最新价": "close", "涨跌幅": "pct_chg", "涨跌额": "chg",
        "成交量": "vol", "最高价": "high", "最低价": "low", "开盘价": "open", "换手率": "turnover", "总市值": "mkt_cap",
    },
    "etf_bars": {
        "日期": "dt", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "vol", "换手率": "turnover",
    },
    "futures_bars": {
        "日期": "dt", "开盘价": "open", "收盘价": "close", "最高价": "high", "最低价": "low",
        "成交量": "vol", "持仓量": "open_interest",
    },
    "name_changes": {"变更日期": "dt", "变更后简称": "company", "证券代码": "code"},
}

# Items of the stock profile → column, with the ones counted in hundred millions.
PROFILE_ITEMS = {
    "总市值": "mkcap", "行业": "sector", "上市时间": "listdate", "股票代码": "code",
    "股票简称": "company", "总股本": "total_share", "流通股": "float_share",
}
PROFILE_SCALED = ["mkcap", "total_share", "float_share"]

# Vendor columns of share releases.
RELEASE_COLUMNS = {
    "股票代码": "code", "股票简称": "company", "解禁时间": "dt", "限售股类型": "category", "解禁数量": "num_shares",
    "实际解禁数量": "num_shares_released", "实际解禁市值": "mkcap_released", "占解禁前流通市值比例": "pct_shares",
}

#: Kinds that keep columns the mapping does not name.
_OPEN_KINDS = {"index_ticks"}


def normalize(df: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename and project a vendor table. ``keep`` names columns to carry along (the code of a history)."""
    mapping = KINDS[kind]
    renamed = df.withColumnsRenamed(mapping)
    columns = renamed.columns if kind in _OPEN_KINDS else [*mapping.values(), *keep]
    out = renamed.select(*columns)
    if DT in out.columns:
        out = out.withColumn(DT, F.to_date(DT))
    if kind == "etf_quote":
        out = out.withColumn("mkt_cap", S.rounded(F.col("mkt_cap") * F.lit(HUNDRED_MILLION), 3))
    return out


def kv_to_row(
    df: DataFrame,
    mapping: dict[str, str] = PROFILE_ITEMS,
    key: str = "item",
    value: str = "value",
    by: str = "src",
    scaled: list[str] | None = None,
) -> DataFrame:
    """Long item/value rows → one record per ``by``. Values are text; scaled ones become DOUBLE in hundred millions.

    The pivot has a fixed list of items, so it is one partial aggregation without a scan for distinct items. Of several
    values of one item the smallest text is taken.
    """
    scaled = PROFILE_SCALED if scaled is None else scaled
    pivoted = df.groupBy(by).pivot(key, list(mapping)).agg(F.min(value))
    out = pivoted.withColumnsRenamed(mapping)
    return out.withColumns({c: F.col(c).try_cast("double") * F.lit(HUNDRED_MILLION) for c in scaled if c in out.columns})


LADDER_ITEM = r"^(buy|sell)_([1-5])(_vol)?$"
LADDER_SIDES = ["buy", "sell", "buy_vol", "sell_vol"]


def ask_bid_ladder(df: DataFrame, item: str = "item", value: str = "value", by: str = CODE) -> DataFrame:
    """Item/value rows (``buy_1``, ``sell_3_vol``) → four arrays of five levels, best first.

    Unreadable values are NULL; volumes are scaled by 0.01, two digits. A level without a row is NULL.
    """
    text = F.col(value).cast("string")
    side = F.concat(F.regexp_extract(item, LADDER_ITEM, 1), F.regexp_extract(item, LADDER_ITEM, 3)).alias("_side")
    level = F.regexp_extract(item, LADDER_ITEM, 2).try_cast("int").alias("_level")
    rows = df.where(F.col(item).rlike(LADDER_ITEM)).select(by, side, level, text.alias("_text"))
    price = F.col("_text").try_cast("double")
    vol = S.rounded(price.try_cast("bigint") * F.lit(1e-2))
    rows = rows.withColumn("_value", F.when(F.col("_side").endswith("_vol"), vol).otherwise(price))

    def level_of(name: str, i: int) -> Column:
        return F.max(F.when((F.col("_side") == name) & (F.col("_level") == i), F.col("_value")))

    return rows.groupBy(by).agg(*[F.array(*[level_of(s, i) for i in range(1, 6)]).alias(s) for s in LADDER_SIDES])


def normalize_releases(df: DataFrame) -> DataFrame:
    """Vendor release records → percentages, running number per code, three digits."""
    out = df.withColumnsRenamed(RELEASE_COLUMNS).select(*RELEASE_COLUMNS.values())
    out = out.withColumn(DT, F.to_date(DT)).withColumn("pct_shares", F.col("pct_shares") * F.lit(100.0))
    numbered = with_positions(out, order=[DT, "category", "num_shares"], name="index")
    doubles = [c for c, t in numbered.dtypes if t == "double"]
    return numbered.withColumns({c: S.rounded(c, 3) for c in doubles})


def normalize_name_history(df: DataFrame) -> DataFrame:
    """(code, name, start_date ``yyyymmdd``) → one row per code and date, ISO dates; codes that only ever had one
    name are reduced to one row, their latest."""
    renamed = df.select(CODE, F.col("name").alias("company"), from_compact("start_date").alias(DT))
    daily = renamed.groupBy(CODE, DT).agg(F.min("company").alias("company"))
    names = daily.select(CODE, "company").distinct().groupBy(CODE).agg(F.count(F.lit(1)).alias("_n"))
    joined = daily.join(names, CODE)
    changed = joined.where(F.col("_n") > 1).drop("_n")
    steady = joined.where(F.col("_n") == 1).groupBy(CODE).agg(F.max(DT).alias(DT), F.max("company").alias("company"))
    return changed.select(CODE, DT, "company").unionByName(steady)
