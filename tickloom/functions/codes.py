"""Instrument codes: market, exchange, index names and broker code tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from tickloom.functions.scalar import any_of, col

# Market labels and the code prefixes that select them, first match wins.
SH_MAIN, SZ_MAIN, CHI_NEXT, STAR, BSE, CDR, NEEQ = "上证主板", "深证主板", "创业板", "科创板", "北交所", "CDR", "新三板"
MARKET_PREFIXES = [
    (STAR, ["688"]),
    (CDR, ["689"]),
    (SZ_MAIN, ["002"]),
    (CHI_NEXT, ["300", "301"]),
    (SH_MAIN, ["600", "601", "603", "605"]),
    (SZ_MAIN, ["000", "001", "003"]),
    (BSE, ["8"]),
    (NEEQ, ["43"]),
]
EXCHANGE_OF_MARKET = {STAR: "SH", SH_MAIN: "SH", CDR: "SH", CHI_NEXT: "SZ", SZ_MAIN: "SZ", BSE: "BJ"}
LEGACY_MARKETS = {"中小板": SZ_MAIN}
TRADABLE_MARKETS = [SH_MAIN, SZ_MAIN, CHI_NEXT]

# Broad index codes and names.
INDEX_NAMES = {
    "sh000001": "SSE",
    "sz399001": "SZSE",
    "sz399006": "ChiNext",
    "sh000688": "STAR",
    "sh000300": "CSI-300",
    "sh000905": "CSI-500",
    "sh000852": "CSI-1000",
    "sh000016": "SSE-50",
}

# Broker order states and sides.
ORDER_STATUS_OF = {
    "ORDER_UNKNOWN": "unknown",
    "ORDER_JUNK": "invalid",
    "ORDER_SUCCEEDED": "filled",
    "ORDER_PART_SUCC": "filled",
    "ORDER_PARTSUCC_CANCEL": "filled",
    "ORDER_CANCELED": "cancelled",
    "ORDER_PART_CANCEL": "cancelled",
    "ORDER_REPORTED_CANCEL": "pending",
    "ORDER_REPORTED": "pending",
    "ORDER_WAIT_REPORTING": "pending",
    "ORDER_UNREPORTED": "pending",
}
ORDER_SIDE_OF = {"STOCK_BUY": "buy", "STOCK_SELL": "sell"}

# Trade actions, their labels and their remark codes.
OPEN, CLOSE, STOP_LOSS, TAKE_PROFIT = "OPEN", "CLOSE", "STOP_LOSS", "TAKE_PROFIT"
ACTION_LABELS = {"开仓": OPEN, "平仓": CLOSE, "止损": STOP_LOSS, "止盈": TAKE_PROFIT}
ACTION_CODES = {CLOSE: "EX", TAKE_PROFIT: "TP", STOP_LOSS: "SL"}


def lookup(key: Column | str, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small constant table, ``default`` where the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def market_of(code: Column | str) -> Column:
    """Market label of a code, NULL when no prefix fits."""
    code = col(code)
    rule = F.lit(None).cast("string")
    for market, prefixes in reversed(MARKET_PREFIXES):
        rule = F.when(any_of(code.startswith(p) for p in prefixes), F.lit(market)).otherwise(rule)
    return rule


def exchange_of(code: Column | str) -> Column:
    return lookup(market_of(code), EXCHANGE_OF_MARKET)


def with_exchange(code: Column | str) -> Column:
    """``000333`` → ``000333.SZ``; codes that carry a suffix already are kept."""
    code = col(code)
    return F.when(code.contains("."), code).otherwise(F.concat(code, F.lit("."), exchange_of(code)))


def without_exchange(code: Column | str) -> Column:
    return F.substring_index(col(code), ".", 1)


def index_name(code: Column | str) -> Column:
    return lookup(code, INDEX_NAMES)


def index_code(name: Column | str) -> Column:
    return lookup(name, {name: code for code, name in INDEX_NAMES.items()})


def order_status(code: Column | str) -> Column:
    return lookup(code, ORDER_STATUS_OF, default="unknown")


def order_side(code: Column | str) -> Column:
    return lookup(code, ORDER_SIDE_OF)


def action_of(label: Column | str) -> Column:
    return lookup(label, ACTION_LABELS)
