"""Order columns, remarks and trade-log rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions import codes, scalar as S


def is_buy(direction="direction") -> Column:
    return S.col(direction) == "buy"


def is_sell(direction="direction") -> Column:
    return S.col(direction) == "sell"


def is_filled(status="status") -> Column:
    return S.col(status) == "filled"


def placed_value(price="price", vol="vol") -> Column:
    return S.col(price) * S.col(vol)


def filled_value(price="filled_price", vol="filled_vol") -> Column:
    return S.col(price) * S.col(vol)


def pending_vol(vol="vol", filled="filled_vol") -> Column:
    return S.col(vol) - S.col(filled)


def is_open(status="status") -> Column:
    """Not cancelled and not wholly filled; batch and stream expiry share this."""
    return (S.col(status) != "cancelled") & (pending_vol() > 0)


def cancelled_vol(status="status") -> Column:
    return F.when(S.col(status) == "cancelled", pending_vol()).otherwise(F.lit(0))


def cancelled_value(status="status") -> Column:
    return F.when(S.col(status) == "cancelled", placed_value() - filled_value()).otherwise(F.lit(0.0))


def slip_points() -> Column:
    return F.col("price") - F.col("filled_price")


def age_seconds(now, ts="timestamp") -> Column:
    return F.unix_timestamp(S.lit(now).cast("timestamp")) - F.unix_timestamp(S.col(ts))


def with_order_columns(orders, now=None):
    """Add every derived order column."""
    added = {
        "cancelled_vol": cancelled_vol(),
        "pending_vol": pending_vol(),
        "filled_value": filled_value(),
        "cancelled_value": cancelled_value(),
        "placed_value": placed_value(),
        "slip_points": slip_points(),
        "is_filled": is_filled(),
    }
    if now is not None:
        added["age_seconds"] = age_seconds(now)
    return orders.withColumns(added)


def _two_digits(x) -> Column:
    """Decimal text with two digits and no thousands separators."""
    return S.rounded(x).cast("decimal(20,2)").cast("string")


def format_sell_remark(action, price, vol, pct) -> Column:
    """``SL:10.50,100,-3.00``"""
    code = codes.lookup(S.lit(action), codes.ACTION_CODES)
    return F.concat(code, F.lit(":"), _two_digits(price), F.lit(","), S.lit(vol).cast("string"), F.lit(","), _two_digits(pct))


REMARK_PATTERN = r"^(EX|TP|SL):([^,]+),([^,]+),([^,]+)$"


def parse_sell_remark(remark) -> Column:
    """Struct (action, price, vol, pct_chg); NULL when the text is not a remark."""
    remark = S.col(remark)
    part = lambda i: F.regexp_extract(remark, REMARK_PATTERN, i)
    action = codes.lookup(part(1), {code: action for action, code in codes.ACTION_CODES.items()})
    parsed = F.struct(
        action.alias("action"),
        part(2).try_cast("double").alias("price"),
        part(3).try_cast("int").alias("vol"),
        part(4).try_cast("double").alias("pct_chg"),
    )
    whole = parsed["price"].isNotNull() & parsed["vol"].isNotNull() & parsed["pct_chg"].isNotNull()
    return F.when(remark.rlike(REMARK_PATTERN) & whole, parsed)


def serialize_tags(tags="tags") -> Column:
    """``k=v;k=v`` in map order, empty text for no tags."""
    entries = F.transform(F.map_entries(S.col(tags)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(F.array_join(entries, ";"), F.lit(""))


def trade_log_row(timestamp, action, vol=None) -> list[Column]:
    """Trade-log columns of positions (id, code, price, vol, yesterday_vol, latest_price).

    Openings are logged at the entry price and full volume, exits at the latest price and overnight volume.
    """
    action = S.lit(action) if isinstance(action, Column) else F.lit(action)
    opening = action == codes.OPEN
    vol = S.lit(vol) if vol is not None else F.when(opening, F.col("vol")).otherwise(F.col("yesterday_vol"))
    logged = F.when(opening, F.col("price")).otherwise(F.col("latest_price"))
    pct = S.pct_chg_at("latest_price", "price")
    return [
        S.lit(timestamp).alias("timestamp"),
        action.alias("action"),
        F.col("id"),
        F.col("code"),
        vol.alias("vol"),
        logged.alias("price"),
        (logged * vol).alias("total_value"),
        S.chg_at("latest_price", "price").alias("chg"),
        pct.alias("pct_chg"),
        ((F.col("price") * pct * F.lit(1e-2)) * vol).alias("total_return"),
    ]


def capital_log_row(timestamp) -> list[Column]:
    return [
        S.lit(timestamp).alias("timestamp"),
        F.col("market_value"),
        F.col("free_cash_amount"),
        F.col("frozen_cash_amount"),
    ]
