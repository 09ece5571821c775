"""Row and code filters, buy and close signals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes
from tickloom.operators.series import CODE, DT


def universe(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def drop_incomplete(df: DataFrame, required: Iterable[str]) -> DataFrame:
    required = list(required)
    return df.dropna(subset=required) if required else df


def drop_suspect_codes(df: DataFrame, max_abs_pct: float = 21.0, pct: str = "pct_chg", key: str = CODE) -> DataFrame:
    """Drop every row of a code that ever moved more than the bound. The moves are reduced per code before the
    shuffle; only codes that break the bound reach the anti join."""
    bad = df.groupBy(key).agg(F.max(F.abs(pct)).alias("_m")).where(F.col("_m") > F.lit(float(max_abs_pct))).select(key)
    return df.join(bad, key, "left_anti")


def drop_codes_without_factors(df: DataFrame, factors: DataFrame, key: str = CODE) -> DataFrame:
    return df.join(factors.select(key).distinct(), key, "left_semi")


def min_history(df: DataFrame, n: int, key: str = CODE) -> DataFrame:
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(enough, key, "left_semi")


def since(df: DataFrame, start, dt: str = DT) -> DataFrame:
    return df.where(F.col(dt) >= F.lit(start).cast("date"))


def until(df: DataFrame, end, dt: str = DT) -> DataFrame:
    return df.where(F.col(dt) <= F.lit(end).cast("date"))


def latest_slice(df: DataFrame, day, dt: str = DT) -> DataFrame:
    """Keep one day. Applied to factor output: Catalyst does not push a date below a window over dates."""
    return df.where(F.col(dt) == F.lit(day).cast("date"))


def relabel(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.replace(mapping, subset=[column])


def tradable_markets(df: DataFrame, markets: Iterable[str] = tuple(codes.TRADABLE_MARKETS), key: str = CODE) -> DataFrame:
    return df.withColumn("market", codes.market_of(key)).where(F.col("market").isin(list(markets)))


def min_mkt_cap(jobs: DataFrame, listing: DataFrame, x: float, key: str = CODE) -> DataFrame:
    """Keep the jobs of instruments worth at least ``x``; a bound of 0 or less keeps all."""
    if x <= 0:
        return jobs
    big = listing.where(F.col("mkt_cap") >= F.lit(float(x))).select(key).distinct()
    return jobs.join(big, key, "left_semi")


def retain_trade_days(df: DataFrame, calendar: DataFrame, days: int, dt: str = DT) -> DataFrame:
    """Keep the last ``days`` days of the calendar. The kept days are a list of known length, hence the hint."""
    kept = calendar.orderBy(F.desc("dt")).limit(days).select(F.col("dt").alias("_day"))
    return df.join(F.broadcast(kept), F.col(dt) == F.col("_day"), "left_semi")


def volatility_filter(df: DataFrame, minimum: Column | float, atr: str = "atr", typical: str = "typical_price") -> DataFrame:
    bound = minimum if isinstance(minimum, Column) else F.lit(float(minimum))
    return df.where(F.try_divide(F.lit(100.0) * F.col(atr), F.col(typical)) >= bound)


def min_price_filter(df: DataFrame, minimum: Column | float, price: str = "orig_open") -> DataFrame:
    bound = minimum if isinstance(minimum, Column) else F.lit(float(minimum))
    return df.where(F.col(price) >= bound)


def not_in(df: DataFrame, other: DataFrame, keys: str | list[str] = CODE) -> DataFrame:
    """Rows whose keys are absent from ``other`` (held or already traded codes)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def not_blacklisted(df: DataFrame, blacklist: DataFrame, date_col: str = DT, key: str = CODE) -> DataFrame:
    """Drop codes listed without an end, or up to and including their end date. Several entries of one code
    count as the widest of them, so the join meets at most one row per code."""
    entry = blacklist.groupBy(F.col(key).alias("_bl_code")).agg(
        F.max("until").alias("_until"), F.max(F.col("until").isNull()).alias("_forever")
    )
    blocked = F.col("_forever") | (F.col(date_col) <= F.col("_until"))
    return df.join(entry, (F.col(key) == F.col("_bl_code")) & blocked, "left_anti")


def buy_signals(
    df: DataFrame,
    predicate: Column,
    price: Column | str = "close",
    weight: Column | float = 1.0,
    held: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    *,
    key: str = CODE,
    dt: str = DT,
    keep: Iterable[str] = (),
) -> DataFrame:
    """(code, dt, order_price, weight) where the rule triggers, without held and blacklisted codes."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    price = price if isinstance(price, Column) else F.col(price)
    hits = df.where(predicate).select(key, dt, price.alias("order_price"), weight.alias("weight"), *keep)
    if held is not None:
        hits = not_in(hits, held, key)
    if blacklist is not None:
        hits = not_blacklisted(hits, blacklist, dt, key)
    return hits


def close_signals(df: DataFrame, predicate: Column, held: DataFrame | None = None, *, key: str = CODE, dt: str = DT) -> DataFrame:
    """(code, dt) where the closing rule triggers, for held codes only when ``held`` is given."""
    hits = df.where(predicate).select(key, dt)
    return hits if held is None else hits.join(held.select(key).distinct(), key, "left_semi")
