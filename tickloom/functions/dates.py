"""Dates, trade calendar and the phases of a trading day.

A calendar is a DataFrame ``(dt DATE, idx BIGINT)`` that the caller supplies, one row per trade day.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.scalar import col, lit

CLOSED, LUNCH, PRE_OPEN = "closed", "lunchbreak", "pre-open"
CALL_1, CALL_2 = "pre-open-call-phase-1", "pre-open-call-phase-2"
CONTINUOUS, PRE_CLOSE, CLOSE_CALL = "continuous-trading", "continuous-trading-pre-close", "pre-close-bidding"
TRADABLE_PHASES = [CALL_2, CONTINUOUS, PRE_CLOSE]


def to_compact(d: Column | str) -> Column:
    """DATE → ``yyyymmdd``."""
    return F.date_format(col(d), "yyyyMMdd")


def from_compact(text: Column | str) -> Column:
    """``yyyymmdd`` or ISO text → DATE, NULL when it is neither."""
    digits = F.regexp_replace(col(text), "-", "")
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def to_iso(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def days_between(d1, d2) -> Column:
    return F.datediff(lit(d1), lit(d2))


def make_calendar(days: DataFrame, dt: str = "dt") -> DataFrame:
    """Number distinct trade days. A calendar has one row per day (about 250 a year), so one window is enough."""
    days = days.select(F.col(dt).cast("date").alias("dt")).where(F.col("dt").isNotNull()).distinct()
    return days.select("dt", F.row_number().over(Window.orderBy("dt")).cast("bigint").alias("idx"))


def latest_trade_date(calendar: DataFrame, today: _dt.date | str) -> DataFrame:
    """One row: the greatest trade day not after ``today``."""
    return calendar.where(F.col("dt") <= F.lit(today).cast("date")).agg(F.max("dt").alias("dt"))


def nearby_trade_date(df: DataFrame, calendar: DataFrame, dt: str = "dt", out: str = "trade_date") -> DataFrame:
    """Add the greatest trade day ``<= dt``, NULL before the first one.

    Each calendar row covers the half-open span up to the next one; spans are unrolled to days so that the
    join stays an equi-join on the date.
    """
    follow = F.lead("dt").over(Window.orderBy("dt"))
    last = df.agg(F.max(dt).alias("_last"))
    spans = calendar.select(F.col("dt").alias(out), follow.alias("_next")).join(F.broadcast(last))
    until = F.coalesce(F.date_sub("_next", 1), F.greatest(F.col("_last"), F.col(out)))
    days = spans.select(out, F.explode(F.sequence(F.col(out), until)).alias("_day"))
    return df.join(days, F.col(dt) == F.col("_day"), "left").drop("_day")


def is_trade_day(df: DataFrame, calendar: DataFrame, dt: str = "dt", out: str = "is_trade_day") -> DataFrame:
    flags = calendar.select(F.col("dt").alias("_cal_dt"), F.lit(True).alias("_open")).distinct()
    joined = df.join(flags, F.col(dt).cast("date") == F.col("_cal_dt"), "left")
    return joined.withColumn(out, F.coalesce("_open", F.lit(False))).drop("_cal_dt", "_open")


def seconds_of_day(ts: Column | str) -> Column:
    ts = col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _at(hour: int, minute: int, second: int = 0) -> int:
    return hour * 3600 + minute * 60 + second


#: Fixed values: (from, until, phase) in seconds of the day; the rest of a trade day is closed.
PHASES = [
    (_at(9, 0), _at(9, 15), PRE_OPEN),
    (_at(9, 15), _at(9, 25, 30), CALL_1),
    (_at(9, 25, 30), _at(9, 30), CALL_2),
    (_at(9, 30), _at(11, 30), CONTINUOUS),
    (_at(11, 30), _at(13, 0), LUNCH),
    (_at(13, 0), _at(14, 54), CONTINUOUS),
    (_at(14, 54), _at(14, 57), PRE_CLOSE),
    (_at(14, 57), _at(15, 0), CLOSE_CALL),
]


def phase_of_time(ts: Column | str) -> Column:
    """Phase by time of day alone."""
    second = seconds_of_day(ts)
    rule = F.lit(CLOSED)
    for since, until, name in reversed(PHASES):
        rule = F.when((second >= since) & (second < until), F.lit(name)).otherwise(rule)
    return rule


def market_phase(df: DataFrame, calendar: DataFrame, ts: str = "ts", out: str = "phase") -> DataFrame:
    """Phase of each timestamp; closed on days that are not in the calendar."""
    flagged = is_trade_day(df, calendar, dt=ts, out="_trade_day")
    return flagged.withColumn(out, F.when(F.col("_trade_day"), phase_of_time(ts)).otherwise(F.lit(CLOSED))).drop("_trade_day")
