"""Price adjustment: historical, latest, and minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalar import rounded
from tickloom.operators.asof import asof_join
from tickloom.operators.factors import extended, returns, with_factors
from tickloom.operators.series import CODE, DT
from tickloom.session import stored

PRICES = ["open", "high", "low", "close"]
FIRST_DAY, LAST_DAY = "1900-01-01", "3000-01-01"


def pad_factor_bounds(factors: DataFrame, key: str = CODE) -> DataFrame:
    """Add the start bound (first factor) and the end bound (NULL factor) of each code unless present."""
    first, last = F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")
    ends = factors.groupBy(key).agg(
        F.min_by("factor", "valid_from").alias("factor"),
        F.min("valid_from").alias("_min"),
        F.max("valid_from").alias("_max"),
    )
    starts = ends.where(F.col("_min") > first).select(key, first.alias("valid_from"), "factor")
    stops = ends.where(F.col("_max") < last).select(key, last.alias("valid_from"), F.lit(None).cast("double").alias("factor"))
    return factors.select(key, "valid_from", "factor").unionByName(starts).unionByName(stops)


def adjust_factor_at(bars: DataFrame, factors: DataFrame, out: str = "factor", unit: str = "year") -> DataFrame:
    """Add the factor in force on each bar's day: the one with the largest ``valid_from <= dt``."""
    known = factors.where(F.col("factor").isNotNull()).select(CODE, "valid_from", F.col("factor").alias(out))
    return asof_join(bars, known, [out], right_on="valid_from", unit=unit)


def adjust_prices(bars: DataFrame, factors: DataFrame, *, unit: str = "year", drop_missing: bool = True, keep_pos: bool = False) -> DataFrame:
    """Multiply prices by the factor in force, keep the raw open as ``orig_open``, add chg and pct_chg.

    Changes come from the unrounded adjusted closes; prices and changes are then rounded to two digits. Bars
    already adjusted (``orig_open`` present) are returned as they are. Codes without a factor are dropped.
    ``keep_pos`` keeps the bar number per code that the changes need.
    """
    if "orig_open" in bars.columns:
        return bars
    found = adjust_factor_at(bars, factors, "_factor", unit)
    if drop_missing:
        found = found.where(F.col("_factor").isNotNull())
    # the numbering of bars reads them twice, so the look-up is stored
    found = stored(found, "adjusting")
    scaled = found.withColumn("orig_open", F.col("open")).withColumns({p: F.col(p) * F.col("_factor") for p in PRICES})
    moved = with_factors(scaled.drop("_factor", "chg", "pct_chg"), ["chg", "pct_chg"], extended(returns()), unit=unit, keep_pos=keep_pos)
    return moved.withColumns({p: rounded(p) for p in [*PRICES, "orig_open"]})


def latest_factor(factors: DataFrame, key: str = CODE) -> DataFrame:
    """(code, factor): last non-NULL factor per code."""
    known = factors.where(F.col("factor").isNotNull())
    return known.groupBy(key).agg(F.max_by("factor", "valid_from").alias("factor"))


def adjust_latest(quotes: DataFrame, factors: DataFrame, key: str = CODE) -> DataFrame:
    """Multiply the latest quotes by their code's last factor; NULL prices where there is none."""
    last = latest_factor(factors, key).withColumnRenamed("factor", "_factor")
    joined = quotes.join(last, key, "left")
    return joined.withColumns({p: F.col(p) * F.col("_factor") for p in PRICES}).drop("_factor")


def to_real_price(df: DataFrame, factors: DataFrame, price: str = "price", out: str = "real_price", key: str = CODE) -> DataFrame:
    """Adjusted price → quoted price, two digits."""
    last = latest_factor(factors, key).withColumnRenamed("factor", "_factor")
    joined = df.join(last, key, "left")
    return joined.withColumn(out, rounded(F.try_divide(F.col(price), F.col("_factor")))).drop("_factor")


def minute_adjust(minute: DataFrame, day: DataFrame, key: str = CODE, dt: str = DT) -> DataFrame:
    """Bring minute prices to the level of the adjusted day bar of the same code and day.

    The raw minute open stays as ``orig_open``; codes without a day bar (suspended) drop out.
    """
    ratio = day.select(key, dt, F.try_divide(F.col("open"), F.col("orig_open")).alias("_ratio"))
    joined = minute.join(ratio, [key, dt])
    return (
        joined.withColumn("orig_open", F.col("open"))
        .withColumns({p: F.col(p) * F.col("_ratio") for p in PRICES})
        .drop("_ratio")
    )


