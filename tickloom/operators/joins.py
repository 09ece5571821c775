"""Lookups between bars, releases, names, listings, valuations and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalar import rounded
from tickloom.operators.asof import asof_join
from tickloom.operators.filters import min_history
from tickloom.operators.quantiles import percentiles_below
from tickloom.operators.series import CODE, DT, drawdown, fill


def nearest_release(
    bars: DataFrame, releases: DataFrame, direction: str = "next", dt: str = DT, unit: str = "year"
) -> DataFrame:
    """Add date, category and percentage of the nearest share release: ``last`` (on or before the bar) or
    ``next`` (on or after it); NULL where there is none."""
    if direction not in ("last", "next"):
        raise ValueError(f"unknown direction {direction!r}")
    known = releases.select(
        CODE, "dt", F.col("dt").alias("release_dt"), F.col("category").alias("release_category"), F.col("pct_shares").alias("release_pct")
    ).withColumnRenamed("dt", "_release_at")
    return asof_join(
        bars,
        known,
        ["release_dt", "release_category", "release_pct"],
        left_on=dt,
        right_on="_release_at",
        direction="backward" if direction == "last" else "forward",
        unit=unit,
    )


def patch_company_names(bars: DataFrame, changes: DataFrame, listing: DataFrame, dt: str = DT) -> DataFrame:
    """Add ``company``: the name in force on each day.

    Days before the first change take the first later name. Codes without a change record take the listing's
    name; codes that never carried "ST" in a name keep one name too, the latest on record.
    """
    history = changes.select(CODE, F.col("dt").alias("_changed"), F.col("company").alias("_name"))
    verdict = history.groupBy(CODE).agg(
        F.max(F.col("_name").contains("ST")).alias("_flagged"), F.max_by("_name", "_changed").alias("_latest")
    )
    flagged = history.join(verdict.where("_flagged").select(CODE), CODE, "left_semi")
    past = asof_join(bars, flagged, ["_name"], left_on=dt, right_on="_changed")
    first = flagged.groupBy(CODE).agg(F.min_by("_name", "_changed").alias("_first"))
    names = listing.select(CODE, F.col("name").alias("_listed")).distinct()
    joined = past.join(first, CODE, "left").join(verdict.select(CODE, "_latest"), CODE, "left").join(names, CODE, "left")
    company = F.coalesce("_name", "_first", "_latest", "_listed")
    return joined.withColumn("company", company).drop("_name", "_first", "_latest", "_listed")


def listed_only(bars: DataFrame, listing: DataFrame, key: str = CODE) -> DataFrame:
    return bars.join(listing.select(key).distinct(), key, "left_semi")


def enrich_listing(listing: DataFrame, info: DataFrame, fields=("sector", "listdate", "total_share", "float_share")) -> DataFrame:
    return listing.join(info.select(CODE, *fields), CODE, "left")


def attach_indicators(bars: DataFrame, valuations: DataFrame, how: str = "left", keys: tuple[str, ...] = (CODE, DT)) -> DataFrame:
    """``left`` keeps bars without a valuation (to be imputed); ``inner`` is the fallback path."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how!r}")
    return bars.join(valuations, list(keys), how)


def impute_mkt_cap(bars: DataFrame, valuations: DataFrame, unit: str = "year") -> DataFrame:
    """Market value on every bar: shares are known where a valuation exists, filled backward then forward
    elsewhere, and multiplied by the close (two digits)."""
    joined = attach_indicators(bars, valuations.select(CODE, DT, F.col("mkt_cap").alias("_cap")))
    shares = joined.withColumn("_shares", F.try_divide(F.col("_cap"), F.col("close"))).drop("_cap")
    filled = fill(shares, "_shares", "both", unit=unit)
    return filled.withColumn("mkt_cap", rounded(F.col("_shares") * F.col("close"))).drop("_shares")


def mkt_cap_rank(bars: DataFrame, dt: str = DT) -> DataFrame:
    """Share of the 100 percentiles 0..99 of the day that lie strictly below each value.

    Days whose rank is complete are kept as they are. Only the missing days are ranked.
    """
    has_rank = "mkt_cap_rank" in bars.columns
    todo = bars
    if has_rank:
        open_days = bars.groupBy(dt).agg(F.max(F.col("mkt_cap_rank").isNull()).alias("_open")).where("_open").select(dt)
        todo = bars.join(open_days, dt, "left_semi")
    fresh = F.col("_below") / F.lit(100.0)
    rank = F.coalesce(fresh, F.col("mkt_cap_rank")) if has_rank else fresh
    return percentiles_below(bars, todo, [dt], "mkt_cap", 100, "_below").withColumn("mkt_cap_rank", rank).drop("_below")


def overlay_quotes(factors: DataFrame, quotes: DataFrame, key: str = CODE) -> DataFrame:
    """Non-NULL quote values overwrite the columns of the same name."""
    shared = [c for c in quotes.columns if c in factors.columns and c != key]
    renamed = quotes.select(key, *[F.col(c).alias(f"_q_{c}") for c in shared])
    joined = factors.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_q_{c}", c) for c in shared}).select(*factors.columns)


def merge_quote_into_history(hist: DataFrame, quotes: DataFrame, min_bars: int, key: str = CODE, dt: str = DT) -> DataFrame:
    """Append the current quote to each history: it takes the code's last market-value rank, codes without one
    are dropped, and so are codes with fewer than ``min_bars`` bars in all."""
    last = hist.groupBy(key).agg(F.max_by("mkt_cap_rank", dt).alias("mkt_cap_rank"))
    current = quotes.drop("mkt_cap_rank").join(last.where(F.col("mkt_cap_rank").isNotNull()), key)
    return min_history(hist.unionByName(current, allowMissingColumns=True), min_bars, key)


def append_missing_quote(bars: DataFrame, quotes: DataFrame, key: str = CODE, dt: str = DT) -> DataFrame:
    """Add the quote of a code only when its history ends before the quote's day."""
    ends = bars.groupBy(key).agg(F.max(dt).alias("_end"))
    late = quotes.join(ends, key).where(F.col("_end") < F.col(dt)).drop("_end")
    return bars.unionByName(late.select(*[c for c in bars.columns if c in late.columns]), allowMissingColumns=True)


def benchmark(
    capital: DataFrame, index_bars: DataFrame, name: str = "SSE", since="1900-01-01", until="3000-01-01", dt: str = DT
) -> DataFrame:
    """Capital next to an index: OHLC of the index by date, capital padded forward, the date range, and the
    drawdown within it in percent. Days without an index bar drop out.

    One row per day, so a run of decades is a few thousand rows and one ordered window serves it.
    """
    prices = index_bars.select(dt, *[F.col(p).alias(f"{name}_{p}") for p in ("open", "high", "low", "close")])
    joined = capital.join(prices, dt, "left").withColumn("_run", F.lit(0))
    for c in ("capital", "market_value", "free_cash_amount"):
        joined = fill(joined, c, "pad", key="_run", order=dt)
    kept = joined.dropna().where(F.col(dt).between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    marked = drawdown(kept, "capital", key="_run", order=dt)
    return marked.withColumn("drawdown", rounded(F.lit(100.0) * F.col("drawdown"))).drop("_run")


def name_to_code(df: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    return df.join(listing.select(name, CODE).distinct(), name)


