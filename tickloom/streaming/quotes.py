"""Live quotes: typed stream, signals, exits, one action per day, stale ticks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tickloom import schemas
from tickloom.functions import codes as C, rules
from tickloom.functions.dates import TRADABLE_PHASES, market_phase
from tickloom.operators.adjust import adjust_latest
from tickloom.operators.filters import not_blacklisted, not_in, tradable_markets
from tickloom.operators.series import CODE


def read_quotes(spark: SparkSession, path: str, schema: StructType | str = schemas.QUOTE, **options) -> DataFrame:
    """File stream of quotes. Event times without a zone become TIMESTAMP (the session runs in UTC)."""
    raw = spark.readStream.schema(schema).options(**options).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in raw.columns else raw


def quote_stream(
    quotes: DataFrame,
    calendar: DataFrame,
    markets: Iterable[str] | None = tuple(C.TRADABLE_MARKETS),
    phases: Iterable[str] = tuple(TRADABLE_PHASES),
) -> DataFrame:
    """Add phase and market; keep tradable phases and the given markets."""
    phased = market_phase(quotes, calendar).where(F.col("phase").isin(list(phases)))
    return phased if markets is None else tradable_markets(phased, markets)


def late_ticks(quotes: DataFrame, delay_seconds: float, ingest: Column | None = None) -> DataFrame:
    """Discard ticks older than the allowance when they are taken in."""
    arrived = F.current_timestamp() if ingest is None else ingest
    age = F.unix_micros(arrived.cast("timestamp")) - F.unix_micros(F.col("ts"))
    return quotes.where(age <= F.lit(int(delay_seconds * 1_000_000)))


def signal_stream(
    quotes: DataFrame, factors: DataFrame, adjust: DataFrame, rule: Column, price: str = "close", exclude: Iterable[DataFrame] = (), blacklist: DataFrame | None = None
) -> DataFrame:
    """Adjust each tick, lay it over the day's factors and emit the ticks that trigger: (code, ts, order_price).

    Codes of the ``exclude`` tables (held, already traded) and those on the blacklist at the tick's day never trigger.

    The factor table is static within the day, so this is a stream-static join without state.
    """
    for table in exclude:
        quotes = not_in(quotes, table)
    if blacklist is not None:
        quotes = not_blacklisted(quotes.withColumn("_day", F.to_date("ts")), blacklist, date_col="_day").drop("_day")
    adjusted = adjust_latest(quotes, adjust)
    shared = [c for c in adjusted.columns if c in factors.columns and c != CODE]
    live = adjusted.withColumnsRenamed({c: f"_q_{c}" for c in shared})
    joined = live.join(factors, CODE).withColumns({c: F.coalesce(f"_q_{c}", c) for c in shared})
    return joined.where(rule).select(CODE, "ts", F.col(price).alias("order_price"))


def exit_monitor(quotes: DataFrame, positions: DataFrame, stop_loss: float, take_profit: float) -> DataFrame:
    """Ticks that close a held position: take-profit is looked at first, else stop-loss, on the latest close."""
    held = positions.select(CODE, F.col("price").alias("entry_price"))
    joined = quotes.join(held, CODE)
    take = rules.live_take_profit("entry_price", float(take_profit))
    stop = rules.live_stop_loss("entry_price", float(stop_loss))
    marked = joined.withColumn(
        "action", F.when(take.isNotNull(), F.lit(C.TAKE_PROFIT)).when(stop.isNotNull(), F.lit(C.STOP_LOSS))
    )
    return marked.where(F.col("action").isNotNull()).select(CODE, "ts", "entry_price", F.col("close").alias("exit_price"), "action")


def one_per_day(events: DataFrame, keys: Iterable[str] = (CODE,), ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first event of each key and day; repeats are dropped while their state lives."""
    dated = events.withColumn("day", F.to_date(ts))
    return dated.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, "day"])
