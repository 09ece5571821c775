"""Live operators that run the batch operators per micro-batch, and the order state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.functions import orders as O
from tickloom.operators.adjust import to_real_price
from tickloom.operators.asof import asof_join
from tickloom.operators.factors import BUILTIN, FactorBook, lookback_of, with_factors
from tickloom.operators.ledger import account_assets, positions_from_orders
from tickloom.operators.sets import latest_record
from tickloom.operators.series import CODE, DT, POS, with_positions
from tickloom.session import stored

#: Bars of a code that meet a quote's look-back together.
BLOCK = 128


def asof_factors(quotes: DataFrame, hist: DataFrame, names: Iterable[str], min_bars: int, book: FactorBook = BUILTIN, unit: str = "year") -> DataFrame:
    """Factors of each quote (code, dt, ...), as if its history ended the day before: quotes of any number of days in
    one plan.

    A quote takes its code's market-value rank of the last bar before its day; quotes without one are dropped, and so
    are those that have fewer than ``min_bars`` bars with themselves. Each quote is the end of a series of its own, made
    of as many earlier bars as the factors look back on, which keep their numbers in the whole history. So the work
    follows the quotes and the look-back, not the days or the length of the history. ``quotes`` has one row per code and day.
    """
    names = list(names)
    hist = stored(with_positions(hist, unit=unit), "history")
    ranked = hist.select(CODE, F.col(DT).alias("_bar_dt"), F.col(POS).alias("_last"), "mkt_cap_rank")
    ends = asof_join(quotes.drop("mkt_cap_rank", POS), ranked, ["_last", "mkt_cap_rank"], right_on="_bar_dt", allow_exact=False, unit=unit)
    ends = ends.where(F.col("mkt_cap_rank").isNotNull() & (F.col("_last") + 2 >= min_bars)).withColumn(POS, F.col("_last") + 1)
    ends = stored(ends.withColumns({"_series": F.concat_ws("|", F.col(CODE).cast("string"), F.col(DT).cast("string"))}), "quotes")

    back = lookback_of(names, book, hist.columns)
    block = lambda c: F.floor(c / BLOCK)
    spans = ends.select("_series", F.col(CODE).alias("_code"), F.col(POS).alias("_end"))
    spans = spans.withColumn("_block", F.explode(F.sequence(block(F.greatest(F.col("_end") - back, F.lit(0))), block(F.greatest(F.col("_end") - 1, F.lit(0))))))
    past = hist.withColumns({"_code": F.col(CODE), "_block": block(F.col(POS))}).join(spans, ["_code", "_block"])
    past = past.where(F.col(POS).between(F.col("_end") - back, F.col("_end") - 1)).select("_series", *hist.columns)
    series = past.withColumn("_quote", F.lit(False)).unionByName(ends.drop("_last").withColumn("_quote", F.lit(True)), allowMissingColumns=True)
    return with_factors(series, names, book, key="_series", unit=unit, keep_pos=True).where("_quote").drop("_quote", "_series", POS)


def latest_quotes(batch: DataFrame, ts: str = "ts") -> DataFrame:
    """The last quote per code and day."""
    others = [c for c in batch.columns if c not in (CODE, DT)]
    last = batch.groupBy(CODE, DT).agg(F.max_by(F.struct(*others), ts).alias("_r"))
    return last.select(CODE, DT, *[F.col("_r")[c].alias(c) for c in others if c != ts])


def open_factors_sink(hist: DataFrame, names: Iterable[str], path: str, min_bars: int, book: FactorBook = BUILTIN):
    """Batch handler: the opening quotes of a day give that day's factor table, once per code and day.

    Each batch overwrites its own folder ``batch=<id>`` and looks only at earlier batches for codes that are done, so a
    batch repeated after a failure gives the same rows, and codes whose quote comes later are still added. A batch may
    hold any number of days.
    """
    names = list(names)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            keys = StructType([batch.schema[CODE], batch.schema[DT], StructField("batch", LongType())])
            done = spark.read.schema(keys).parquet(path).where(F.col("batch") < batch_id)
            batch = batch.join(done.select(CODE, DT), [CODE, DT], "left_anti")
        rows = asof_factors(latest_quotes(batch), hist, names, min_bars, book)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def close_monitor_sink(
    hist: DataFrame, positions: DataFrame, adjust: DataFrame, names: Iterable[str], rule: Column, path: str, min_bars: int,
    book: FactorBook = BUILTIN,
):
    """Batch handler: near the close, factors of held codes are computed with the latest quote, and positions whose
    closing rule triggers are written with the quoted price. Each batch overwrites its own folder ``batch=<id>``; it may
    hold any number of days."""
    names = list(names)

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = positions.select(CODE).distinct()
        quotes = latest_quotes(batch).join(held, CODE, "left_semi")
        rows = asof_factors(quotes, hist.join(held, CODE, "left_semi"), names, min_bars, book).where(rule)
        orders = to_real_price(rows, adjust, "close", "order_price").select(CODE, DT, "order_price")
        orders.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


# -- orders ------------------------------------------------------------------------------------------------------------

def expiring_orders(orders: DataFrame, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Emit each order that is still open ``ttl_seconds`` of event time after it was placed.

    The records of an order are one session window: each reaches from its event time until just after the order's time to
    live, so all before that end merge, and the state holds only their latest by event time. A late record never
    reopens an order that was filled or cancelled. The window ends when the watermark has passed the time to live;
    a record from after it is a window of its own, and what it says doesn't change what the order was when it expired.
    """
    events = orders.select("id", CODE, "direction", "price", "timestamp", "event_ts", O.is_open().alias("open"))
    placed, seen = F.unix_micros("timestamp"), F.unix_micros("event_ts")
    # one microsecond more: an order expires when the watermark has passed its time to live, not when it meets it
    until = F.greatest(placed + F.lit(ttl_seconds * 1_000_000), seen) + 1
    gap = F.make_interval(secs=(until - seen).cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(7,0)"))
    # of records with one event time, a closing one wins
    order = F.struct("event_ts", ~F.col("open"))
    last = events.withWatermark("event_ts", delay).groupBy("id", F.session_window("event_ts", gap)).agg(
        F.max_by(F.struct(CODE, "direction", "price", "open"), order).alias("_last"), F.min("timestamp").alias("timestamp")
    )
    expired_at = F.timestamp_micros(F.unix_micros("timestamp") + F.lit(ttl_seconds * 1_000_000))
    return last.where("_last.open").select("id", *[F.col("_last")[c].alias(c) for c in (CODE, "direction", "price")], "timestamp", expired_at.alias("expired_at"))


def not_at_best_price(expired: DataFrame, ask_bid: DataFrame) -> DataFrame:
    """Expired orders that do not stand at the best price of their side."""
    best = ask_bid.select(CODE, F.get("buy", F.lit(0)).alias("_buy1"), F.get("sell", F.lit(0)).alias("_sell1"))
    queue = F.when(O.is_buy(), F.col("_buy1")).otherwise(F.col("_sell1"))
    return expired.join(best, CODE).where(~F.coalesce(F.col("price") == queue, F.lit(False))).drop("_buy1", "_sell1")


UNACKNOWLEDGED_SECONDS = 10


def latest_orders(orders: DataFrame, now: Column | str | None = None) -> DataFrame:
    """Latest record per order id; orders only ``created`` and unacknowledged for more than 10 seconds drop out."""
    last = latest_record(orders, key="id", dt="event_ts")
    now = F.current_timestamp() if now is None else (F.lit(now).cast("timestamp") if isinstance(now, str) else now)
    age = F.unix_timestamp(now) - F.unix_timestamp("event_ts")
    return last.where(~((F.col("status") == "created") & (age > UNACKNOWLEDGED_SECONDS)))


def account_state_sink(overnight: DataFrame, opening: DataFrame, path: str, now: str | None = None):
    """Batch handler: keeps the latest record per order and rewrites positions and account after every batch.

    Each batch reads the order table its predecessor wrote and writes its own, so repeating a batch gives the same
    tables; a predecessor's table that is missing fails the batch instead of starting anew. The state is one row per
    order of the day.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/orders/batch={batch_id - 1}"
        known = spark.read.schema(batch.schema).parquet(before) if batch_id else batch.limit(0)
        current = latest_record(known.unionByName(batch), key="id", dt="event_ts")
        current.write.mode("overwrite").parquet(f"{path}/orders/batch={batch_id}")
        orders = latest_orders(spark.read.schema(batch.schema).parquet(f"{path}/orders/batch={batch_id}"), now)
        positions = positions_from_orders(overnight, orders)
        positions.write.mode("overwrite").parquet(f"{path}/positions/batch={batch_id}")
        account_assets(orders, positions, opening).write.mode("overwrite").parquet(f"{path}/account/batch={batch_id}")

    return handle
