"""Streams over the events and orders, run to the end of their input and checked against SQL over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.dates import TRADABLE_PHASES, make_calendar
from tickloom.functions import scalar as S
from tickloom.operators.series import CODE, DT
from tickloom.streaming import live, quotes as Q
from tickloom.streaming.sinks import new_dir, run_batches, run_to_table
from tickloom.workload.ledger import BOOK, SIDE_TOTALS, coded
from tickloom.workload.lookups import PHASE_SQL
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, with_views

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(v: Views) -> DataFrame:
    raw = Q.read_quotes(v.spark, v.sf_dir, EVENTS, pathGlobFilter="events.parquet")
    return raw.select(F.col("user_id").alias(CODE), "ts", F.col("value").alias("close"))


def restreamed(v: Views, df: DataFrame, name: str, batches: int = 2) -> DataFrame:
    """The rows as a stream of several micro-batches. Rows are written where they are, in as many files as the input has
    parts, so neither writing nor a micro-batch is the work of a few tasks."""
    path = new_dir(v.spark, name)
    df.write.parquet(path)
    files = len(v.spark.read.schema(df.schema).parquet(path).inputFiles())
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def finished(v: Views, stream: DataFrame, name: str) -> DataFrame:
    return run_to_table(stream, new_dir(v.spark, name))


SECONDS = "(SELECT *, hour(ts)*3600+minute(ts)*60+CAST(floor(second(ts)) AS INTEGER) AS s FROM ticks)"
PHASES = "(" + ",".join(f"'{p}'" for p in TRADABLE_PHASES) + ")"


@query("quote_stream", with_views("ticks", body=f"SELECT code AS k, ts, phase FROM (SELECT *, {PHASE_SQL} AS phase FROM {SECONDS}) WHERE phase IN {PHASES} AND code%9<3"))
def _quotes(v: Views) -> DataFrame:
    days = make_calendar(v.ticks.select("ts").where(F.weekday("ts") < 5), "ts")
    ticks = coded(tick_stream(v).withColumn("k", F.col(CODE)), "k")
    return finished(v, Q.quote_stream(ticks, days), "quotes").select("k", "ts", "phase")


@query("late_ticks", with_views("ticks", body="SELECT code, ts, price AS close FROM ticks WHERE code%10<=5"))
def _late(v: Views) -> DataFrame:
    taken_in = F.timestamp_add("SECOND", F.col(CODE) % 10, F.col("ts"))
    return finished(v, Q.late_ticks(tick_stream(v), 5.0, taken_in), "late")


LIMITS = ", lim AS (SELECT code, arg_max(factor, valid_from) AS factor, CAST(code%40+1 AS DOUBLE) AS lim FROM factors GROUP BY code)"


@query(
    "signal_stream",
    with_views("ticks", "factors", body=LIMITS + """SELECT code, ts, price*factor AS order_price FROM ticks JOIN lim USING (code)
WHERE price*factor<lim AND code%7<>0 AND NOT (code%5=0 AND CAST(ts AS DATE)<=DATE '2024-01-15')"""),
)
def _signals(v: Views) -> DataFrame:
    last = v.factors.select(CODE).distinct()
    limits = last.withColumn("lim", (F.col(CODE) % 40 + 1).cast("double"))
    held, black = last.where(F.col(CODE) % 7 == 0), last.where(F.col(CODE) % 5 == 0).withColumn("until", F.lit("2024-01-15").cast("date"))
    ticks = tick_stream(v).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    return finished(v, Q.signal_stream(ticks, limits, v.factors, F.col("close") < F.col("lim"), exclude=[held], blacklist=black), "signals")


CHANGE = r("1e2*(price-10e0)/10e0")


@query(
    "exit_monitor",
    with_views("ticks", body=f"""SELECT code, ts, 10e0 AS entry_price, price AS exit_price, CASE WHEN {CHANGE}>=4e0 THEN 'TAKE_PROFIT' ELSE 'STOP_LOSS' END AS action
FROM ticks WHERE code%3=0 AND ({CHANGE}>=4e0 OR {CHANGE}<=-3e0)"""),
)
def _exits(v: Views) -> DataFrame:
    held = v.ticks.select(CODE).distinct().where(F.col(CODE) % 3 == 0).withColumn("price", F.lit(10.0))
    return finished(v, Q.exit_monitor(tick_stream(v), held, 3.0, 4.0), "exits")


@query("one_per_day", with_views("ticks", body="SELECT DISTINCT code, CAST(ts AS DATE) AS day FROM ticks"))
def _one_per_day(v: Views) -> DataFrame:
    return finished(v, Q.one_per_day(tick_stream(v)), "daily").select(CODE, "day")


# -- factors of a day -------------------------------------------------------------------------------------------------

DAILY = f""", hist AS (SELECT code, CAST(ts AS DATE) AS dt, arg_max(price, ts) AS close FROM ticks GROUP BY ALL),
f AS (SELECT code, dt, close, {r('avg(close) OVER (PARTITION BY code ORDER BY dt ROWS 2 PRECEDING)', 6)} AS sma3, avg(close) OVER (PARTITION BY code ORDER BY dt ROWS 2 PRECEDING) AS m,
  row_number() OVER (PARTITION BY code ORDER BY dt) AS n FROM hist),
d AS (SELECT * FROM f WHERE n>=3)"""


def _history(v: Views) -> DataFrame:
    last = v.ticks.groupBy(CODE, F.to_date("ts").alias(DT)).agg(F.max_by("price", "ts").alias("close"), F.max("ts").alias("ts"))
    return last.withColumns({**{c: F.col("close") for c in ("open", "high", "low")}, "vol": F.lit(1.0), "mkt_cap_rank": F.lit(0.5)})


def run_days(v: Views, make: Callable[[DataFrame, str], Callable]) -> str:
    """Stream the quotes of all days through a batch handler; returns the folder it fills."""
    quotes, path = _history(v).drop("mkt_cap_rank"), new_dir(v.spark, "days")
    run_batches(restreamed(v, quotes, "day-quotes"), make(_history(v).drop("ts"), path), path + "-run")
    return path


@query("day_open_factors", with_views("ticks", body=DAILY + "SELECT code, dt, sma3 FROM d"))
def _open_factors(v: Views) -> DataFrame:
    path = run_days(v, lambda hist, path: live.open_factors_sink(hist, ["sma3"], path, 3))
    schema = "code bigint, dt date, sma3 double"
    return v.spark.read.schema(schema).parquet(path).select(CODE, DT, S.rounded("sma3", 6).alias("sma3"))


@query(
    "close_monitor",
    with_views("ticks", "factors", body=DAILY + LIMITS + f"SELECT code, dt, {r('close/factor')} AS order_price FROM d LEFT JOIN lim USING (code) WHERE code%2=0 AND close>m"),
)
def _close_monitor(v: Views) -> DataFrame:
    held = v.ticks.select(CODE).distinct().where(F.col(CODE) % 2 == 0)
    path = run_days(v, lambda hist, path: live.close_monitor_sink(hist, held, v.factors, ["sma3"], F.col("close") > F.col("sma3"), path, 3))
    schema = "code bigint, dt date, order_price double"
    return v.spark.read.schema(schema).parquet(path).select(CODE, DT, "order_price")


# -- orders -------------------------------------------------------------------------------------------------------------

TTL = 86_400 * 30


@query(
    "expiring_orders",
    with_views("oledger", body=f"""SELECT id, code, direction, price, timestamp, timestamp+to_seconds({TTL}) AS expired_at FROM oledger
WHERE status='pending' AND vol>filled_vol AND timestamp+to_seconds({TTL})<(SELECT max(timestamp) FROM oledger)"""),
)
def _expiring(v: Views) -> DataFrame:
    """Filled orders also send an older pending record, which must not reopen them."""
    orders = v.orders.withColumn("event_ts", F.col("timestamp"))
    stale = orders.where(F.col("status") == "filled").withColumns({"status": F.lit("pending"), "filled_vol": F.lit(0).cast("bigint"), "event_ts": F.timestamp_add("SECOND", F.lit(-1), F.col("event_ts"))})
    return finished(v, live.expiring_orders(restreamed(v, orders.unionByName(stale), "order-records", 1), TTL), "expired")


@query("account_state", with_views(*BOOK, body=SIDE_TOTALS + "SELECT id, code, vol, avail_vol, vol<0 OR avail_vol<0 AS invalid FROM pos"))
def _account_state(v: Views) -> DataFrame:
    """Every order is first seen as pending without a fill."""
    orders = v.orders.withColumn("event_ts", F.col("timestamp"))
    first = orders.withColumns({"status": F.lit("pending"), "filled_vol": F.lit(0).cast("bigint"), "event_ts": F.timestamp_add("SECOND", F.lit(-1), F.col("event_ts"))})
    path = new_dir(v.spark, "account")
    opening = v.capitals.agg(F.sum("market_value").alias("free_cash_amount"))
    run_batches(restreamed(v, first.unionByName(orders), "account-orders"), live.account_state_sink(v.positions, opening, path, "1999-01-01 00:00:00"), path + "/run")
    schema = "id string, code bigint, vol bigint, avail_vol bigint, invalid boolean, batch int"
    states = v.spark.read.schema(schema).parquet(path + "/positions")
    return states.join(states.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
