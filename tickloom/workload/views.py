"""Bars and the other tables of the data model, derived from the star-schema test tables.

Every view has a Spark form (``Views``) and the same definition in SQL (``CTE``) for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickloom.functions.dates import make_calendar
from tickloom.functions.scalar import rounded
from tickloom.operators.adjust import adjust_prices

_CENTS = 1 << 14  # prices stay below 163.84
_LINES = 1 << 3


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars. Trade order and price are packed into one BIGINT, so that first and last price are plain
        min and max, which aggregate by hashing with partial sums instead of sorting rows."""
        line = self.table("lineitem")
        cents = F.rint(F.lit(50.0) * (F.lit(1.0) + F.col("l_discount") - F.col("l_tax")) * F.lit(100.0)).cast("bigint")
        key = (F.col("l_orderkey") * _LINES + F.col("l_linenumber")) * _CENTS + cents
        rows = line.select(
            F.col("l_suppkey").alias("code"),
            F.col("l_shipdate").cast("date").alias("dt"),
            cents.alias("cents"),
            key.alias("key"),
            F.col("l_quantity").alias("qty"),
        )
        price = lambda c: F.pmod(c, F.lit(_CENTS)) / F.lit(100.0)
        return rows.groupBy("code", "dt").agg(
            price(F.min("key")).alias("open"),
            (F.max("cents") / F.lit(100.0)).alias("high"),
            (F.min("cents") / F.lit(100.0)).alias("low"),
            price(F.max("key")).alias("close"),
            F.sum("qty").alias("vol"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return make_calendar(self.table("lineitem").select(F.col("l_shipdate").alias("dt")))

    @cached_property
    def listing(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.table("supplier")
            .join(place, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("code"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("market"),
                F.col("r_name").alias("sector"),
                F.abs("s_acctbal").alias("total_share"),
            )
        )

    @cached_property
    def factors(self) -> DataFrame:
        years = self.table("supplier").select(
            F.col("s_suppkey").alias("code"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y")
        )
        factor = F.lit(1.0) + F.lit(0.1) * (F.col("y") - 1995) + F.lit(0.01) * (F.col("code") % 7)
        return years.select("code", F.make_date("y", F.lit(1), F.lit(1)).alias("valid_from"), factor.alias("factor"))

    @cached_property
    def releases(self) -> DataFrame:
        rows = self.table("supplier").select(
            F.col("s_suppkey").alias("code"),
            F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"),
        )
        rows = rows.select("*", F.explode(F.array(F.lit(3), F.lit(9))).alias("m"))
        return rows.select(
            "code",
            F.make_date("y", "m", F.lit(15)).alias("dt"),
            ((F.col("code") % 5) + 1).cast("double").alias("pct_shares"),
            F.when(F.col("m") == 3, F.lit("founders")).otherwise(F.lit("placement")).alias("category"),
        )

    @cached_property
    def adjusted(self) -> DataFrame:
        return adjust_prices(self.bars, self.factors)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_type").alias("kind")
        )

    @cached_property
    def minute(self) -> DataFrame:
        """Minute bars of the ticks: one bar per code, day and minute with a tick; high and low spread around it."""
        t = self.ticks.withColumns({"dt": F.col("ts").cast("date"), "time": F.date_format("ts", "HHmm")})
        return t.groupBy("code", "dt", "time").agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.count(F.lit(1)).cast("double").alias("vol"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Order records. The age within the day makes the timestamp; the status decides what was filled."""
        o, key = self.table("orders"), F.col("o_orderkey")
        status = F.col("o_orderstatus")
        vol = (key % 9 + 1) * 100
        price = F.col("o_totalprice") / F.lit(100.0)
        filled = F.when(status == "F", vol).when(status == "O", F.lit(0)).otherwise((vol / 2).cast("bigint"))
        return o.select(
            key.cast("string").alias("id"),
            F.col("o_custkey").alias("code"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(key % 20_000).cast("decimal(18,6)"))).alias("timestamp"),
            price.alias("price"),
            vol.alias("vol"),
            F.when(filled > 0, price - F.lit(0.01)).otherwise(F.lit(0.0)).alias("filled_price"),
            filled.alias("filled_vol"),
            F.when(status == "F", F.lit("filled")).when(status == "O", F.lit("pending")).otherwise(F.lit("cancelled")).alias("status"),
            F.when(key % 2 == 0, F.lit("buy")).otherwise(F.lit("sell")).alias("direction"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        """Overnight positions, one per customer."""
        c = self.table("customer")
        vol = (F.col("c_custkey") % 7) * 400
        return c.select(
            F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("id"),
            F.col("c_custkey").alias("code"),
            (F.lit(20.0) + F.col("c_custkey") % 50).alias("price"),
            vol.alias("vol"),
            rounded(F.lit(20.0) + F.col("c_custkey") % 50 + F.col("c_acctbal") / F.lit(1000.0)).alias("latest_price"),
            vol.alias("avail_vol"),
            vol.alias("yesterday_vol"),
        )

    @cached_property
    def capitals(self) -> DataFrame:
        """Daily capital logs of 25 runs: totals per order day and priority block, offset so that they stay positive."""
        o = self.table("orders")
        daily = o.groupBy((F.col("o_custkey") % 25).alias("run"), F.col("o_orderdate").cast("date").alias("dt")).agg(
            F.sum(F.round(F.col("o_totalprice")).cast("bigint")).alias("t")
        )
        return daily.select(
            F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"),
            "dt",
            F.col("t").cast("double").alias("market_value"),
            (F.lit(1_000_000.0) + F.col("run") * 1000).alias("free_cash_amount"),
            F.lit(0.0).alias("frozen_cash_amount"),
        )

    @cached_property
    def trade_rows(self) -> DataFrame:
        """Trade-log rows per run from line items: actions by return flag, changes from discount and tax."""
        li = self.table("lineitem")
        action = (
            F.when(F.col("l_linenumber") <= 3, F.lit("OPEN"))
            .when(F.col("l_returnflag") == "R", F.lit("STOP_LOSS"))
            .when(F.col("l_returnflag") == "A", F.lit("TAKE_PROFIT"))
            .otherwise(F.lit("CLOSE"))
        )
        pct = F.when(F.col("l_linenumber") <= 3, F.lit(0.0)).otherwise(
            F.rint((F.col("l_discount") - F.col("l_tax")) * F.lit(100.0))
        )
        return li.select(
            F.concat(F.lit("r"), (F.col("l_partkey") % 25).cast("string")).alias("run_id"),
            F.col("l_shipdate").cast("date").alias("timestamp"),
            action.alias("action"),
            pct.alias("pct_chg"),
        )

    def last_day(self):
        return Window.partitionBy("code").orderBy(F.desc("dt"))


def r(x: str, digits: int = 2) -> str:
    """Half-to-even rounding on the scaled value, as ``rounded``."""
    return f"(round_even(({x})*1e{digits},0)/1e{digits})"


def u(*keys: str, seed: int = 0) -> str:
    """The repeatable uniform number of ``scalar.uniform``."""
    text = "concat_ws('|'," + ",".join(f"CAST({k} AS VARCHAR)" for k in keys) + f",'{seed}')"
    return f"((CAST(('0x'||substr(md5({text}),1,13)) AS BIGINT)+0.5e0)/4503599627370496e0)"


CTE = {
    "bars": """bars AS MATERIALIZED (SELECT code, dt, arg_min(price, (l_orderkey, l_linenumber, price)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (l_orderkey, l_linenumber, price)) AS close, sum(l_quantity) AS vol
  FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS dt, l_orderkey, l_linenumber, l_quantity,
        round(50e0*(1e0+l_discount-l_tax),2) AS price FROM lineitem) GROUP BY code, dt)""",
    "calendar": """calendar AS MATERIALIZED (SELECT dt, row_number() OVER (ORDER BY dt) AS idx
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem))""",
    "listing": """listing AS (SELECT s_suppkey AS code, s_name AS name, n_name AS market, r_name AS sector, abs(s_acctbal) AS total_share
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)""",
    "factors": """factors AS (SELECT s_suppkey AS code, make_date(y,1,1) AS valid_from, 1e0+1e-1*(y-1995)+1e-2*(s_suppkey%7) AS factor
  FROM supplier, (SELECT CAST(unnest(range(1995,2002)) AS INTEGER) AS y))""",
    "releases": """releases AS (SELECT s_suppkey AS code, make_date(y,m,15) AS dt, CAST(s_suppkey%5+1 AS DOUBLE) AS pct_shares,
  CASE WHEN m=3 THEN 'founders' ELSE 'placement' END AS category
  FROM supplier, (SELECT CAST(unnest(range(1995,2002)) AS INTEGER) AS y), (SELECT unnest([3,9]) AS m))""",
    "adjusted": f"""adj0 AS (SELECT b.code, b.dt, b.open AS orig_open, b.open*f.factor AS o, b.high*f.factor AS h, b.low*f.factor AS l,
  b.close*f.factor AS c, b.vol FROM bars b ASOF JOIN factors f ON b.code=f.code AND b.dt>=f.valid_from),
adj1 AS (SELECT *, lag(c) OVER (PARTITION BY code ORDER BY dt) AS pc FROM adj0),
adjusted AS MATERIALIZED (SELECT code, dt, vol, {r('orig_open')} AS orig_open, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close,
  {r('coalesce(c-pc,0e0)')} AS chg, {r('coalesce(1e2*((c-pc)/pc),0e0)')} AS pct_chg FROM adj1)""",
    "ticks": "ticks AS (SELECT user_id AS code, ts, value AS price, event_type AS kind FROM events)",
    "minute": """minute AS MATERIALIZED (SELECT code, CAST(ts AS DATE) AS dt, strftime(ts,'%H%M') AS time, arg_min(price,ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price,ts) AS close, CAST(count(*) AS DOUBLE) AS vol FROM ticks GROUP BY ALL)""",
    "oledger": """oledger AS MATERIALIZED (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS code,
  CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey%20000) AS timestamp, o_totalprice/1e2 AS price, (o_orderkey%9+1)*100 AS vol,
  CASE WHEN o_orderstatus='O' THEN 0e0 ELSE o_totalprice/1e2-1e-2 END AS filled_price,
  CASE o_orderstatus WHEN 'F' THEN (o_orderkey%9+1)*100 WHEN 'O' THEN 0 ELSE (o_orderkey%9+1)*50 END AS filled_vol,
  CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
  CASE WHEN o_orderkey%2=0 THEN 'buy' ELSE 'sell' END AS direction FROM orders)""",
    "positions": f"""positions AS (SELECT 'P'||c_custkey AS id, c_custkey AS code, 20e0+c_custkey%50 AS price, (c_custkey%7)*400 AS vol,
  {r('20e0+c_custkey%50+c_acctbal/1e3')} AS latest_price, (c_custkey%7)*400 AS avail_vol, (c_custkey%7)*400 AS yesterday_vol FROM customer)""",
    "capitals": """capitals AS MATERIALIZED (SELECT 'r'||(o_custkey%25) AS run_id, CAST(o_orderdate AS DATE) AS dt,
  CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS market_value, 1e6+any_value(o_custkey%25)*1000 AS free_cash_amount,
  0e0 AS frozen_cash_amount FROM orders GROUP BY ALL)""",
    "trade_rows": """trade_rows AS MATERIALIZED (SELECT 'r'||(l_partkey%25) AS run_id, CAST(l_shipdate AS DATE) AS timestamp,
  CASE WHEN l_linenumber<=3 THEN 'OPEN' WHEN l_returnflag='R' THEN 'STOP_LOSS' WHEN l_returnflag='A' THEN 'TAKE_PROFIT' ELSE 'CLOSE' END AS action,
  CASE WHEN l_linenumber<=3 THEN 0e0 ELSE round_even((l_discount-l_tax)*1e2,0) END AS pct_chg FROM lineitem)""",
}
_NEEDS = {"adjusted": ["bars", "factors"], "minute": ["ticks"]}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views (and what they need) in front of the body.

    A body that starts with ``,`` continues the list of common table expressions.
    """
    wanted: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    head = "WITH " + ("RECURSIVE " if recursive else "")
    return head + ",\n".join(CTE[n] for n in wanted) + "\n" + body
