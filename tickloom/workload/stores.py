"""Sources and sinks: tables are written to the shared folder in the stored or vendor form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tickloom import schemas
from tickloom.functions import codes as C
from tickloom.operators.series import CODE, DT
from tickloom.sources import normalize as N, readers as R, writers as W
from tickloom.streaming.sinks import new_dir
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, with_views


def text_code():
    return F.col(CODE).cast("string").alias(CODE)


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """The table in a stored schema; columns it lacks are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def written(v: Views, df: DataFrame, name: str) -> str:
    path = new_dir(v.spark, name)
    df.write.parquet(path)
    return path


# -- stored tables --------------------------------------------------------------------------------------------------

MARKETS = [C.SH_MAIN, "中小板", C.STAR]


def _marked(v: Views) -> DataFrame:
    market = F.element_at(F.array(*[F.lit(m) for m in MARKETS]), (F.col(CODE) % 3 + 1).cast("int"))
    return v.bars.withColumn("market", market)


@query(
    "load_daily_bars",
    with_views("bars", body=f"""SELECT CAST(code AS VARCHAR) AS code, dt, CASE code%3 WHEN 0 THEN '{C.SH_MAIN}' ELSE '{C.SZ_MAIN}' END AS market, close FROM bars
WHERE code%3<2 AND dt BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"""),
)
def _daily(v: Views) -> DataFrame:
    path = written(v, shaped(_marked(v), schemas.DAILY_BAR), "daily")
    return R.load_daily_bars(v.spark, path, markets=MARKETS[:2], since="1994-01-01", until="1996-12-31", fields=[CODE, DT, "market", "close"])


@query("save_bars_by_code", with_views("bars", body="SELECT code, dt, CAST(year(dt) AS INTEGER) AS year, open, high, low, close, vol FROM bars"))
def _by_code(v: Views) -> DataFrame:
    path = new_dir(v.spark, "by-code")
    W.save_bars_by_code(v.bars, path, buckets=8)
    schema = StructType.fromDDL("code bigint, dt date, open double, high double, low double, close double, vol double, bucket int, year int")
    return R.read_table(v.spark, path, schema).drop("bucket")


@query("load_bars", with_views("listing", "bars", body="SELECT sector AS code, dt, sum(vol) AS vol FROM bars JOIN listing USING (code) GROUP BY ALL"))
def _index_files(v: Views) -> DataFrame:
    """One CSV file per sector, named by it: sums of the volume per day."""
    daily = v.bars.join(v.listing, CODE).groupBy("sector", DT).agg(F.sum("vol").alias("vol"))
    schema = StructType([f for f in schemas.INDEX_BAR if f.name != CODE])
    path = new_dir(v.spark, "index")
    files = shaped(daily, StructType([*schema, *StructType.fromDDL("sector string")]))
    files.write.partitionBy("sector").option("header", True).csv(path)
    loaded = R.load_bars(v.spark, path, code_from_filename=False, schema=StructType([*schema, *StructType.fromDDL("sector string")]))
    return loaded.select(F.col("sector").alias(CODE), DT, "vol")


def _listing(v: Views) -> DataFrame:
    return shaped(v.listing, schemas.LISTING)


@query("listing_csv", with_views("listing", body="SELECT CAST(code AS VARCHAR) AS code, name, sector, total_share FROM listing"))
def _listing_csv(v: Views) -> DataFrame:
    path = new_dir(v.spark, "listing") + ".csv"
    W.export_listing_csv(_listing(v), path)
    return R.load_listing(v.spark, path).select(CODE, "name", "sector", "total_share")


@query("load_adjust_factors", with_views("factors", body="SELECT CAST(code AS VARCHAR) AS code, valid_from, factor FROM factors"))
def _load_factors(v: Views) -> DataFrame:
    return R.load_adjust_factors(v.spark, written(v, shaped(v.factors, schemas.ADJUST_FACTOR), "factors"))


@query("load_restricted_releases", with_views("releases", body="SELECT CAST(code AS VARCHAR) AS code, dt, category, pct_shares FROM releases"))
def _load_releases(v: Views) -> DataFrame:
    return R.load_restricted_releases(v.spark, written(v, shaped(v.releases, schemas.RELEASE), "releases")).select(CODE, DT, "category", "pct_shares")


@query("load_name_changes", "SELECT CAST(s_suppkey AS VARCHAR) AS code, DATE '1995-01-01' AS dt, s_name AS company FROM supplier")
def _load_names(v: Views) -> DataFrame:
    names = v.listing.select(CODE, F.lit("1995-01-01").alias(DT), F.col("name").alias("company"))
    return R.load_name_changes(v.spark, written(v, shaped(names, schemas.NAME_CHANGE), "names"))


# -- minute bars ------------------------------------------------------------------------------------------------------


def _raw_minutes(v: Views) -> DataFrame:
    key = F.concat(F.date_format(DT, "yyyyMMdd"), "time", F.lit("00000"))
    return v.minute.select(text_code(), key.alias("key"), "open", "high", "low", "close", F.col("vol").alias("volume"))


MINUTES = "CAST(code AS VARCHAR) AS code, dt, time, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ("open", "high", "low", "close", "vol")) + ", strftime(dt,'%Y-%m') AS month"


@query("export_minute_bars", with_views("minute", body=f"SELECT {MINUTES} FROM minute"))
def _export_minutes(v: Views) -> DataFrame:
    return W.export_minute_bars(_raw_minutes(v))


@query("load_minute_bars", with_views("minute", body=f"SELECT {MINUTES} FROM minute WHERE strftime(dt,'%Y-%m')='2024-01'"))
def _load_minutes(v: Views) -> DataFrame:
    path = new_dir(v.spark, "minutes")
    W.save_minute_bars(W.export_minute_bars(_raw_minutes(v)), path)
    return R.load_minute_bars(v.spark, path, ["2024-01"])


# -- vendor tables ----------------------------------------------------------------------------------------------------


def vendor(df: DataFrame, kind: str, *keep: str) -> DataFrame:
    """The table under the vendor's column names."""
    return df.select(*[F.col(ours).alias(theirs) for theirs, ours in N.KINDS[kind].items()], *keep)


@query("normalize_daily_hist", with_views("adjusted", body="SELECT code, dt, open, close, high, low, vol, pct_chg, chg, vol/1e3 AS turnover FROM adjusted"))
def _normalize(v: Views) -> DataFrame:
    bars = v.adjusted.withColumns({"turnover": F.col("vol") / 1e3, DT: F.date_format(DT, "yyyy-MM-dd")})
    return N.normalize(vendor(bars, "daily_hist", CODE), "daily_hist", keep=(CODE,))


@query("normalize_minute_bars", with_views("ticks", body="SELECT strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts, code, price AS open, price AS close, price AS high, price AS low, 1e0 AS vol FROM ticks"))
def _normalize_minutes(v: Views) -> DataFrame:
    ticks = v.ticks.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), CODE, *[F.col("price").alias(c) for c in ("open", "close", "high", "low")], F.lit(1.0).alias("vol"))
    return N.normalize(vendor(ticks, "minute_bars", CODE), "minute_bars", keep=(CODE,))


@query("kv_to_row", with_views("listing", body="SELECT CAST(code AS VARCHAR) AS src, name AS company, sector, total_share*1e-8 AS total_share FROM listing"))
def _profile(v: Views) -> DataFrame:
    items = {"股票简称": F.col("name"), "行业": F.col("sector"), "总股本": F.col("total_share").cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), x.alias("value")) for k, x in items.items()])).alias("p")
    long = v.listing.select(F.col(CODE).cast("string").alias("src"), pairs).select("src", "p.item", "p.value")
    return N.kv_to_row(long).select("src", "company", "sector", "total_share")


@query(
    "ask_bid_ladder",
    with_views("bars", body=f""", lb AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC)=1)
SELECT code, [close,close-1e0,NULL,NULL,NULL] AS buy, [close+1e0,NULL,NULL,NULL,NULL] AS sell, [{r('CAST(vol*1e2 AS BIGINT)*1e-2')},NULL,NULL,NULL,NULL] AS buy_vol, [CAST(NULL AS DOUBLE),NULL,NULL,NULL,NULL] AS sell_vol FROM lb"""),
)
def _ladder(v: Views) -> DataFrame:
    last = v.bars.groupBy(CODE).agg(F.max_by("close", DT).alias("close"), F.max_by("vol", DT).alias("vol"))
    items = {"buy_1": F.col("close"), "buy_2": F.col("close") - 1.0, "sell_1": F.col("close") + 1.0, "buy_1_vol": F.col("vol") * 100.0}
    pairs = [F.struct(F.lit(k).alias("item"), x.cast("string").alias("value")) for k, x in items.items()]
    odd = F.struct(F.lit("sell_1_vol").alias("item"), F.lit("-").alias("value"))
    rows = last.select(CODE, F.explode(F.array(*pairs, odd)).alias("p")).select(CODE, "p.item", "p.value")
    return N.ask_bid_ladder(rows)


@query(
    "normalize_releases",
    with_views("releases", body=f"""SELECT CAST(code AS VARCHAR) AS code, dt, category, {r('pct_shares/3*1e2', 3)} AS pct_shares,
  row_number() OVER (PARTITION BY code ORDER BY dt) - 1 AS index FROM releases"""),
)
def _releases(v: Views) -> DataFrame:
    full = v.releases.select(
        text_code(), F.lit("x").alias("company"), F.date_format(DT, "yyyy-MM-dd").alias(DT), "category", (F.col("pct_shares") / 3).alias("pct_shares"),
        *[F.lit(1.0).alias(c) for c in ("num_shares", "num_shares_released", "mkcap_released")],
    )
    raw = full.withColumnsRenamed({ours: theirs for theirs, ours in N.RELEASE_COLUMNS.items()})
    return N.normalize_releases(raw).select(CODE, DT, "category", "pct_shares", "index")


@query(
    "normalize_name_history",
    """SELECT s_suppkey AS code, make_date(y,3,1) AS dt, s_name||CASE WHEN s_suppkey%4=0 AND y>1996 THEN ' new' ELSE '' END AS company
FROM supplier, (SELECT CAST(unnest([1995,1996,1997]) AS INTEGER) AS y) WHERE s_suppkey%4=0 OR y=1997""",
)
def _names(v: Views) -> DataFrame:
    rows = v.listing.select(CODE, "name", F.explode(F.array(*[F.lit(y) for y in (1995, 1996, 1997)])).alias("y"))
    renamed = F.when((F.col(CODE) % 4 == 0) & (F.col("y") > 1996), F.concat("name", F.lit(" new"))).otherwise(F.col("name"))
    return N.normalize_name_history(rows.select(CODE, renamed.alias("name"), F.concat("y", F.lit("0301")).alias("start_date")))


@query("downcast_numeric", "SELECT s_suppkey, CAST(s_suppkey*100000 AS BIGINT) AS wide, CAST(s_acctbal AS FLOAT) AS s_acctbal, TRUE AS narrowed FROM supplier")
def _downcast(v: Views) -> DataFrame:
    rows = v.table("supplier").select("s_suppkey", (F.col("s_suppkey") * 100_000).alias("wide"), "s_acctbal")
    small = W.downcast_numeric(rows)
    kinds = dict(small.dtypes)
    return small.select(F.col("s_suppkey").cast("bigint"), F.col("wide").cast("bigint"), "s_acctbal", F.lit(kinds["s_suppkey"] != "bigint" and kinds["s_acctbal"] == "float").alias("narrowed"))


# -- trade and capital logs ---------------------------------------------------------------------------------------------


def _capital_log(v: Views, run: str) -> DataFrame:
    return shaped(v.capitals.where(F.col("run_id") == run).withColumnRenamed("dt", "timestamp"), schemas.CAPITAL_LOG)


LOGS = ", a AS (SELECT dt AS timestamp, market_value, free_cash_amount, frozen_cash_amount FROM capitals WHERE run_id='r1'), b AS (SELECT dt AS timestamp, market_value, free_cash_amount, frozen_cash_amount FROM capitals WHERE run_id='r2')"


def _stored_logs(v: Views) -> tuple[DataFrame, DataFrame]:
    path = new_dir(v.spark, "capitals")
    W.append_capitals(_capital_log(v, "r1"), path)
    return W.read_capitals(v.spark, path), _capital_log(v, "r2")


@query("log_opening", with_views("capitals", body=LOGS + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE timestamp NOT IN (SELECT timestamp FROM a)"))
def _log_opening(v: Views) -> DataFrame:
    return W.log_opening(*_stored_logs(v))


@query("log_closing", with_views("capitals", body=LOGS + "SELECT * FROM a WHERE timestamp NOT IN (SELECT timestamp FROM b) UNION ALL SELECT * FROM b WHERE timestamp IN (SELECT timestamp FROM a)"))
def _log_closing(v: Views) -> DataFrame:
    return W.log_closing(*_stored_logs(v))


@query("get_opening", with_views("capitals", body=LOGS + "SELECT a.* FROM a WHERE timestamp=(SELECT max(timestamp) FROM a WHERE timestamp<=DATE '1996-06-01')"))
def _get_opening(v: Views) -> DataFrame:
    log, _ = _stored_logs(v)
    day = log.where(F.col("timestamp") <= F.lit("1996-06-01").cast("date")).agg(F.max("timestamp")).first()[0]
    return W.get_opening(log, day)


@query("append_trades", with_views("trade_rows", body="SELECT timestamp, action, run_id AS id, pct_chg FROM trade_rows UNION ALL SELECT timestamp, action, run_id, pct_chg FROM trade_rows WHERE action='CLOSE'"))
def _append_trades(v: Views) -> DataFrame:
    rows, path = shaped(v.trade_rows.withColumnRenamed("run_id", "id"), schemas.TRADE_LOG), new_dir(v.spark, "trades")
    W.append_trades(rows, path)
    W.append_trades(rows.where(F.col("action") == C.CLOSE), path)
    return W.read_trades(v.spark, path).select("timestamp", "action", "id", "pct_chg")


@query("upsert_runs", with_views("listing", body="SELECT code, CASE WHEN code%3=0 THEN name||'*' ELSE name END AS name FROM listing"))
def _upsert(v: Views) -> DataFrame:
    rows = v.listing.select(CODE, "name")
    batch = rows.where(F.col(CODE) % 3 == 0).withColumn("name", F.concat("name", F.lit("*")))
    return W.upsert_runs(rows, batch, on=CODE)
