"""Writers and the update of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom import schemas
from tickloom.operators.series import CODE, DT

BUCKETS = 256


def save_listing(listing: DataFrame, path: str) -> None:
    listing.write.mode("overwrite").option("header", True).csv(path)


def export_listing_csv(listing: DataFrame, path: str) -> None:
    save_listing(listing, path)


def with_bucket(bars: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add the storage bucket of the code. One file per code would mean millions of tiny files."""
    return bars.withColumn("bucket", F.pmod(F.xxhash64(CODE), F.lit(buckets)).cast("int"))


def save_bars_by_code(bars: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write bars partitioned by bucket and year, sorted by code and day inside a file, so that code and date
    filters skip row groups. The rebalance splits a large (bucket, year) over many tasks and joins small ones."""
    spread = with_bucket(bars, buckets).withColumn("year", F.year(DT))
    (
        spread.hint("rebalance", "bucket", "year")
        .sortWithinPartitions("bucket", "year", CODE, DT)
        .write.mode(mode)
        .partitionBy("bucket", "year")
        .parquet(path)
    )


def append_dedup(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union without exact duplicates; partial deduplication runs before the shuffle."""
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def export_minute_bars(raw: DataFrame, key: str = "key") -> DataFrame:
    """``yyyymmddHHMM...`` key → date, time and month columns; prices and volume as FLOAT."""
    text = F.col(key)
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    volume = "volume" if "volume" in raw.columns else "vol"
    return raw.select(
        "code",
        iso.cast("date").alias("dt"),
        F.substring(text, 9, 4).alias("time"),
        *[F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close")],
        F.col(volume).cast("float").alias("vol"),
        F.substring(iso, 1, 7).alias("month"),
    )


def save_minute_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partition by month; the rebalance splits months, and market days within them, by size."""
    bars.hint("rebalance", "month").sortWithinPartitions("month", CODE, "dt", "time").write.mode(mode).partitionBy("month").parquet(path)


INT_STEPS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
FLOAT_MAX = 3.4028234663852886e38


def downcast_numeric(df: DataFrame) -> DataFrame:
    """Cast each numeric column to the narrowest integer or FLOAT type that holds its range.

    One job reads the ranges; its result is one row. Columns that are all NULL or not finite stay as they are.
    """
    kinds = dict(df.dtypes)
    ints = [c for c, t in kinds.items() if t in ("smallint", "int", "bigint")]
    floats = [c for c, t in kinds.items() if t == "double"]
    if not ints + floats:
        return df
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in ints + floats for n, f in (("lo", F.min), ("hi", F.max))]).first()
    casts = {}
    for c in ints + floats:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None:
            continue
        if c in ints:
            target = next((t for t, bound in INT_STEPS if -bound <= lo and hi < bound), "bigint")
        else:
            target = "float" if -FLOAT_MAX <= lo and hi <= FLOAT_MAX else "double"
        if target != kinds[c]:
            casts[c] = F.col(c).cast(target)
    return df.withColumns(casts)


def plan_incremental_update(bars: DataFrame, listing: DataFrame, last_trade_date, since, end, key: str = CODE, dt: str = DT) -> DataFrame:
    """(code, start_date, end_date): stored codes that end before the last trade day continue on the day after;
    listed codes without bars start at ``since``."""
    day = lambda d: F.lit(d).cast("date")
    latest = latest_bar(bars, key, dt)
    behind = latest.where(F.col("latest") < day(last_trade_date)).select(key, F.date_add("latest", 1).alias("start_date"))
    fresh = listing.select(key).distinct().join(latest.select(key), key, "left_anti").select(key, day(since).alias("start_date"))
    return behind.unionByName(fresh).withColumn("end_date", day(end))


def latest_bar(bars: DataFrame, key: str = CODE, dt: str = DT) -> DataFrame:
    return bars.groupBy(key).agg(F.max(dt).alias("latest"))


# -- trade and capital logs ------------------------------------------------------------------------------------------


def log_opening(table: DataFrame, records: DataFrame, on: str = "timestamp") -> DataFrame:
    """Table plus the records whose date it does not hold yet."""
    return table.unionByName(records.join(table.select(on).distinct(), on, "left_anti"), allowMissingColumns=True)


def log_closing(table: DataFrame, records: DataFrame, on: str = "timestamp", append: bool = False) -> DataFrame:
    """Replace the records of the same date (``append``: keep them too). Dates the table lacks are not added when
    replacing, as an update of absent rows changes nothing."""
    if append:
        return table.unionByName(records, allowMissingColumns=True)
    known = records.join(table.select(on).distinct(), on, "left_semi")
    return table.join(known.select(on).distinct(), on, "left_anti").unionByName(known, allowMissingColumns=True)


def upsert_runs(log: DataFrame, batch: DataFrame, on: str = "id") -> DataFrame:
    """Rows of the batch replace rows of the same id."""
    return log.join(batch.select(on).distinct(), on, "left_anti").unionByName(batch, allowMissingColumns=True)


def append_trades(trades: DataFrame, path: str) -> None:
    trades.write.mode("append").parquet(path)


def append_capitals(capitals: DataFrame, path: str) -> None:
    capitals.write.mode("append").parquet(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRADE_LOG).parquet(path)


def read_capitals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CAPITAL_LOG).parquet(path)


def get_opening(capitals: DataFrame, day) -> DataFrame:
    """The capital record of the day (the first one, should there be several)."""
    return capitals.where(F.col("timestamp") == F.lit(day).cast("date")).limit(1)
