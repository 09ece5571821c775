"""Typed readers. Filters and projections are left to the scan: partition pruning first, then Parquet pushdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tickloom import schemas
from tickloom.functions import codes as C
from tickloom.operators.filters import relabel, since as since_filter, until as until_filter
from tickloom.operators.joins import listed_only

BAR_FIELDS = ["dt", "code", "company", "market", "open", "high", "low", "close", "turnover", "vol", "chg", "pct_chg", "mkt_cap", "mkt_cap_rank"]


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV with header, by the path's ending unless ``fmt`` is given."""
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith("." + f)), "parquet")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd").option("enforceSchema", False)
    return reader.format(fmt).load(path)


def load_daily_bars(
    spark: SparkSession,
    path: str,
    codes: Iterable[str] | None = None,
    markets: Iterable[str] | None = None,
    since=None,
    until=None,
    fields: Iterable[str] | str = BAR_FIELDS,
    listing: DataFrame | None = None,
    schema: StructType = schemas.DAILY_BAR,
) -> DataFrame:
    """Daily bars of the given codes and markets within the inclusive range; ``fields="all"`` keeps every column."""
    bars = select_bars(read_table(spark, path, schema), codes, markets, since, until, listing)
    return bars if fields == "all" else bars.select(*fields)


def select_bars(bars: DataFrame, codes=None, markets=None, since=None, until=None, listing=None) -> DataFrame:
    """Filter as stored (so that it reaches the scan), then rename the legacy market label."""
    if codes is not None:
        bars = bars.where(F.col("code").isin(list(codes)))
    if markets is not None:
        bars = bars.where(F.col("market").isin(list(markets)))
    if since is not None:
        bars = since_filter(bars, since)
    if until is not None:
        bars = until_filter(bars, until)
    if "market" in bars.columns:
        bars = relabel(bars, "market", C.LEGACY_MARKETS)
    return bars if listing is None else listed_only(bars, listing)


def load_bars(spark: SparkSession, path: str, code_from_filename: bool = True, schema: StructType | None = None) -> DataFrame:
    """One CSV file per instrument; the code is the file's stem."""
    schema = schema or StructType([f for f in schemas.INDEX_BAR if not (code_from_filename and f.name == "code")])
    bars = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if code_from_filename:
        bars = bars.withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return bars


def load_index_bars(spark: SparkSession, path: str) -> DataFrame:
    return load_bars(spark, path)


def load_futures_bars(spark: SparkSession, path: str) -> DataFrame:
    return load_bars(spark, path, schema=StructType([f for f in schemas.FUTURES_BAR if f.name != "code"]))


def load_listing(spark: SparkSession, path: str, schema: StructType = schemas.LISTING) -> DataFrame:
    return read_table(spark, path, schema)


def load_adjust_factors(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.ADJUST_FACTOR)


def load_restricted_releases(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.RELEASE)


def load_name_changes(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.NAME_CHANGE)


def load_blacklist(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.BLACKLIST)


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CALENDAR)


def load_minute_bars(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """Minute bars partitioned by month; only the months asked for are listed and read."""
    bars = spark.read.schema(schemas.MINUTE_BAR).parquet(path)
    return bars if months is None else bars.where(F.col("month").isin(list(months)))


def distinct_codes(df: DataFrame) -> DataFrame:
    return df.select("code").distinct()


def distinct_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct()


def closest_name(listing: DataFrame, text: str, name: str = "name") -> DataFrame:
    """The listed instrument whose name is nearest to the text, by edit distance over the longer length."""
    longest = F.greatest(F.length(name), F.lit(len(text)))
    score = F.lit(1.0) - F.try_divide(F.levenshtein(F.col(name), F.lit(text)).cast("double"), longest)
    return listing.withColumn("score", score).orderBy(F.desc("score"), name).limit(1)
