"""Unions, differences, duplicates, order and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalar import uniform
from tickloom.operators.series import CODE, DT


def concat_bars(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def codes_except(a: DataFrame, b: DataFrame, key: str = CODE) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def codes_union(a: DataFrame, b: DataFrame, key: str = CODE) -> DataFrame:
    return a.select(key).unionByName(b.select(key)).distinct()


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def duplicate_names(df: DataFrame, key: str = CODE, name: str = "company") -> DataFrame:
    """Distinct names per code. Pairs are deduplicated first, so a code's copies do not travel."""
    return df.select(key, name).distinct().groupBy(key).agg(F.count(name).alias("n_names"))


def order_bars(df: DataFrame, by_date_first: bool = False, key: str = CODE, dt: str = DT) -> DataFrame:
    """Total order by range partitioning; for output only, windows sort by themselves."""
    return df.orderBy(*([dt, key] if by_date_first else [key, dt]))


def sample_runs(curves: DataFrame, n: int, seed: int = 0, run: str = "run_id") -> DataFrame:
    """All rows of ``n`` runs drawn by a repeatable hash of the run id."""
    picked = curves.select(run).distinct().orderBy(uniform(run, seed=seed), run).limit(n)
    return curves.join(picked, run, "left_semi")


def smallest_mkt_cap_first(df: DataFrame) -> DataFrame:
    return df.orderBy("mkt_cap")


def latest_record(df: DataFrame, key: str = CODE, dt: str = DT) -> DataFrame:
    """The whole last row per code."""
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*others), dt).alias("_r"))
    return last.select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)
