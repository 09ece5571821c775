"""Exact linear percentiles of groups that need not fit in one task.

Values are counted first, so copies of one value travel as one row. A small sketch per group gives split points;
each (group, split) is ranked on its own, offset by the totals of the splits below it, and only the values at
the wanted ranks are kept. The sketch decides where the work goes, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SPLITS = 32


def _ranked(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(distinct values with their split and running count inside it, totals per split)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    steps = [i / SPLITS for i in range(1, SPLITS)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", steps, 1_000).alias("_cuts"))
    split = counts.join(cuts, by).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = split.groupBy(*by, "_s").agg(F.sum("_c").alias("_t"))
    order = Window.partitionBy(*by).orderBy("_s")
    bases = totals.select(
        *by,
        "_s",
        "_t",
        F.coalesce(F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_t").over(Window.partitionBy(*by)).alias("n"),
    )
    inside = Window.partitionBy(*by, "_s").orderBy("_v")
    local = split.withColumn("_local", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return local, bases


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: Sequence[float], out: str = "percentiles") -> DataFrame:
    """(by..., n, out): linear-interpolated percentiles of the non-NULL values, one array per group."""
    local, bases = _ranked(df, by, value)
    # ranks wanted from each split: the two neighbours of every percentile that fall into it
    levels = F.array(*[F.lit(float(p)) for p in probs])
    last = F.col("n") - 1
    lower = F.transform(levels, lambda p: F.floor(last * p))
    upper = F.transform(levels, lambda p: F.least(F.floor(last * p) + 1, last))
    wanted = F.filter(
        F.array_distinct(F.concat(lower, upper)), lambda k: (k >= F.col("_base")) & (k < F.col("_base") + F.col("_t"))
    )
    bases = bases.withColumn("_wanted", wanted).drop("_t")
    ranked = local.join(bases, [*by, "_s"])
    upto = F.col("_base") + F.col("_local")
    covered = F.filter("_wanted", lambda k: (k >= upto - F.col("_c")) & (k < upto))
    hits = ranked.select(*by, "n", F.col("_v").cast("double").alias("_v"), F.explode(covered).alias("_k"))

    # at most two ranks per percentile and group
    found = hits.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))

    def interpolated(p):
        exact = last * p
        low = F.element_at("_at", F.floor(exact))
        high = F.element_at("_at", F.least(F.floor(exact) + 1, last))
        return _interpolated(low, high, exact - F.floor(exact))

    return found.select(*by, "n", F.transform(levels, interpolated).alias(out))


def _interpolated(low: Column, high: Column, part: Column) -> Column:
    """``low * (1 - part) + high * part``, the first product unrounded (a fused multiply-add), as the SQL form
    computes it: a percentile that all but meets a value lies below it or not by the last bit."""
    rest, added = F.lit(1.0) - part, high * part
    product = low * rest
    (a, b), (c, d) = _halves(low), _halves(rest)
    lost = b * d - (((product - a * c) - b * c) - a * d)
    total = product + added
    grown = total - product
    dropped = (product - (total - grown)) + (added - grown)
    # the halves of huge values overflow
    return F.nanvl(total + (dropped + lost), total)


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of 26 bits, whose products are exact."""
    wide = x * F.lit(float(2**27 + 1))
    upper = wide - (wide - x)
    return upper, x - upper


def percentiles_below(df: DataFrame, ranked: DataFrame, by: list[str], value: str, steps: int = 100, out: str = "below") -> DataFrame:
    """Add ``out`` to ``df``: how many of the ``steps`` evenly spaced percentiles (0, 1/steps, ...) of the group in
    ``ranked`` lie strictly below the row's value. NULL for a NULL value and for groups that are not in ``ranked``.

    A group's percentiles travel as one array, sorted, since rounding can turn neighbours around; rows bisect it.
    """
    levels = exact_percentiles(ranked, by, value, [i / steps for i in range(steps)], "_levels")
    levels = levels.select(*by, F.sort_array("_levels").alias("_levels"))
    start = F.struct(F.lit(0).alias("low"), F.lit(steps).alias("high"))

    def bisect(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        done = at["low"] >= at["high"]
        under = F.coalesce(F.try_element_at("_levels", middle + 1) < F.col(value), F.lit(False))
        low = F.when(~done & under, middle + 1).otherwise(at["low"])
        high = F.when(~done & ~under, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps.bit_length())), start, bisect, lambda at: at["low"])
    known = F.col(value).isNotNull() & F.col("_levels").isNotNull()
    return df.join(levels, by, "left").withColumn(out, F.when(known, found)).drop("_levels")
