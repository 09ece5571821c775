"""Per-code series without per-code tasks.

A code may hold a large share of all rows, so no stage here ever gathers a whole code in one task:

* rows are numbered in two levels: counts per (code, calendar bucket) are added up over the few buckets of a
  code, and rows are numbered inside their bucket only;
* windows run on (code, segment), where a segment is ``SEGMENT_ROWS`` consecutive bars plus the *halo* of
  earlier bars its first rows look back on. Halo rows are dropped afterwards.

Every operator states its look-back in bars. Recursive averages have an unlimited one, but the weight of a bar
falls by a constant factor per step, so bars older than ``DECAY * tau`` change nothing in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CODE, DT, POS = "code", "dt", "pos"
SEGMENT_ROWS = 16_384
#: exp(-DECAY) is below half a unit in the last place of a double.
DECAY = 37.0
#: Largest exponent of the scaled sums, kept under the 709 at which a double overflows.
MAX_EXPONENT = 660.0
#: Block lengths for the scaled sums; their ranges of tau overlap, see ``block_for``.
BLOCKS = (64, 1_024, SEGMENT_ROWS)

_BUCKETS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": lambda c: F.year(c) * 12 + F.month(c),
    "day": lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")),
}


def bucket_of(order: Column | str, unit: str) -> Column:
    """Calendar bucket number; it grows with ``order`` and holds a bounded number of bars of one code."""
    return _BUCKETS[unit](F.col(order) if isinstance(order, str) else order)


def with_positions(
    df: DataFrame, key: str = CODE, order: str | list[str] = DT, unit: str = "year", name: str = POS
) -> DataFrame:
    """Add the 0-based bar number per code. A table stored with the column is used as it is.

    ``order`` may be several columns (day, time); the first one sets the bucket.
    """
    if name in df.columns:
        return df
    order = [order] if isinstance(order, str) else list(order)
    rows = df.withColumn("_bucket", bucket_of(order[0], unit))
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        rows.join(offsets, [key, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def tau(alpha: float) -> float:
    """Bars after which the weight of a value has fallen by the factor e."""
    return math.inf if alpha <= 0 else 1.0 / -math.log1p(-alpha) if alpha < 1 else 0.0


def decay_lookback(alpha: float) -> int:
    return math.ceil(DECAY * tau(alpha)) + 1


def block_for(alpha: float) -> int:
    """Shortest block that outlives the memory of the recursion and does not overflow its scaled sum."""
    t = tau(alpha)
    for size in BLOCKS:
        if DECAY * t <= size <= MAX_EXPONENT * t or t == 0:
            return size
    raise ValueError(f"smoothing factor {alpha} is outside the supported range (EMA periods up to about 880)")


@dataclass
class Layout:
    """Window specs over (code, segment) that all share one shuffle and one sort."""

    key: str = CODE
    blocks: tuple[int, ...] = ()
    _names: dict[int, str] = field(init=False, repr=False)

    def __post_init__(self):
        self.blocks = tuple(sorted(set(self.blocks), reverse=True))
        self._names = {size: f"_block{size}" for size in self.blocks}

    @property
    def pos(self) -> Column:
        return F.col(POS)

    @property
    def partition(self) -> list[str]:
        return [self.key, "_segment"]

    def over(self, start: int | None = None, end: int = 0) -> WindowSpec:
        """Rows ``start``..``end`` relative to the current bar; the ordered window itself without a frame."""
        spec = Window.partitionBy(*self.partition).orderBy(*self._names.values(), POS)
        return spec if start is None else spec.rowsBetween(start, end)

    def tail(self, n: int) -> WindowSpec:
        return self.over(-(n - 1), 0)

    def block(self, size: int) -> WindowSpec:
        names = list(self._names.values())
        cut = names.index(self._names[size]) + 1
        spec = Window.partitionBy(*self.partition, *names[:cut]).orderBy(*names[cut:], POS)
        return spec.rowsBetween(Window.unboundedPreceding, 0)

    def ready(self, n: int, value: Column) -> Column:
        """NULL until ``n`` bars exist."""
        return F.when(F.col(POS) >= n - 1, value)

    def ref(self, c: Column | str, k: int) -> Column:
        return F.lag(c, k).over(self.over())

    def spread(self, df: DataFrame, lookback: int) -> DataFrame:
        segment = F.floor(F.col(POS) / SEGMENT_ROWS)
        if lookback > 0:
            reach = F.floor((F.col(POS) + lookback) / SEGMENT_ROWS)
            df = df.withColumn("_segment", F.explode(F.sequence(segment, reach)))
        else:
            df = df.withColumn("_segment", segment)
        return df.withColumns({name: F.floor(F.col(POS) / size) for size, name in self._names.items()})

    def gather(self, df: DataFrame, lookback: int) -> DataFrame:
        if lookback > 0:
            df = df.where(F.col("_segment") == F.floor(F.col(POS) / SEGMENT_ROWS))
        return df.drop("_segment", *self._names.values())


def in_segments(
    df: DataFrame,
    lookback: int,
    stages: Callable[[Layout], Iterable[dict[str, Column]]],
    *,
    blocks: Iterable[int] = (),
    key: str = CODE,
    order: str = DT,
    unit: str = "year",
    keep_pos: bool = False,
) -> DataFrame:
    """Add columns in ``stages``; each stage may use the ones before it and look ``lookback`` bars back in all.

    Columns whose name starts with an underscore are working columns and are dropped.
    """
    had_pos = POS in df.columns
    layout = Layout(key, tuple(blocks))
    out = layout.spread(with_positions(df, key, order, unit), lookback)
    working: list[str] = []
    for stage in stages(layout):
        out = out.withColumns(stage)
        working += [c for c in stage if c.startswith("_")]
    out = layout.gather(out, lookback).drop(*working)
    return out if had_pos or keep_pos else out.drop(POS)


# -- recursions ----------------------------------------------------------------------------------------------------


def recursion(layout: Layout, x: Column, alpha: float, seed_pos: int, seed: Column, name: str) -> list[dict[str, Column]]:
    """Stages for ``y[t] = (1 - alpha) * y[t-1] + alpha * x[t]`` starting with ``seed`` at ``seed_pos``.

    Inside a block this is a scaled running sum, ``d^k * sum(z[i] * d^-i)``. The block before it contributes
    its last value times ``d^(k+1)``; older blocks have decayed below double precision.
    """
    if alpha >= 1:
        return [{name: F.when(F.col(POS) >= seed_pos, x)}]
    size = block_for(alpha)
    decay = 1.0 - alpha
    local, pos = f"_{name}_local", F.col(POS)
    step = (pos % size).cast("double")
    z = F.when(pos == seed_pos, seed).when(pos > seed_pos, F.lit(alpha) * x).otherwise(F.lit(0.0))
    scaled = z * F.pow(F.lit(1.0 / decay), step)
    carried = F.last(F.when(pos % size == size - 1, F.col(local)), ignorenulls=True).over(
        layout.over(Window.unboundedPreceding, -1)
    )
    value = F.col(local) + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(decay), step + 1)
    return [
        {f"_{name}_scaled": scaled},
        {local: F.sum(f"_{name}_scaled").over(layout.block(size)) * F.pow(F.lit(decay), step)},
        {name: F.when(pos >= seed_pos, value)},
    ]


def seeded_recursion(layout: Layout, x: Column, n: int, alpha: float, first: int, name: str) -> list[dict[str, Column]]:
    """Recursion over ``x`` (known from bar ``first`` on), seeded by the mean of its first ``n`` values."""
    seed = f"_{name}_seed"
    mean = F.avg(x).over(layout.tail(n))
    return [{seed: F.when(F.col(POS) == first + n - 1, mean)}] + recursion(layout, x, alpha, first + n - 1, F.col(seed), name)


# -- carries between calendar buckets ------------------------------------------------------------------------------


def fill(df: DataFrame, c: str, direction: str = "ffill", key: str = CODE, order: str = DT, unit: str = "year") -> DataFrame:
    """Fill NULLs of ``c`` per code: ``ffill``, ``bfill``, ``both`` (bfill, then ffill) or ``pad`` (= ffill).

    Nearest values are found inside (code, bucket); a run of NULLs that leaves the bucket takes the value
    carried over from the neighbouring buckets.
    """
    if direction not in ("ffill", "bfill", "both", "pad"):
        raise ValueError(f"unknown direction {direction!r}")
    rows = df.withColumn("_bucket", bucket_of(order, unit))
    known = F.col(c).isNotNull()
    ends = rows.groupBy(key, "_bucket").agg(
        F.max_by(F.when(known, F.col(c)), F.when(known, F.col(order))).alias("_last"),
        F.min_by(F.when(known, F.col(c)), F.when(known, F.col(order))).alias("_first"),
    )
    buckets = Window.partitionBy(key).orderBy("_bucket")
    carries = ends.select(
        key,
        "_bucket",
        F.last("_last", ignorenulls=True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(buckets.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    previous = F.coalesce(F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    following = F.coalesce(F.first(c, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    value = {"bfill": following, "both": F.coalesce(following, previous)}.get(direction, previous)
    return rows.join(carries, [key, "_bucket"]).withColumn(c, value).drop("_bucket", "_before", "_after")


def running(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    key: str = CODE,
    order: str | list[str] = DT,
    unit: str = "year",
) -> DataFrame:
    """Running ``sum`` or ``max`` per code: ``{out: ("sum", column)}``, in the same two levels as the row numbers."""
    order = [order] if isinstance(order, str) else list(order)
    rows = df.withColumn("_bucket", bucket_of(order[0], unit))
    agg = {"sum": F.sum, "max": F.max}
    totals = rows.groupBy(key, "_bucket").agg(*[agg[how](x).alias(f"_{out}_total") for out, (how, x) in values.items()])
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        key, "_bucket", *[agg[how](f"_{out}_total").over(before).alias(f"_{out}_carry") for out, (how, _) in values.items()]
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for out, (how, x) in values.items():
        local, carry = agg[how](x).over(inside), F.col(f"_{out}_carry")
        added[out] = local + F.coalesce(carry, F.lit(0)) if how == "sum" else F.greatest(local, carry)
    joined = rows.join(carries, [key, "_bucket"]).withColumns(added)
    return joined.drop("_bucket", *[f"_{out}_carry" for out in values])


def drawdown(df: DataFrame, c: str, key: str = CODE, order: str = DT, out: str = "drawdown", unit: str = "year") -> DataFrame:
    """Value over its running maximum, minus one."""
    peaks = running(df, {"_peak": ("max", F.col(c))}, key, order, unit)
    return peaks.withColumn(out, F.col(c) / F.col("_peak") - F.lit(1.0)).drop("_peak")


def ref(df: DataFrame, c: str, k: int, out: str | None = None, **series) -> DataFrame:
    """Value ``k`` bars ago."""
    return in_segments(df, k, lambda s: [{out or f"{c}_ref{k}": s.ref(c, k)}], **series)


def running_index(df: DataFrame, key: str = CODE, order: str = DT, out: str = "index", unit: str = "year") -> DataFrame:
    return with_positions(df, key, order, unit, name=out)


def tail(df: DataFrame, n: int, key: str = CODE, order: str = DT) -> DataFrame:
    """Last ``n`` rows per code. The group limit runs before the shuffle, so a task keeps ``n`` rows per code."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def head(df: DataFrame, n: int = 1, key: str = CODE, order: str = DT) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
