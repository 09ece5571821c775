"""Performance of runs, from capital logs (run, dt, market_value, free_cash_amount, frozen_cash_amount) and
trade logs (run, action, pct_chg).

Definitions: profit factor is the sum of gains over the absolute sum of losses; Sharpe is mean over sample
deviation of daily returns times sqrt(252); drawdown is the lowest value over the running maximum, minus one.
Capital logs hold one row per run and day, so a run is bounded by the calendar; trade logs are only ever
aggregated, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes
from tickloom.functions.scalar import rounded
from tickloom.operators.quantiles import exact_percentiles
from tickloom.operators.series import DT, drawdown, in_segments

PERIODS = 252
RUN = "run_id"
CORE_METRICS = ["total_returns", "win_rate", "max_drawdown", "number_of_trades", "sharpe_ratio"]
DESCRIBED = [
    "total_returns",
    "max_drawdown",
    "sharpe_ratio",
    "win_rate",
    "number_of_trades",
    "number_of_take_profit",
    "number_of_stop_loss",
]


def capital_of() -> Column:
    return F.col("market_value") + F.col("free_cash_amount") + F.col("frozen_cash_amount")


def capital_returns(capitals: DataFrame, by: str = RUN, dt: str = DT) -> DataFrame:
    """Add ``capital`` and its daily change ``pct_chg`` (a fraction, 0 on the first day)."""
    total = capitals.withColumn("capital", capital_of())

    def stages(s):
        return [
            {"_before": s.ref("capital", 1)},
            {"pct_chg": F.coalesce(F.try_divide(F.col("capital"), F.col("_before")) - F.lit(1.0), F.lit(0.0))},
        ]

    return in_segments(total, 1, stages, key=by, order=dt)


def total_returns(capital: str = "capital", dt: str = DT) -> Column:
    return rounded(F.try_divide(F.lit(100.0) * F.max_by(capital, dt), F.min_by(capital, dt)))


def max_drawdown(dd: str = "drawdown") -> Column:
    return rounded(F.lit(100.0) * F.min(dd))


def sharpe(returns: str = "pct_chg", periods: int = PERIODS) -> Column:
    return rounded(F.try_divide(F.avg(returns), F.stddev_samp(returns)) * F.sqrt(F.lit(float(periods))))


def profit_factor(returns: str = "pct_chg") -> Column:
    r = F.col(returns)
    return F.try_divide(F.sum(F.when(r >= 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))))


def win_rate(action: str = "action", pct: str = "pct_chg") -> Column:
    closed = F.col(action) != codes.OPEN
    wins = F.count_if(closed & (F.col(pct) > 0))
    losses = F.count_if(closed & (F.col(pct) <= 0))
    return rounded(F.try_divide(F.lit(100.0) * wins, wins + losses))


def number_of(action: str, column: str = "action") -> Column:
    return F.count_if(F.col(column) == action)


def avg_return(pct: str = "pct_chg", include_open: bool = True) -> Column:
    """Mean over all logged rows; openings count with their 0 unless left out."""
    return rounded(F.avg(_logged(pct, include_open)))


def stddev_return(pct: str = "pct_chg", include_open: bool = True) -> Column:
    return rounded(F.stddev_samp(_logged(pct, include_open)))


def _logged(pct: str, include_open: bool) -> Column:
    return F.col(pct) if include_open else F.when(F.col("action") != codes.OPEN, F.col(pct))


def capital_metrics(capitals: DataFrame, by: str = RUN, dt: str = DT) -> DataFrame:
    curve = drawdown(capital_returns(capitals, by, dt), "capital", key=by, order=dt)
    return curve.groupBy(by).agg(
        total_returns(dt=dt).alias("total_returns"),
        max_drawdown().alias("max_drawdown"),
        sharpe().alias("sharpe_ratio"),
        profit_factor().alias("profit_factor"),
    )


def trade_metrics(trades: DataFrame, by: str = RUN, include_open: bool = True) -> DataFrame:
    return trades.groupBy(by).agg(
        win_rate().alias("win_rate"),
        number_of(codes.OPEN).alias("number_of_trades"),
        number_of(codes.STOP_LOSS).alias("number_of_stop_loss"),
        number_of(codes.TAKE_PROFIT).alias("number_of_take_profit"),
        number_of(codes.CLOSE).alias("number_of_close"),
        avg_return(include_open=include_open).alias("avg_return"),
        stddev_return(include_open=include_open).alias("stddev_return"),
    )


def evaluate(trades: DataFrame, capitals: DataFrame, by: str = RUN, include_open: bool = True) -> DataFrame:
    """One record of all metrics per run; a run without trades counts none."""
    found = trade_metrics(trades, by, include_open)
    counts = [c for c in found.columns if c.startswith("number_of_")]
    return capital_metrics(capitals, by).join(found, by, "left").fillna(0, counts)


def metrics_by_params(runs: DataFrame, params: Sequence[str], metrics: Sequence[str] = CORE_METRICS) -> DataFrame:
    """Mean and deviation of each metric per parameter set, best mean return first."""
    aggs = []
    for m in metrics:
        aggs += [rounded(F.avg(m)).alias(f"{m}_mean"), rounded(F.stddev_samp(m)).alias(f"{m}_std")]
    return runs.groupBy(*params).agg(*aggs).orderBy(F.desc(f"{metrics[0]}_mean"), *params)


def describe_metrics(runs: DataFrame, metrics: Sequence[str] = DESCRIBED) -> DataFrame:
    """(metric, count, mean, std, min, p25, p50, p75, max) over all runs, two digits, exact percentiles."""
    long = runs.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
    basic = long.groupBy("metric").agg(
        F.count("value").alias("count"),
        rounded(F.avg("value")).alias("mean"),
        rounded(F.stddev_samp("value")).alias("std"),
        rounded(F.min("value")).alias("min"),
        rounded(F.max("value")).alias("max"),
    )
    levels = exact_percentiles(long, ["metric"], "value", [0.25, 0.5, 0.75]).drop("n")
    parts = [rounded(F.element_at("percentiles", i + 1)).alias(f"p{q}") for i, q in enumerate((25, 50, 75))]
    return basic.join(levels, "metric", "left").select("metric", "count", "mean", "std", "min", *parts, "max")


def equity_bands(curves: DataFrame, dt: str = DT) -> DataFrame:
    """Per date over all runs: mean, std, one deviation up and down, and the drawdown of the mean in percent."""
    daily = curves.groupBy(dt).agg(F.avg("capital").alias("mean"), F.stddev_samp("capital").alias("std"))
    marked = drawdown(daily.withColumn("_all", F.lit(0)), "mean", key="_all", order=dt).drop("_all")
    return marked.select(
        dt,
        "mean",
        "std",
        (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"),
        rounded(F.lit(100.0) * F.col("drawdown")).alias("drawdown"),
    )


def wide_to_long(wide: DataFrame, dt: str = DT) -> DataFrame:
    """One capital column per run → (dt, run_id, capital)."""
    return wide.unpivot([dt], [c for c in wide.columns if c != dt], RUN, "capital")


def return_quartiles(curves: DataFrame, since="1900-01-01", until="2100-01-01", dt: str = DT) -> DataFrame:
    """Exact linear quartiles of capital across runs per date."""
    kept = curves.where(F.col(dt).between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    levels = exact_percentiles(kept, [dt], "capital", [0.25, 0.5, 0.75])
    return levels.select(dt, *[F.element_at("percentiles", i + 1).alias(q) for i, q in enumerate(("q1", "median", "q3"))])


def best_params(metrics: DataFrame, n: int, by: str = "total_returns_mean") -> DataFrame:
    return metrics.orderBy(F.desc(by)).limit(n)
