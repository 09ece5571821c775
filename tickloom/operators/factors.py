"""Technical factors and the registry that computes only what is asked for.

A factor names its inputs, its look-back and the stages of window columns that build it. ``with_factors``
resolves inputs transitively, merges the stages of independent factors and runs them over one layout: one
shuffle on (code, segment) and one sort, however many factors are requested.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import scalar as S
from tickloom.operators.series import (
    CODE,
    DT,
    POS,
    Layout,
    block_for,
    decay_lookback,
    in_segments,
    seeded_recursion,
)

Stages = list[dict[str, Column]]


@dataclass(frozen=True)
class Factor:
    """``build(layout)`` returns the stages; the last one holds the outputs."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[[Layout], Stages] = field(compare=False)
    outputs: tuple[str, ...] = ()
    lookback: int = 0
    blocks: tuple[int, ...] = ()
    notna: bool = False

    def __post_init__(self):
        if not self.outputs:
            object.__setattr__(self, "outputs", (self.name,))


class FactorBook:
    """Registry of factors. Numbered families (``sma17``) are made on demand from the pattern they match."""

    def __init__(self, parent: "FactorBook | None" = None):
        self._by_output: dict[str, Factor] = {}
        self._families: list[tuple[re.Pattern, Callable[[int], Factor]]] = []
        self._parent = parent

    def add(self, factor: Factor) -> Factor:
        for out in {factor.name, *factor.outputs}:
            self._by_output[out] = factor
        return factor

    def family(self, pattern: str, make: Callable[[int], Factor]) -> None:
        self._families.append((re.compile(pattern), make))

    def find(self, name: str) -> Factor | None:
        if name in self._by_output:
            return self._by_output[name]
        for pattern, make in self._families:
            if hit := pattern.fullmatch(name):
                return make(int(hit.group(1)))
        return self._parent.find(name) if self._parent else None

    def factor(self, outputs: Iterable[str] = (), notna: bool = False, lookback: int = 0):
        """Decorator for a user factor: its argument names are its inputs, as columns.

        The first argument is the layout (windows, ``ref``). It returns one Column, or a tuple matching
        ``outputs``.
        """

        def register(fn):
            names = tuple(inspect.signature(fn).parameters)[1:]
            outs = tuple(outputs) or (fn.__name__,)

            def build(layout: Layout) -> Stages:
                made = fn(layout, *[F.col(n) for n in names])
                made = made if isinstance(made, tuple) else (made,)
                if len(made) != len(outs):
                    raise ValueError(f"{fn.__name__} gives {len(made)} columns for outputs {outs}")
                return [dict(zip(outs, made))]

            self.add(Factor(fn.__name__, names, build, outs, lookback, notna=notna))
            return fn

        return register


def resolve(names: Iterable[str], book: FactorBook, present: Iterable[str]) -> list[Factor]:
    """Factors in an order that computes inputs first, without the ones whose outputs are all present."""
    present, ordered, open_ = set(present), [], []

    def visit(name: str):
        if name in present:
            return
        factor = book.find(name)
        if factor is None:
            raise KeyError(f"no column or factor named {name!r}")
        if factor in ordered:
            return
        if factor in open_:
            raise ValueError(f"factor {factor.name!r} depends on itself")
        open_.append(factor)
        for needed in factor.inputs:
            visit(needed)
        open_.remove(factor)
        ordered.append(factor)

    for name in names:
        visit(name)
    return ordered


def _plan(factors: list[Factor], layout: Layout) -> Stages:
    """Merge stages level by level; a factor starts after the last stage of its inputs."""
    ends: dict[str, int] = {}
    levels: Stages = []
    for factor in factors:
        start = max((ends.get(i, 0) for i in factor.inputs), default=0)
        stages = factor.build(layout)
        for offset, stage in enumerate(stages):
            while len(levels) <= start + offset:
                levels.append({})
            levels[start + offset].update(stage)
        for out in (factor.name, *factor.outputs):
            ends[out] = start + len(stages)
    return levels


def _reach(factors: list[Factor]) -> int:
    total: dict[str, int] = {}
    for factor in factors:
        reach = factor.lookback + max((total.get(i, 0) for i in factor.inputs), default=0)
        for out in (factor.name, *factor.outputs):
            total[out] = reach
    return max(total.values(), default=0)


def with_factors(
    df: DataFrame,
    names: Iterable[str],
    book: "FactorBook | None" = None,
    *,
    key: str = CODE,
    order: str = DT,
    unit: str = "year",
    keep_inputs: bool = False,
    keep_pos: bool = False,
) -> DataFrame:
    """Add the named factors, computing the factors they need and none besides."""
    names = list(names)
    factors = resolve(names, book or BUILTIN, df.columns)
    if not factors:
        return df
    blocks = {size for f in factors for size in f.blocks}
    out = in_segments(
        df, _reach(factors), lambda s: _plan(factors, s), blocks=blocks, key=key, order=order, unit=unit, keep_pos=keep_pos
    )
    if not keep_inputs:
        wanted = set(df.columns) | set(names) | {o for f in factors if f.name in names for o in f.outputs}
        out = out.drop(*[o for f in factors for o in f.outputs if o not in wanted])
    return out


def lookback_of(names: Iterable[str], book: "FactorBook | None", present: Iterable[str]) -> int:
    """Earlier bars that the named factors of a bar look back on, beside those its columns already hold."""
    return _reach(resolve(list(names), book or BUILTIN, list(present)))


def missing_factors(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that are not columns yet."""
    return [n for n in names if n not in df.columns]


def notna_columns(names: Iterable[str], book: "FactorBook | None" = None) -> list[str]:
    """Those of the names whose factor must not be NULL."""
    book = book or BUILTIN
    return [n for n in names if (f := book.find(n)) is not None and f.notna]


# -- built-in factors ------------------------------------------------------------------------------------------------


def ema_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def _blocks(*alphas: float) -> tuple[int, ...]:
    return tuple(block_for(a) for a in alphas if a < 1)


def _memory(n: int, alpha: float) -> int:
    return n + decay_lookback(alpha)


def sma(n: int, name: str | None = None, source: str = "close", notna: bool = True) -> Factor:
    """Mean of the last ``n`` values."""
    name = name or f"sma{n}"
    build = lambda s: [{name: s.ready(n, F.avg(source).over(s.tail(n)))}]
    return Factor(name, (source,), build, lookback=n - 1, notna=notna)


def ema(n: int, name: str | None = None, source: str = "close", notna: bool = True) -> Factor:
    """Exponential mean with factor 2/(n+1), seeded by the mean of the first ``n`` values."""
    name, alpha = name or f"ema{n}", ema_alpha(n)
    build = lambda s: seeded_recursion(s, F.col(source), n, alpha, 0, name)
    return Factor(name, (source,), build, lookback=_memory(n, alpha), blocks=_blocks(alpha), notna=notna)


def macd(fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd") -> Factor:
    """Histogram: (fast - slow) minus its exponential mean. The fast mean is seeded on the bars just before the
    bar where the slow one starts, so both lines begin together."""
    a_fast, a_slow, a_signal = ema_alpha(fast), ema_alpha(slow), ema_alpha(signal)

    def build(s: Layout) -> Stages:
        quick = seeded_recursion(s, F.col("close"), fast, a_fast, slow - fast, f"_{name}_fast")
        slow_ = seeded_recursion(s, F.col("close"), slow, a_slow, 0, f"_{name}_slow")
        line = F.col(f"_{name}_fast") - F.col(f"_{name}_slow")
        trail = seeded_recursion(s, F.col(f"_{name}_line"), signal, a_signal, slow - 1, f"_{name}_signal")
        return (
            [a | b for a, b in zip(quick, slow_)]
            + [{f"_{name}_line": line}]
            + trail
            + [{name: F.col(f"_{name}_line") - F.col(f"_{name}_signal")}]
        )

    memory = _memory(slow, a_slow) + _memory(signal, a_signal)
    return Factor(name, ("close",), build, lookback=memory, blocks=_blocks(a_fast, a_slow, a_signal), notna=True)


def bollinger(n: int = 20, up: float = 2.0, down: float = 2.0) -> Factor:
    """Mean and bands at multiples of the population deviation."""

    def build(s: Layout) -> Stages:
        mean, dev = F.avg("close").over(s.tail(n)), F.stddev_pop("close").over(s.tail(n))
        return [
            {"_boll_dev": dev, "_boll_mean": mean},
            {
                "boll_lower": s.ready(n, F.col("_boll_mean") - F.lit(float(down)) * F.col("_boll_dev")),
                "boll_middle": s.ready(n, F.col("_boll_mean")),
                "boll_upper": s.ready(n, F.col("_boll_mean") + F.lit(float(up)) * F.col("_boll_dev")),
            },
        ]

    return Factor("boll", ("close",), build, ("boll_lower", "boll_middle", "boll_upper"), lookback=n - 1, notna=True)


def rsi(fast: int = 6, mid: int = 12, slow: int = 24) -> Factor:
    """Share of gains among smoothed gains and losses, for three periods; 0 when there were neither."""
    periods = {"rsi_fast": fast, "rsi_mid": mid, "rsi_slow": slow}

    def build(s: Layout) -> Stages:
        change = F.col("close") - s.ref("close", 1)
        stages: Stages = [
            {"_rsi_chg": change},
            {"_rsi_up": F.greatest("_rsi_chg", F.lit(0.0)), "_rsi_down": F.greatest(-F.col("_rsi_chg"), F.lit(0.0))},
        ]
        smooth: Stages = []
        for out, n in periods.items():
            for side in ("up", "down"):
                part = seeded_recursion(s, F.col(f"_rsi_{side}"), n, 1.0 / n, 1, f"_{out}_{side}")
                for i, stage in enumerate(part):
                    if len(smooth) <= i:
                        smooth.append({})
                    smooth[i].update(stage)
        final = {}
        for out in periods:
            up, both = F.col(f"_{out}_up"), F.col(f"_{out}_up") + F.col(f"_{out}_down")
            final[out] = F.when(both.isNotNull(), F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * up, both)))
        return stages + smooth + [final]

    alphas = [1.0 / n for n in periods.values()]
    memory = max(_memory(n, 1.0 / n) for n in periods.values()) + 1
    return Factor("rsi", ("close",), build, tuple(periods), lookback=memory, blocks=_blocks(*alphas), notna=True)


def atr(n: int = 14, name: str = "atr") -> Factor:
    """Smoothed true range."""

    def build(s: Layout) -> Stages:
        before = F.col("_atr_before")
        true_range = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
        )
        return [{"_atr_before": s.ref("close", 1)}, {"_atr_range": F.when(before.isNotNull(), true_range)}] + seeded_recursion(
            s, F.col("_atr_range"), n, 1.0 / n, 1, name
        )

    inputs = ("high", "low", "close")
    return Factor(name, inputs, build, lookback=_memory(n, 1.0 / n) + 1, blocks=_blocks(1.0 / n), notna=True)


def skdj(n: int = 15, m: int = 5) -> Factor:
    """Slow stochastic: place of the close in the n-bar range, smoothed twice (K) and averaged (D).

    A flat range has no place; it counts as 0.
    """
    alpha = ema_alpha(m)

    def build(s: Layout) -> Stages:
        low, high = F.col("_kdj_low"), F.col("_kdj_high")
        place = F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(F.col("close") - low, high - low) * F.lit(100.0))
        return (
            [
                {"_kdj_low": F.min("low").over(s.tail(n)), "_kdj_high": F.max("high").over(s.tail(n))},
                {"_kdj_raw": s.ready(n, place)},
            ]
            + seeded_recursion(s, F.col("_kdj_raw"), m, alpha, n - 1, "_kdj_rsv")
            + seeded_recursion(s, F.col("_kdj_rsv"), m, alpha, n + m - 2, "sdj_k")
            + [{"sdj_d": s.ready(n + 3 * (m - 1), F.avg("sdj_k").over(s.tail(m)))}]
        )

    inputs = ("close", "low", "high")
    memory = n + m + 2 * _memory(m, alpha)
    return Factor("skdj", inputs, build, ("sdj_k", "sdj_d"), lookback=memory, blocks=_blocks(alpha), notna=True)


def rolling_min(n: int, source: str = "low", name: str | None = None) -> Factor:
    name = name or f"{source}_min{n}"
    return Factor(name, (source,), lambda s: [{name: s.ready(n, F.min(source).over(s.tail(n)))}], lookback=n - 1)


def rolling_max(n: int, source: str = "high", name: str | None = None) -> Factor:
    name = name or f"{source}_max{n}"
    return Factor(name, (source,), lambda s: [{name: s.ready(n, F.max(source).over(s.tail(n)))}], lookback=n - 1)


def regression_slope(n: int, source: str = "close", name: str | None = None) -> Factor:
    """Least-squares slope of the last ``n`` values on 0..n-1. Bar numbers serve as x: a shift leaves the slope."""
    name = name or f"slope{n}"
    x = F.col(POS).cast("double")
    build = lambda s: [{name: s.ready(n, F.regr_slope(F.col(source), x).over(s.tail(n)))}]
    return Factor(name, (source,), build, lookback=n - 1)


def ref_factor(source: str, k: int, name: str | None = None) -> Factor:
    name = name or f"{source}_ref{k}"
    return Factor(name, (source,), lambda s: [{name: s.ref(source, k)}], lookback=k)


def returns(name: str = "chg") -> Factor:
    """chg and pct_chg against the previous close, 0 on the first bar, two digits."""

    def build(s: Layout) -> Stages:
        before = F.col("_ret_before")
        chg = F.coalesce(F.col("close") - before, F.lit(0.0))
        return [
            {"_ret_before": s.ref("close", 1)},
            {
                "chg": S.rounded(chg),
                "pct_chg": S.rounded(F.coalesce(F.lit(100.0) * F.try_divide(F.col("close") - before, before), F.lit(0.0))),
            },
        ]

    return Factor("returns", ("close",), build, ("chg", "pct_chg"), lookback=1)


BUILTIN = FactorBook()
BUILTIN.family(r"sma(\d+)", sma)
BUILTIN.family(r"ema(\d+)", ema)
BUILTIN.family(r"slope(\d+)", regression_slope)
for _factor in (macd(), bollinger(), rsi(), atr(), skdj()):
    BUILTIN.add(_factor)
BUILTIN.add(
    Factor("typical_price", ("high", "low", "close"), lambda s: [{"typical_price": S.typical_price()}], notna=True)
)
BUILTIN.add(
    Factor("volatility", ("atr", "typical_price"), lambda s: [{"volatility": S.volatility_pct()}])
)


def extended(*factors: Factor) -> FactorBook:
    """A book with the built-in factors and the given ones, which win by name."""
    book = FactorBook(parent=BUILTIN)
    for factor in factors:
        book.add(factor)
    return book


def factor_book() -> FactorBook:
    return FactorBook(parent=BUILTIN)

