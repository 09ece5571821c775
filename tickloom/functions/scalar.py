"""Price arithmetic as Column expressions.

Rounding is half-to-even on the scaled value, as data frames round: ``rint(x * 10^n) / 10^n``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

TOLERANCE = 1e-4
#: 52 hash bits, the widest integer range a double holds exactly with room for the half step.
HASH_DIGITS = 13


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(c: Column | str | float | int) -> Column:
    """Names become columns, plain numbers become literals."""
    return col(c) if isinstance(c, (Column, str)) else F.lit(c)


def rounded(x: Column | str, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.rint(lit(x) * scale) / F.lit(scale)


# -- changes and levels ------------------------------------------------------------------------------------------


def pct_chg(base, then) -> Column:
    """Percent change from ``base`` to ``then``, two digits; NULL for a zero base."""
    base, then = lit(base), lit(then)
    return rounded(F.try_divide(F.lit(100.0) * (then - base), base))


def price_at_pct(price, pct) -> Column:
    return rounded(lit(price) * (F.lit(1.0) + lit(pct) * F.lit(1e-2)))


def typical_price(high="high", low="low", close="close") -> Column:
    return (col(high) + col(low) + col(close)) / F.lit(3.0)


def volatility_pct(atr="atr", typical="typical_price") -> Column:
    return F.try_divide(F.lit(100.0) * col(atr), col(typical))


def market_cap(price="close", total_share="total_share") -> Column:
    return lit(price) * lit(total_share)


def avg_price(market_value, vol) -> Column:
    """Value per share, two digits; 0 for an empty position or an undefined value."""
    market_value, vol = lit(market_value), lit(vol)
    safe = F.nanvl(F.coalesce(market_value, F.lit(0.0)), F.lit(0.0))
    return F.when(vol == 0, F.lit(0.0)).otherwise(rounded(F.try_divide(safe, vol)))


# -- tolerant comparison -----------------------------------------------------------------------------------------


def gt(a, b, precision: float = TOLERANCE) -> Column:
    return (lit(a) - lit(b)) > F.lit(precision)


def lt(a, b, precision: float = TOLERANCE) -> Column:
    return (lit(b) - lit(a)) > F.lit(precision)


def eq(a, b, precision: float = TOLERANCE) -> Column:
    return F.abs(lit(a) - lit(b)) < F.lit(precision)


def gte(a, b, precision: float = TOLERANCE) -> Column:
    return gt(a, b, precision) | eq(a, b, precision)


def lte(a, b, precision: float = TOLERANCE) -> Column:
    return lt(a, b, precision) | eq(a, b, precision)


def between(a, lower, upper, precision: float = TOLERANCE) -> Column:
    return gte(a, lower, precision) & lte(a, upper, precision)


# -- fees --------------------------------------------------------------------------------------------------------


def commission(amount, rate_pct, minimum) -> Column:
    return rounded(F.greatest(lit(amount) * (lit(rate_pct) * F.lit(1e-2)), lit(minimum)))


def stamp_duty(amount, rate_pct) -> Column:
    return rounded(lit(amount) * (lit(rate_pct) * F.lit(1e-2)))


def buy_total(amount, rate_pct, minimum) -> Column:
    return rounded(lit(amount) + commission(amount, rate_pct, minimum))


def sell_net(amount, rate_pct, minimum, stamp_pct) -> Column:
    return rounded(lit(amount) - commission(amount, rate_pct, minimum) - stamp_duty(amount, stamp_pct))


# -- positions (columns price, vol, avail_vol, yesterday_vol, latest_price) -----------------------------------------


def value_at(price, vol="vol") -> Column:
    return rounded(lit(price) * lit(vol))


def cost(price="price", vol="vol") -> Column:
    return value_at(price, vol)


def position_value(latest="latest_price", vol="vol") -> Column:
    return value_at(latest, vol)


def pnl_at(at, price="price", vol="vol") -> Column:
    return rounded(value_at(at, vol) - cost(price, vol))


def chg_at(at, price="price") -> Column:
    return rounded(lit(at) - lit(price))


def pct_chg_at(at, price="price") -> Column:
    return F.when(chg_at(at, price) == 0, F.lit(0.0)).otherwise(pct_chg(price, at))


def is_closed(vol="vol", avail="avail_vol") -> Column:
    return (lit(vol) == 0) & (lit(avail) == 0)


def is_new(yesterday="yesterday_vol") -> Column:
    return lit(yesterday) == 0


def net_return(price, latest, vol, rate_pct, minimum, stamp_pct) -> Column:
    """Return on cost of a closed position after both commissions and the stamp duty."""
    entry, exit_ = cost(price, vol), value_at(latest, vol)
    gross = pnl_at(latest, price, vol)
    fees = commission(entry, rate_pct, minimum) + commission(exit_, rate_pct, minimum) + stamp_duty(exit_, stamp_pct)
    return F.try_divide(gross - fees, entry)


# -- repeatable randomness -----------------------------------------------------------------------------------------


def uniform(*keys, seed: int = 0) -> Column:
    """A number in (0, 1) that depends only on the row's keys and the seed, never on partitioning."""
    text = F.concat_ws("|", *[lit(k).cast("string") for k in keys], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def slippage(price, method: str, params, orig_open=None, u: Column | None = None) -> Column:
    """Worsen a sell price by a random slip.

    ``max_jump``: 0..k ticks of 0.01 relative to the unadjusted open; ``max_pct``: uniform up to the bound in
    percent; ``weibull``: percent drawn by inverse distribution from (shape, scale, shift).
    """
    price = lit(price)
    if method == "max_jump":
        jumps = int(params)
        ticks = F.least(F.floor(u * F.lit(float(jumps + 1))), F.lit(jumps))
        return price * (F.lit(1.0) - F.try_divide(F.lit(0.01), lit(orig_open)) * ticks)
    if method == "max_pct":
        return price * (F.lit(1.0) - u * F.lit(float(params) * 1e-2))
    if method == "weibull":
        draw = F.lit(float(params["scale"])) * F.pow(-F.ln(F.lit(1.0) - u), F.lit(1.0 / params["shape"]))
        return price * (F.lit(1.0) - (draw + F.lit(float(params["shift"]))) * F.lit(1e-2))
    raise ValueError(f"unknown slippage method {method!r}")


def live_slippage(price, pct: float, paper: bool = False, u: Column | None = None) -> Column:
    """Fixed slip in live trading, uniform up to the bound when trading on paper."""
    slip = F.lit(pct * 1e-2)
    return lit(price) * (F.lit(1.0) - (u * slip if paper else slip))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
