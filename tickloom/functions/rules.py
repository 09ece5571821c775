"""Stop-loss and take-profit prices. All return NULL when the rule does not trigger."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.scalar import lit, pct_chg, price_at_pct


def stop_loss_price(entry, pct, open_="open", low="low") -> Column:
    """A gap through the level at the open fills at the open, a later touch at the level itself."""
    entry, pct = lit(entry), lit(pct)
    return (
        F.when(pct_chg(entry, open_) <= -pct, lit(open_))
        .when(pct_chg(entry, low) <= -pct, price_at_pct(entry, -pct))
    )


def take_profit_price(entry, pct, open_="open", high="high") -> Column:
    entry, pct = lit(entry), lit(pct)
    return (
        F.when(pct_chg(entry, open_) >= pct, lit(open_))
        .when(pct_chg(entry, high) >= pct, price_at_pct(entry, pct))
    )


def live_stop_loss(entry, pct, close="close") -> Column:
    return F.when(pct_chg(entry, close) <= -lit(pct), lit(close))


def live_take_profit(entry, pct, close="close") -> Column:
    return F.when(pct_chg(entry, close) >= lit(pct), lit(close))
