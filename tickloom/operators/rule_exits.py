"""Exits by a strategy's own rules.

A rule gives the price at which a position is sold on a bar, or NULL, as a Column over the bar's and the position's
columns. Unlike percent levels, such a rule can't be answered from a node's extremes alone, so a search has to look again
behind a node that held no exit. It goes in rounds over windows of nodes (``FANOUT`` bars of a code each) that double:
a position meets the nodes of its window, then the bars of those nodes, and keeps its first hit; those without one go on
behind the window. A rule may declare a summary per node and a condition over it that must hold wherever a bar inside
triggers. Nodes that fail the conditions of all rules are left unread; a rule that declares none has its bars scanned.

So a position meets at most twice the bars up to its exit, and a node's row in place of its bars where summaries tell.
Rounds grow with the logarithm of the longest search. Joins are on (code, node), so a long code is spread over its nodes.
Each round's hits and open positions are written to the shared folder. Joins are merge joins by hint, as in ``exits``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes, rules, scalar as S
from tickloom.operators.exits import FANOUT, RANDOM, SL_FIRST, TP_FIRST
from tickloom.operators.series import CODE, DT, POS, with_positions
from tickloom.session import stored

#: Looks up a column of the bar, the position or the node by name.
Lookup = Callable[[str], Column]


@dataclass(frozen=True)
class ExitRule:
    """``price(bar, position)``: sell price on a bar, NULL to hold. A summary is optional: ``summary`` names aggregates over
    the bars of a node, ``may(node, position)`` must hold for a node if the price isn't NULL on one of its bars."""

    price: Callable[[Lookup, Lookup], Column]
    summary: dict[str, Callable[[Lookup], Column]] = field(default_factory=dict)
    may: Callable[[Lookup, Lookup], Column] | None = None


def stop_at(pct: Column | float) -> ExitRule:
    """The stop-loss level in percent of the order price."""
    return ExitRule(
        lambda bar, position: rules.stop_loss_price(position("order_price"), pct, bar("open"), bar("low")),
        {"lowest": lambda bar: F.least(F.min(bar("low")), F.min(bar("open")))},
        lambda node, position: S.pct_chg(position("order_price"), node("lowest")) <= -S.lit(pct),
    )


def take_at(pct: Column | float) -> ExitRule:
    """The take-profit level in percent of the order price."""
    return ExitRule(
        lambda bar, position: rules.take_profit_price(position("order_price"), pct, bar("open"), bar("high")),
        {"highest": lambda bar: F.greatest(F.max(bar("high")), F.max(bar("open")))},
        lambda node, position: S.pct_chg(position("order_price"), node("highest")) >= S.lit(pct),
    )


def _named(prefix: str) -> Lookup:
    return lambda name: F.col(f"{prefix}{name}")


def rule_exit(
    signals: DataFrame,
    bars: DataFrame,
    stop: ExitRule | None,
    take: ExitRule | None,
    order_policy: str = SL_FIRST,
    *,
    close: Column | None = None,
    seed: int = 0,
    unit: str = "year",
    run_keys: tuple[str, ...] = (),
) -> DataFrame:
    """One row per signal (code, dt, order_price, ...) with exit_dt, exit_price, action; NULL while open.

    As ``entry_exit``: exits start on the bar after the entry, both rules go before the close signal on one bar, and
    ``order_policy`` decides when both trigger. Signals on days without a bar of their code are dropped, those that repeat
    stay apart. ``close`` is a condition over the bar's columns.
    """
    if order_policy not in (SL_FIRST, TP_FIRST, RANDOM):
        raise ValueError(f"unknown order policy {order_policy!r}")
    bar, node, position = _named("_b_"), _named("_s_"), _named("")
    closing = F.coalesce(F.lit(False) if close is None else close, F.lit(False))
    numbered = with_positions(bars.withColumn("close_signal", closing), unit=unit)
    numbered = stored(numbered.select(F.floor(F.col(POS) / FANOUT).alias("_node"), *[F.col(c).alias(f"_b_{c}") for c in numbered.columns]), "bars")

    both = {"stop": stop, "take": take}
    given = {name: rule for name, rule in both.items() if rule is not None}
    sums = [f(bar).alias(f"_s_{name}_{k}") for name, rule in given.items() for k, f in rule.summary.items()]
    nodes = stored(numbered.groupBy(bar(CODE).alias("_c"), "_node").agg(F.max(bar("close_signal")).alias("_s_close"), *sums), "nodes")
    may = [rule.may(_named(f"_s_{name}_"), position) if rule.may else F.lit(True) for name, rule in given.items()]
    may = reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in may], node("close"))
    null = F.lit(None).cast("double")
    price = {name: rule.price(bar, position) if rule else null for name, rule in both.items()}
    triggered = price["stop"].isNotNull() | price["take"].isNotNull() | bar("close_signal")

    ends = nodes.groupBy("_c").agg(F.max("_node").alias("_last"))
    places = numbered.select(bar(CODE).alias(CODE), bar(DT).alias(DT), bar(POS).alias("_pos"))
    entries = signals.join(places.hint("merge"), [CODE, DT]).withColumn("_id", F.monotonically_increasing_id())
    entries = stored(entries, "entries")
    searching = entries.join(ends, F.col(CODE) == F.col("_c")).drop("_c").withColumn("_at", F.floor((F.col("_pos") + 1) / FANOUT))
    searching, width, hits = stored(searching.where(F.col("_at") <= F.col("_last")), "searching"), 1, []
    while not searching.isEmpty():
        window = F.sequence("_at", F.least(F.col("_at") + (width - 1), F.col("_last")))
        visits = searching.withColumn("_node", F.explode(window)).withColumn("_c", F.col(CODE)).join(nodes.hint("merge"), ["_c", "_node"]).where(may)
        met = visits.select(*entries.columns, "_node").join(numbered.withColumnRenamed("_node", "_n").hint("merge"), (F.col(CODE) == bar(CODE)) & (F.col("_node") == F.col("_n")))
        found = met.where((bar(POS) > F.col("_pos")) & triggered).groupBy("_id").agg(F.min(bar(POS)).alias("_hit"))
        hits.append(stored(found, "hits"))
        left = searching.join(hits[-1].hint("merge"), "_id", "left_anti").withColumn("_at", F.col("_at") + width)
        searching, width = stored(left.where(F.col("_at") <= F.col("_last")), "searching"), width * 2

    exits = reduce(DataFrame.unionByName, hits) if hits else entries.select("_id", F.lit(None).cast("bigint").alias("_hit")).limit(0)
    placed = entries.join(exits.hint("merge"), "_id", "left")
    # open positions get a place of their own, below all bars
    place = F.coalesce(F.col("_hit"), -1 - F.col("_id"))
    joined = placed.join(numbered.drop("_node").hint("merge"), (F.col(CODE) == bar(CODE)) & (place == bar(POS)), "left")
    sold = joined.withColumns({"_stop": price["stop"], "_take": price["take"], "exit_dt": bar(DT)})
    toss = S.uniform(CODE, DT, "exit_dt", *run_keys, seed=seed) <= 0.5
    prefer_stop = {SL_FIRST: F.lit(True), TP_FIRST: F.lit(False), RANDOM: toss}[order_policy]
    action = (
        F.when(F.col("_stop").isNotNull() & (F.col("_take").isNull() | prefer_stop), F.lit(codes.STOP_LOSS))
        .when(F.col("_take").isNotNull(), F.lit(codes.TAKE_PROFIT))
        .when(bar("close_signal"), F.lit(codes.CLOSE))
    )
    sold = sold.withColumn("action", F.when(F.col("_hit").isNotNull(), action))
    at = F.when(F.col("action") == codes.STOP_LOSS, F.col("_stop")).when(F.col("action") == codes.TAKE_PROFIT, F.col("_take")).when(F.col("action") == codes.CLOSE, bar("close"))
    extra = [bar("orig_open").alias("exit_orig_open")] if "orig_open" in bars.columns else []
    return sold.select(*signals.columns, "exit_dt", at.alias("exit_price"), "action", *extra)
