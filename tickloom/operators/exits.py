"""From entry signals to exits.

The exit of an entry is the first later bar that falls through its stop-loss level, rises through its
take-profit level or carries a close signal. Levels depend on the entry price, so a plain self-join would pair
every entry with every later bar. Instead bars are summarised in a tree: ``FANOUT`` bars to a node, ``FANOUT``
nodes to the next level, each with its lowest low, highest high and whether it holds a close signal. An entry
searches the rest of its own node, then the rest of the node above, and so on up; then it descends into the
first node that can hold its exit. Every join is on (code, node), meets at most ``FANOUT`` partners, and keeps
only those that match, so neither long holdings nor very long series enlarge it. The search has no horizon.

Bars, entries and nodes all grow with the data, and a stored table is many times its files' size in memory. So
their joins are merge joins by hint: none is to be broadcast because its files are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes, rules, scalar as S
from tickloom.operators.asof import asof_join
from tickloom.operators.series import CODE, DT, POS, with_positions
from tickloom.session import cut_lineage, stored

FANOUT = 128
LEVELS = 3
SL_FIRST, TP_FIRST, RANDOM = "stop loss first", "take profit first", "random"


def _tree(bars: DataFrame, levels: int) -> list[DataFrame]:
    leaf = bars.select(
        F.col(CODE).alias("_c"),
        F.col(POS).alias("_n"),
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
        F.coalesce(F.col("close_signal"), F.lit(False)).alias("_close"),
    )
    tree = [leaf]
    for _ in range(1, levels):
        grouped = tree[-1].groupBy("_c", F.floor(F.col("_n") / FANOUT).alias("_n"))
        tree.append(grouped.agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_close").alias("_close")))
    return tree


def _parent(node: Column) -> Column:
    return F.floor(node / FANOUT)


def first_hit_position(entries: DataFrame, bars: DataFrame, match: Column, levels: int = LEVELS) -> DataFrame:
    """Add ``_hit``: position of the first bar after ``pos`` of the same code where ``match`` holds.

    ``match`` is over the entry's columns and ``_low``, ``_high``, ``_close`` of a bar or node. It must hold for a
    node whenever it holds for a bar inside it. ``entries`` need a unique (code, pos, entry_id).
    """
    tree = _tree(bars, levels)
    keys = list(entries.columns)
    # where the search stands: entries still searching have a non-negative node, finished ones a spread negative
    found = entries.withColumns({"_level": F.lit(-1), "_cursor": F.col(POS) + 1, "_hit": F.lit(None).cast("bigint")})
    done = -1 - F.pmod(F.col(POS), F.lit(1_024))

    for level, nodes in enumerate(tree):
        top = level == len(tree) - 1
        home = F.lit(0).cast("bigint") if top else _parent(F.col("_cursor"))
        probe = found.withColumn("_home", F.when(F.col("_level") < 0, home).otherwise(done))
        side = nodes.withColumn("_node_home", F.lit(0).cast("bigint") if top else _parent(F.col("_n")))
        on = (
            (F.col(CODE) == F.col("_c"))
            & (F.col("_home") == F.col("_node_home"))
            & (F.col("_n") >= F.col("_cursor"))
            & match
        )
        joined = probe.join(side.hint("merge"), on, "left").groupBy(*keys, "_level", "_cursor", "_hit").agg(F.min("_n").alias("_new"))
        found = joined.select(
            *keys,
            F.when((F.col("_level") < 0) & F.col("_new").isNotNull(), F.lit(level)).otherwise(F.col("_level")).alias("_level"),
            F.when(F.col("_level") < 0, F.coalesce("_new", _parent(F.col("_cursor")) + 1)).otherwise(F.col("_cursor")).alias("_cursor"),
            F.coalesce("_hit", F.when(F.lit(level == 0), F.col("_new"))).alias("_hit"),
        )

    for level in range(len(tree) - 2, -1, -1):
        probe = found.withColumn("_home", F.when(F.col("_level") == level + 1, F.col("_cursor")).otherwise(done))
        side = tree[level].withColumn("_node_home", _parent(F.col("_n")))
        on = (F.col(CODE) == F.col("_c")) & (F.col("_home") == F.col("_node_home")) & match
        joined = probe.join(side.hint("merge"), on, "left").groupBy(*keys, "_level", "_cursor", "_hit").agg(F.min("_n").alias("_new"))
        down = F.col("_level") == level + 1
        found = joined.select(
            *keys,
            F.when(down, F.lit(level)).otherwise(F.col("_level")).alias("_level"),
            F.when(down, F.col("_new")).otherwise(F.col("_cursor")).alias("_cursor"),
            F.coalesce("_hit", F.when(down & F.lit(level == 0), F.col("_new"))).alias("_hit"),
        )
    return found.drop("_level", "_cursor")


def entry_exit(
    signals: DataFrame,
    bars: DataFrame,
    stop_loss: Column | float,
    take_profit: Column | float,
    order_policy: str = SL_FIRST,
    *,
    close: Column | str | None = None,
    seed: int = 0,
    unit: str = "year",
    run_keys: tuple[str, ...] = (),
    levels: int = LEVELS,
) -> DataFrame:
    """One row per signal (code, dt, order_price, ...) with exit_dt, exit_price, action; NULL while open.

    Entries are independent of each other and exits start on the bar after the entry. On one bar the level rules
    go before the close signal; when both levels are hit ``order_policy`` decides.
    """
    if order_policy not in (SL_FIRST, TP_FIRST, RANDOM):
        raise ValueError(f"unknown order policy {order_policy!r}")
    sl = stop_loss if isinstance(stop_loss, Column) else F.lit(float(stop_loss))
    tp = take_profit if isinstance(take_profit, Column) else F.lit(float(take_profit))
    closing = F.lit(False) if close is None else (F.expr(close) if isinstance(close, str) else close)
    # the search reads no factor: only these columns are numbered, shuffled and stored
    extra = ["orig_open"] if "orig_open" in bars.columns else []
    read = [CODE, DT, *([POS] if POS in bars.columns else []), "open", "high", "low", "close", *extra]
    numbered = stored(with_positions(bars.withColumn("close_signal", closing).select(*read, "close_signal"), unit=unit), "bars")

    # equal signals take one search together and come apart again at the end
    entries = signals.drop(POS)
    entries = entries.groupBy(*entries.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    entries = entries.withColumns({"_sl": sl, "_tp": tp})
    places = numbered.select(CODE, DT, POS)
    entries = stored(entries.join(places.hint("merge"), [CODE, DT]), "entries")
    match = (
        (S.pct_chg("order_price", F.col("_low")) <= -F.col("_sl"))
        | (S.pct_chg("order_price", F.col("_high")) >= F.col("_tp"))
        | F.col("_close")
    )
    hits = first_hit_position(entries, numbered, match, levels)

    bar = numbered.select(
        F.col(CODE).alias("_bar_code"),
        F.col(POS).alias("_bar_pos"),
        F.col(DT).alias("exit_dt"),
        F.col("open").alias("_open"),
        F.col("high").alias("_bar_high"),
        F.col("low").alias("_bar_low"),
        F.col("close").alias("_bar_close"),
        F.col("close_signal").alias("_bar_signal"),
        *[F.col(c).alias(f"exit_{c}") for c in extra],
    )
    # open entries get a negative place of their own so that they do not pile up on one join key
    place = F.coalesce(F.col("_hit"), -1 - F.col(POS))
    joined = hits.join(bar.hint("merge"), (F.col(CODE) == F.col("_bar_code")) & (place == F.col("_bar_pos")), "left")
    stop = rules.stop_loss_price(F.col("order_price"), F.col("_sl"), "_open", "_bar_low")
    take = rules.take_profit_price(F.col("order_price"), F.col("_tp"), "_open", "_bar_high")
    toss = S.uniform(CODE, DT, "exit_dt", *run_keys, seed=seed) <= 0.5
    prefer_stop = {SL_FIRST: F.lit(True), TP_FIRST: F.lit(False), RANDOM: toss}[order_policy]
    action = (
        F.when(F.col("_stop").isNotNull() & (F.col("_take").isNull() | prefer_stop), F.lit(codes.STOP_LOSS))
        .when(F.col("_take").isNotNull(), F.lit(codes.TAKE_PROFIT))
        .when(F.col("_bar_signal"), F.lit(codes.CLOSE))
    )
    price = F.when(F.col("action") == codes.STOP_LOSS, F.col("_stop")).when(
        F.col("action") == codes.TAKE_PROFIT, F.col("_take")
    ).when(F.col("action") == codes.CLOSE, F.col("_bar_close"))
    resolved = joined.withColumns({"_stop": stop, "_take": take}).withColumn("action", action).withColumn("exit_price", price)
    keep = [c for c in signals.columns if c != POS]
    each = resolved.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return each.select(*keep, "exit_dt", "exit_price", "action", *[f"exit_{c}" for c in extra])


def shared_exits(signals: DataFrame, bars: DataFrame, stop_loss: Column | float, take_profit: Column | float, order_policy: str = SL_FIRST, **kwargs) -> DataFrame:
    """``entry_exit`` for signals of many runs: runs that enter alike, with the same levels, share one search.

    ``order_policy`` must not be random, as runs would share their draws too.
    """
    if order_policy == RANDOM:
        raise ValueError("runs that draw by themselves can't share a search")
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    signals = stored(signals.withColumns({"_stop_at": lit(stop_loss), "_take_at": lit(take_profit)}), "signals")
    alike = [CODE, DT, "order_price", "_stop_at", "_take_at"]
    found = entry_exit(signals.select(*alike).distinct(), bars, F.col("_stop_at"), F.col("_take_at"), order_policy, **kwargs)
    theirs = found.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(alike)], *[c for c in found.columns if c not in alike])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(alike)])
    # signals that no bar places have no row in ``found``, as in ``entry_exit``
    return signals.join(theirs.hint("merge"), same).drop(*[f"_s{i}" for i in range(len(alike))], "_stop_at", "_take_at")


def without_overlap(trades: DataFrame, keys: tuple[str, ...] = (CODE,)) -> DataFrame:
    """Keep the trades that a holder of one position per code would make: the first entry, then the first entry
    after the day of its exit, and so on. An entry without an exit is the last one.

    Each trade points to its successor; pointers are doubled per round, so the rounds grow with the logarithm of
    the longest chain and no code is walked in a single task. Pointers are cut in the shared folder each round.
    Trades are stored first: pointers, first entries and result read them, and a search behind them would run for each.
    """
    keys = list(keys)
    trades = stored(trades, "trades")
    follow = asof_rows(trades, keys)
    jumps = cut_lineage(follow)
    first = trades.groupBy(*keys).agg(F.min(DT).alias(DT))
    chosen = cut_lineage(first)
    while not jumps.where(F.col("_next").isNotNull()).isEmpty():
        reached = chosen.join(jumps, [*keys, DT]).where(F.col("_next").isNotNull()).select(*keys, F.col("_next").alias(DT))
        chosen = cut_lineage(chosen.unionByName(reached).distinct())
        target = jumps.select(*keys, F.col(DT).alias("_next"), F.col("_next").alias("_after"))
        jumps = cut_lineage(
            jumps.where(F.col("_next").isNotNull()).join(target, [*keys, "_next"]).select(*keys, DT, F.col("_after").alias("_next"))
        )
    return trades.join(chosen, [*keys, DT], "left_semi")


def asof_rows(trades: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dt, _next): the first entry strictly after each trade's exit day."""
    one = "_series"
    named = trades.withColumn(one, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    entries = named.select(one, F.col(DT).alias("_next")).distinct().withColumn("_entry_dt", F.col("_next"))
    closed = named.where(F.col("exit_dt").isNotNull()).select(one, *keys, DT, "exit_dt")
    linked = asof_join(
        closed, entries, ["_next"], key=one, left_on="exit_dt", right_on="_entry_dt", direction="forward", allow_exact=False, alike=True
    )
    return linked.select(*keys, DT, "_next")


def first_touch(minute: DataFrame, signals: DataFrame, *, time: str = "time") -> DataFrame:
    """First minute of the signal's day whose [low, high] holds the order price, within the tolerance."""
    bars = minute.select(CODE, DT, F.col(time).alias("_time"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    touch = signals.join(bars, [CODE, DT]).where(S.between("order_price", "_low", "_high"))
    return touch.groupBy(*signals.columns).agg(F.min("_time").alias(time))


def minute_exit(
    positions: DataFrame, minute: DataFrame, stop_loss: float, take_profit: float, *, time: str = "time", unit: str = "month"
) -> DataFrame:
    """First minute after the entry day that hits a level, per position (code, entry_dt, price, unique per code
    and day); NULL while open. Take-profit goes before stop-loss; shares bought on the day cannot be sold on it.

    Uses the same tree search as daily exits, from the last minute of the entry day on.
    """
    numbered = with_positions(minute, order=[DT, time], unit=unit)
    last = numbered.groupBy(CODE, DT).agg(F.max(POS).alias(POS)).withColumnRenamed(DT, "_day")
    entries = asof_join(positions, last, [POS], left_on="entry_dt", right_on="_day")
    entries = entries.withColumn(POS, F.coalesce(POS, F.lit(-1)))
    match = (S.pct_chg("price", F.col("_low")) <= F.lit(-float(stop_loss))) | (
        S.pct_chg("price", F.col("_high")) >= F.lit(float(take_profit))
    )
    hits = first_hit_position(entries, numbered.withColumn("close_signal", F.lit(False)), match)
    bar = numbered.select(
        F.col(CODE).alias("_bar_code"),
        F.col(POS).alias("_bar_pos"),
        F.col(DT).alias("exit_dt"),
        F.col(time).alias("exit_time"),
        *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low")],
    )
    place = F.coalesce(F.col("_hit"), -2 - F.col(POS))
    joined = hits.join(bar.hint("merge"), (F.col(CODE) == F.col("_bar_code")) & (place == F.col("_bar_pos")), "left")
    take = rules.take_profit_price("price", float(take_profit), "_open", "_high")
    stop = rules.stop_loss_price("price", float(stop_loss), "_open", "_low")
    action = F.when(take.isNotNull(), F.lit(codes.TAKE_PROFIT)).when(stop.isNotNull(), F.lit(codes.STOP_LOSS))
    return joined.select(
        *positions.columns, "exit_dt", "exit_time", F.coalesce(take, stop).alias("exit_price"), action.alias("action")
    )
