"""Exits by own rules against walking every bar."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import exits
from tickloom.operators.exits import FANOUT
from tickloom.operators.rule_exits import ExitRule, rule_exit, stop_at, take_at
from tickloom.plans.strategy import Slip, Strategy

BARS = "code long, dt date, open double, high double, low double, close double, noise double"


def made(n=5 * FANOUT + 37, seed=1):
    rnd, rows = random.Random(seed), []
    for code, size in ((1, n), (2, 40), (3, 1)):
        price = 10.0
        for i in range(size):
            o, c = price, round(max(1.0, price + rnd.uniform(-0.3, 0.3)), 2)
            rows.append((code, dt.date(2015, 1, 1) + dt.timedelta(days=i), o, round(max(o, c) + rnd.random() / 5, 2), round(min(o, c) - rnd.random() / 5, 2), c, rnd.random()))
            price = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(made(), BARS)


@pytest.fixture(scope="module")
def signals(spark):
    rows = [(r[0], r[1], r[5], i % 5 + 0.5) for i, r in enumerate(made()) if i % 9 == 0 or r[0] != 1]
    return spark.createDataFrame([*rows, rows[0], (9, rows[0][1], 1.0, 2.0), (1, dt.date(1990, 1, 1), 1.0, 2.0)], "code long, dt date, order_price double, room double")


def walked(signals, stop, take, closing=lambda b: False):
    bars, out = made(), []
    for code, day, price, room in signals:
        if not any(b[0] == code and b[1] == day for b in bars):
            continue
        for b in sorted(x for x in bars if x[0] == code and x[1] > day):
            s, t = stop(b, price, room), take(b, price, room)
            if s is not None or t is not None or closing(b):
                out.append((code, day, price, room, b[1], s if s is not None else t if t is not None else b[5], "STOP_LOSS" if s is not None else "TAKE_PROFIT" if t is not None else "CLOSE"))
                break
        else:
            out.append((code, day, price, room, None, None, None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


STOP = lambda bar, position: F.when(bar("noise") > 0.997, bar("close") - position("room") / F.lit(4.0))
TAKE = lambda bar, position: F.when(bar("high") > position("order_price") + F.lit(6.0) * position("room"), bar("high"))
SUMMED = ExitRule(TAKE, {"top": lambda bar: F.max(bar("high"))}, lambda node, position: node("top") > position("order_price") + F.lit(6.0) * position("room"))
NOISY = ExitRule(STOP, {"loud": lambda bar: F.max(bar("noise"))}, lambda node, position: node("loud") > 0.997)


@pytest.mark.parametrize("stop", [ExitRule(STOP), NOISY])
@pytest.mark.parametrize("take", [ExitRule(TAKE), SUMMED])
def test_rules_with_and_without_summaries(signals, bars, stop, take):
    want = walked([tuple(r) for r in signals.collect()], lambda b, p, room: b[5] - room / 4 if b[6] > 0.997 else None, lambda b, p, room: b[3] if b[3] > p + 6 * room else None)
    assert rows(rule_exit(signals, bars, stop, take)) == want
    assert any(r[4] is None for r in want) and any(r[4] and (r[4] - r[1]).days > 2 * FANOUT for r in want)  # several rounds


def test_levels_are_rules_too(signals, bars):
    closing = F.col("noise") > 0.99
    for policy in (exits.SL_FIRST, exits.TP_FIRST, exits.RANDOM):
        want = exits.entry_exit(signals, bars, 9.0, F.col("room") * 8, policy, close=closing, seed=3)
        got = rule_exit(signals, bars, stop_at(9.0), take_at(F.col("room") * 8), policy, close=closing, seed=3)
        assert got.columns == want.columns and rows(got) == rows(want)


def test_one_rule_none_and_empty_tables(signals, bars):
    assert all(r.exit_dt is None for r in rule_exit(signals, bars, None, None).collect())
    only = {r.action for r in rule_exit(signals, bars, None, SUMMED).collect()}
    assert only == {"TAKE_PROFIT", None}
    assert rule_exit(signals.limit(0), bars, NOISY, SUMMED).count() == rule_exit(signals, bars.limit(0), NOISY, SUMMED).count() == 0
    with pytest.raises(ValueError):
        rule_exit(signals, bars, NOISY, SUMMED, "first come")


def test_hooks_of_a_strategy(spark):
    """A live strategy judges by the close alone; custom parameters and a missing hook's percent level are at hand."""
    day = dt.date(2020, 1, 1)
    made = [(i, day + dt.timedelta(days=j), *([10.0] * 4 if j == 0 else [10.0, max(10.0, 10 * (1 + c / 100)), 10 * (1 + low / 100), 10 * (1 + c / 100)]), 0.0)
            for i, (c, low) in enumerate([(-0.6, -9.0), (0.0, 0.0), (-3.0, -3.0), (-9.0, -9.0), (4.0, 0.0), (4.6, 0.0)]) for j in (0, 1)]
    bars = spark.createDataFrame(made, BARS)
    live = lambda p: ExitRule(lambda bar, position: F.when((bar("close") / position("order_price") - 1) * 100 <= -p.room, bar("close")))
    plan = Strategy("live", (), lambda p: F.col("dt") == F.lit(day), should_stop_loss=live, take_profit=4.0, stop_loss_slip=Slip("max_pct", 0.0),
                    take_profit_slip=Slip("max_pct", 0.0)).with_params(room=2.9)
    got = {r.code: r.action for r in plan.trades(bars, plan.signals(bars)).collect()}
    assert got == {0: None, 1: None, 2: "STOP_LOSS", 3: "STOP_LOSS", 4: "TAKE_PROFIT", 5: "TAKE_PROFIT"}
    book = plan.backtest(bars, spark.createDataFrame([(day, 1), (day + dt.timedelta(days=1), 2)], "dt date, idx long"), 1e6)
    assert book["log"].where("action <> 'OPEN'").count() == 4
