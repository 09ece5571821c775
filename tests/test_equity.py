"""Equity curves against marking every trade on every day."""

import datetime as dt
import random

import pytest

from tickloom.operators import portfolio as P

TRADES = "run_id string, code long, dt date, order_price double, vol long, exit_dt date, exit_price double"


def day(i: int) -> dt.date:
    return dt.date(2019, 11, 1) + dt.timedelta(days=i)


def made(seed: int, runs=("a", "b")):
    """Bars with gaps, a code without bars, entries on days without a bar, trades that overlap or never close."""
    rnd = random.Random(seed)
    bars = [(c, day(i), round(rnd.uniform(5, 60), 2)) for c in range(5) for i in range(90) if rnd.random() < (0.9, 0.5, 0.1, 0.9, 0.02)[c]]
    trades = []
    for _ in range(120):
        c, start = rnd.randrange(6), rnd.randrange(88)
        stop = rnd.choice([None, start + 1 + rnd.randrange(60), start + 1])
        stop = None if stop is None or stop > 89 else stop
        trades.append((rnd.choice(runs), c, day(start), round(rnd.uniform(5, 60), 2), rnd.choice([0, 100, 300, 700]), stop and day(stop), stop and round(rnd.uniform(5, 60), 2)))
    return bars, trades


def marked(bars, trades, today):
    total = 0
    for _, code, entry, price, vol, stop, _ in trades:
        if entry <= today and (stop is None or today < stop):
            later = [(d, p) for c, d, p in bars if c == code and entry < d <= today]
            total += round((max(later)[1] if later else price) * vol, 2)
    return round(total, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_marks_by_run_and_in_one_book(spark, seed):
    bars, trades = made(seed)
    days = [(day(i), i + 1) for i in range(90)]
    b, t = spark.createDataFrame(bars, "code long, dt date, close double"), spark.createDataFrame(trades, TRADES)
    calendar = spark.createDataFrame(days, "dt date, idx long")
    runs = spark.createDataFrame([("a",), ("b",), ("idle",)], "run_id string")
    got = {(r.run_id, r.dt): r.market_value for r in P.equity_curve(t, b, calendar, 1e6, by=("run_id",), runs=runs).collect()}
    assert got == {(run, d): marked(bars, [x for x in trades if x[0] == run], d) for run in ("a", "b", "idle") for d, _ in days}
    whole = {r.dt: r.market_value for r in P.equity_curve(t, b, calendar, 1e6).collect()}
    assert whole == {d: marked(bars, trades, d) for d, _ in days}


def test_calendar_of_some_days_and_nothing_to_mark(spark):
    bars, trades = made(3)
    b, t = spark.createDataFrame(bars, "code long, dt date, close double"), spark.createDataFrame(trades, TRADES)
    some = [(day(i), n + 1) for n, i in enumerate(range(4, 90, 7))]
    calendar = spark.createDataFrame(some, "dt date, idx long")
    got = {r.dt: r.market_value for r in P.equity_curve(t, b, calendar, 0.0).collect()}
    assert got == {d: marked(bars, trades, d) for d, _ in some}
    for bars_, trades_ in ((b.limit(0), t), (b, t.limit(0))):
        rows = P.equity_curve(trades_, bars_, calendar, 5.0).collect()
        assert len(rows) == len(some) and all(r.market_value >= 0 for r in rows)


def test_rows_follow_the_bars_not_the_held_days(spark):
    """Twenty times the trades over the same bars sweep the same bars."""
    bars, _ = made(4)
    b = spark.createDataFrame(bars, "code long, dt date, close double")
    one = [("a", 0, day(0), 10.0, 100, None, None)]
    end = spark.createDataFrame([(day(89),)], "_end date")
    few, many = (P.holding_changes(spark.createDataFrame(one * n, TRADES), b, end, ()).collect() for n in (1, 20))
    assert [(r.dt, 20 * r.cents) for r in sorted(few)] == [(r.dt, r.cents) for r in sorted(many)]


def test_carried_prices_sort_only_the_bars(spark):
    from tickloom.operators import events

    start = dt.date(2020, 1, 1)
    day = lambda i: start + dt.timedelta(days=i - 1)
    calendar = spark.createDataFrame([(day(i), i) for i in range(1, 701)], "dt date, idx bigint")
    bars = {"a": {3: 1.0, 4: None, 300: 2.0, 699: 3.0}, "b": {1: 5.0}, "c": {700: 6.0}, "none": {10: None}}
    rows = [(code, day(i), x) for code, prices in bars.items() for i, x in prices.items()]
    out = events.forward_equity(spark.createDataFrame(rows, "code string, dt date, close double"), calendar=calendar)
    got = {(r.code, r.dt): r.close for r in out.collect()}
    want, last = {}, None
    for code, prices in bars.items():
        last = None
        for i in range(1, 701):
            last = prices.get(i) if prices.get(i) is not None else last
            want[code, day(i)] = last
    assert got == want and out.count() == len(want)


def looked_up(left, right, direction, exact):
    """The record of each (code, time) by trying all."""
    got = []
    for code, at in left:
        ahead = lambda t: at is not None and (t < at if direction == "backward" else t > at)
        fits = [(t, x) for c, t, x in right if c == code and t is not None and (ahead(t) or (exact and t == at))]
        nearest = (max if direction == "backward" else min)((t for t, _ in fits), default=None)
        got.append((code, at, max((x for t, x in fits if t == nearest), default=None)))
    return sorted(got, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_lookups_scan_once_and_find_the_nearest_record(spark, direction):
    from tickloom.operators.asof import asof_join

    rnd = random.Random(7)
    left = [(rnd.randrange(5), day(rnd.randrange(1500))) for _ in range(400)] + [(1, None), (2, None)]
    right = [(rnd.randrange(4), day(rnd.randrange(0, 1500, 5)), rnd.randrange(100)) for _ in range(300)] + [(1, None, 5)]
    rows, records = spark.createDataFrame(left, "code long, dt date"), spark.createDataFrame(right, "code long, at date, x long")
    for exact in (True, False):
        for unit in ("year", "month", "day"):
            found = asof_join(rows, records, ["x"], right_on="at", direction=direction, allow_exact=exact, unit=unit)
            assert sorted(map(tuple, found.collect()), key=repr) == looked_up(left, right, direction, exact)
    two = asof_join(rows, records.withColumn("y", -records.x), ["x", "y"], right_on="at", direction=direction)
    assert all(r.y is None if r.x is None else r.y == -r.x for r in two.collect())
    assert sorted((tuple(r)[:3] for r in two.collect()), key=repr) == looked_up(left, right, direction, True)
    # a frame to the end of its partition is read again for every row
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_the_stored_table_keeps_its_bar_numbers(spark, small):
    from tickloom.workload.trades import _table
    from tickloom.workload.views import Views

    assert "pos" in _table(Views(spark, small)).columns
