"""The index of runs against testing every run, and searches that runs share."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import exits
from tickloom.plans import sweep

RULE = [
    sweep.Threshold("dip", lambda d: F.col("close") <= F.col("lower") - d),
    sweep.Threshold("most", lambda m: F.col("vol") <= m, larger_is_stricter=False),
    sweep.Threshold("least", lambda m: F.col("vol") >= m),
]


def triggers(row, run):
    _, _, close, lower, vol = row
    return None not in (close, lower, vol) and close <= lower - run["dip"] and run["least"] <= vol <= run["most"]


def rows(n=200, seed=1):
    rnd = random.Random(seed)
    blank = lambda v: None if rnd.random() < 0.05 else v
    return [(i % 7, f"2020-01-{i % 28 + 1:02}", blank(rnd.randrange(40) / 4), blank(rnd.randrange(40) / 4), blank(float(rnd.randrange(50)))) for i in range(n)]


@pytest.mark.parametrize("kind", ["product", "scattered", "one", "alike"])
def test_triggered_runs(spark, kind):
    rnd = random.Random(7)
    sets = {
        "product": sweep.param_sets([("dip", [0, 0.5, 2.0, 7.25]), ("most", [10, 30, 45.0]), (("least", "x"), [(0, "u"), (20, "v"), (44, "w")])]),
        "scattered": [{"dip": rnd.randrange(40) / 4, "most": float(rnd.randrange(50)), "least": float(rnd.randrange(50)), "x": str(i)} for i in range(150)],
        "one": [{"dip": 1.0, "most": 30.0, "least": 5.0, "x": "y"}],
        "alike": [{"dip": 1.0, "most": 30.0, "least": 5.0, "x": "y"}] * 3,
    }[kind]
    runs = sweep.runs_of(lambda: sets, 2)
    given = rows()
    table = spark.createDataFrame(given, "code long, dt string, close double, lower double, vol double")
    found = sweep.sweep_signals(table, runs, RULE)
    want = sorted((run["run_id"], row[0], row[1], row[2]) for row in given for run in runs if triggers(row, run))
    assert sorted((r.run_id, r.code, r.dt, r.order_price) for r in found.collect()) == want and want
    literal = sweep.sweep_signals(table, runs, lambda p: RULE[0].holds(p("dip")) & RULE[1].holds(p("most")) & RULE[2].holds(p("least")))
    assert literal.schema.simpleString() == found.schema.simpleString() and literal.count() == len(want)
    assert sweep.sweep_signals(table.limit(0), runs, RULE).count() == 0
    assert sweep.sweep_signals(table, runs, []).count() == len(given) * len(runs)


def test_rows_meet_only_runs_they_trigger(spark):
    """On a full grid, each node that a row visits leads to a run; the plan holds values of axes, not runs."""
    values = [float(i) for i in range(40)]
    runs = sweep.runs_of(sweep.param_sets([("dip", values), ("least", values)]), 1)
    table = spark.createDataFrame([(1, "2020-01-01", 5.0, 6.5, 2.0), (2, "2020-01-01", 5.0, 4.0, 30.0)], "code long, dt string, close double, lower double, vol double")
    index = sweep.RunIndex(spark, runs, [RULE[0], RULE[2]])
    assert [index.levels[0].count(), index.levels[1].count()] == [40, 1600]
    assert {(r._run.dip, r._run.least) for r in index.triggered(table).collect()} == {(d, v) for d in (0.0, 1.0) for v in (0.0, 1.0, 2.0)}
    assert index.triggered(table)._jdf.queryExecution().analyzed().toString().count("1600") == 0


def test_large_grids_meet_in_shuffle_joins(spark, monkeypatch):
    runs = sweep.runs_of(sweep.param_sets([("dip", [0.0, 1.0]), ("most", [40.0]), ("least", [0.0, 9.0])]), 1)
    table = spark.createDataFrame(rows(), "code long, dt string, close double, lower double, vol double")
    want = sweep.sweep_signals(table, runs, RULE).count()
    monkeypatch.setattr(sweep, "BROADCAST_RUNS", 1)
    assert sweep.sweep_signals(table, runs, RULE).count() == want


def test_runs_share_searches(spark):
    rnd = random.Random(3)
    bars = spark.createDataFrame([(c, f"2020-{m:02}-{d:02}", *(round(rnd.uniform(8, 12), 2) for _ in range(4))) for c in range(3) for m in (1, 2, 3) for d in range(1, 25)],
                                 "code long, dt string, open double, high double, low double, close double").withColumn("dt", F.to_date("dt"))
    entered = bars.where(F.dayofmonth("dt") % 5 == 0).select("code", "dt", F.col("close").alias("order_price"))
    signals = entered.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("sl", (F.col("run") % 2 + 5).cast("double"))
    signals = signals.unionByName(signals.where("run = 1")).unionByName(signals.limit(2).withColumn("dt", F.to_date(F.lit("1999-01-01"))))
    one = exits.entry_exit(signals, bars, F.col("sl"), 7.0)
    same = exits.shared_exits(signals, bars, F.col("sl"), 7.0)
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert sorted(one.columns) == sorted(same.columns) and key(one) == key(same)
    with pytest.raises(ValueError):
        exits.shared_exits(signals, bars, 1.0, 1.0, exits.RANDOM)


def test_exit_searches_broadcast_no_stored_table(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i) for i in range(40)]
    bars = spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double")
    signals = bars.where(F.col("close") < 30).select("code", "dt", F.col("close").alias("order_price"), F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("run_id"))
    found = exits.shared_exits(signals, bars, 50.0, 20.0)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 and found.where("action = 'TAKE_PROFIT'").count() == 40
