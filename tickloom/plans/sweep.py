"""Parameter grids and the evaluation of rules for many parameter sets in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators.series import CODE, DT

Axis = tuple[str | Sequence[str], Sequence]

#: An index of at most so many runs is broadcast; larger ones meet the rows in shuffle joins.
BROADCAST_RUNS = 100_000


def param_sets(axes: Iterable[Axis]) -> list[dict[str, float]]:
    """Cartesian product of the axes. A group axis (several names) contributes its tuples as one axis."""
    sets: list[dict[str, float]] = [{}]
    for name, choices in axes:
        group = [name] if isinstance(name, str) else list(name)
        rows = [(c,) if isinstance(name, str) else tuple(c) for c in choices]
        if any(len(r) != len(group) for r in rows):
            raise ValueError(f"choices of {name} do not match its names")
        sets = [{**s, **dict(zip(group, r))} for s in sets for r in rows]
    return sets


def runs_of(sets: Iterable[dict[str, float]] | Callable[[], Iterable[dict[str, float]]], repetitions: int = 1) -> list[dict[str, float]]:
    """One run per (parameter set, repetition): run_id, batch_id, repetition and the parameters. ``sets`` may be a
    function that makes the parameter sets."""
    sets, runs = list(sets() if callable(sets) else sets), []
    for rep in range(1, repetitions + 1):
        for i, params in enumerate(sets, 1):
            runs.append({"run_id": f"{rep}-{i}", "batch_id": f"{rep}-1", "repetition": rep, **params})
    return runs


def param_grid(axes: Sequence[DataFrame]) -> DataFrame:
    """Grid of axes held as small DataFrames (distinct rows of each): every axis is packed into one array and
    unrolled, so no join is involved. The product of their sizes is the number of rows."""
    packed = [_packed(a) for a in axes]
    numbered = [p.select(F.lit(i).alias("_i"), F.to_json("_rows").alias("_j")) for i, p in enumerate(packed)]
    one = reduce(DataFrame.unionByName, numbered).groupBy().pivot("_i", list(range(len(axes)))).agg(F.first("_j"))
    for i, axis in enumerate(axes):
        kind = packed[i].schema["_rows"].dataType
        one = one.withColumn(f"_a{i}", F.explode(F.from_json(F.col(str(i)), kind)))
    return one.select(*[F.col(f"_a{i}")[c].alias(c) for i, a in enumerate(axes) for c in a.columns])


def _packed(axis: DataFrame) -> DataFrame:
    """One row with the axis as an array; an axis is a list of choices, not a table of data."""
    return axis.distinct().agg(F.sort_array(F.collect_list(F.struct(*axis.columns))).alias("_rows"))


def grid_frame(spark: SparkSession, runs: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in runs], list(runs[0]))


def grid_literal(runs: Sequence[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in runs])


@dataclass(frozen=True)
class Threshold:
    """One condition of a rule: ``holds(value)`` for a run whose parameter ``param`` has that value.

    It must be monotone: a row that fails at one value fails at all stricter ones. By default larger values are
    stricter. A rule is a list of thresholds, all of which have to hold; a condition that is NULL does not.
    """

    param: str
    holds: Callable[[Column], Column]
    larger_is_stricter: bool = True

    def values(self, runs: Sequence[dict]) -> list:
        """Different values of the parameter, loosest first."""
        return sorted({run[self.param] for run in runs}, reverse=not self.larger_is_stricter)

    def reach(self, values: list) -> Column:
        """How many of ``values`` the row triggers, found by bisection: they are the first ones."""
        levels = F.array(*map(F.lit, values))
        start = F.struct(F.lit(0).alias("low"), F.lit(len(values)).alias("high"))

        def bisect(at: Column, _: Column) -> Column:
            middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
            hit = F.coalesce(self.holds(F.try_element_at(levels, middle + 1)), F.lit(False))
            low = F.when(hit, middle + 1).otherwise(at["low"])
            high = F.when(hit, at["high"]).otherwise(middle)
            done = at["low"] >= at["high"]
            return F.struct(F.when(done, at["low"]).otherwise(low).alias("low"), F.when(done, at["high"]).otherwise(high).alias("high"))

        steps = F.sequence(F.lit(1), F.lit(len(values).bit_length()))
        return F.aggregate(steps, start, bisect, lambda at: at["low"])


class RunIndex:
    """Finds the runs that a row triggers without testing the others.

    Each threshold turns into the rank of a run's value, loosest first, and a row reaches the ranks below a number of its
    own. Runs are kept as a trie of their ranks, one level per threshold, whose nodes know the least rank that each
    later threshold has below them. A row unrolls its reach level by level and meets nodes by equality of parent and
    rank; nodes whose least ranks it does not reach are left at once. So each node a row visits leads to a run it triggers,
    or, where the grid is no full product, at least to one for each later threshold by itself.
    """

    def __init__(self, spark: SparkSession, runs: Sequence[dict], thresholds: Sequence[Threshold]):
        self.thresholds, self.small = list(thresholds), len(runs) <= BROADCAST_RUNS
        self.values = [t.values(runs) for t in self.thresholds]
        places = [{v: i for i, v in enumerate(vs)} for vs in self.values]
        ranks = [tuple(place[run[t.param]] for t, place in zip(self.thresholds, places)) for run in runs]
        names: dict[tuple, int] = {}
        least: dict[tuple, list[int]] = {}
        for rank in ranks:
            for i in range(len(rank) + 1):
                names.setdefault(rank[:i], len(names))
                below = least.setdefault(rank[:i], list(rank[i:]))
                below[:] = map(min, below, rank[i:])
        self.root = names.get((), 0)
        self.levels = []
        for i in range(len(self.thresholds)):
            nodes = [(names[k[:-1]], k[-1], n, least[k]) for k, n in names.items() if len(k) == i + 1]
            self.levels.append(spark.createDataFrame(nodes, "_node int, _rank int, _child int, _least array<int>"))
        # columns as a literal of the runs would have them: an axis of whole and broken numbers is one of broken ones
        shapes = list({tuple(map(type, run.values())): run for run in runs}.values())
        kind = spark.range(1).select(F.explode(grid_literal(shapes)).alias("_run")).schema["_run"].dataType
        broken = {f.name for f in kind.fields if f.dataType.simpleString() == "double"}
        leaves = [(names[rank], tuple(float(v) if k in broken and v is not None else v for k, v in run.items())) for rank, run in zip(ranks, runs)]
        self.runs = spark.createDataFrame(leaves, f"_node int, _run {kind.simpleString()}")

    def _meet(self, rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
        return rows.join(F.broadcast(side) if self.small else side, on)

    def triggered(self, rows: DataFrame) -> DataFrame:
        """Add ``_run``, one row for each run that a row triggers."""
        reach = [f"_reach{i}" for i in range(len(self.thresholds))]
        rows = rows.withColumns({c: t.reach(vs) for c, t, vs in zip(reach, self.thresholds, self.values)})
        for c in reach:
            rows = rows.where(F.col(c) > 0)
        rows = rows.withColumn("_node", F.lit(self.root))
        for i, level in enumerate(self.levels):
            unrolled = rows.withColumn("_rank", F.explode(F.sequence(F.lit(0), F.col(reach[i]) - 1)))
            met = self._meet(unrolled, level, ["_node", "_rank"])
            for j, c in enumerate(reach[i + 1 :]):
                met = met.where(F.col("_least")[j] < F.col(c))
            rows = met.drop("_node", "_rank", "_least").withColumnRenamed("_child", "_node")
        return self._meet(rows, self.runs, ["_node"]).drop("_node", *reach)


Rule = Callable[[Callable[[str], Column]], Column] | Sequence[Threshold]


def sweep_signals(
    table: DataFrame,
    runs: Sequence[dict],
    rule: Rule,
    price: Column | str = "close",
    weight: Column | float = 1.0,
    prefilter: Column | None = None,
) -> DataFrame:
    """Signals of every run: (params..., code, dt, order_price, weight).

    ``rule`` is a list of thresholds, which an index of the runs answers in work that follows the signals. Any other rule
    is a function: ``rule(p)`` gets ``p("name")`` for a parameter of the run, and each row is tested for each run of a
    literal, which suits a few dozen runs. ``prefilter`` drops rows that trigger in no run before that.
    """
    rows = table if prefilter is None else table.where(prefilter)
    price = price if isinstance(price, Column) else F.col(price)
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    rows = rows.withColumns({"_order_price": price, "_weight": weight})
    if callable(rule):
        matching = F.filter(grid_literal(runs), lambda run: rule(lambda name: run[name]))
        hits = rows.withColumn("_run", F.explode(matching))
    else:
        hits = RunIndex(table.sparkSession, runs, rule).triggered(rows)
    return hits.select("_run.*", CODE, DT, F.col("_order_price").alias("order_price"), F.col("_weight").alias("weight"))


def sweep(
    table: DataFrame,
    runs: Sequence[dict],
    rule: Rule,
    evaluate_signals: Callable[[DataFrame, DataFrame], DataFrame],
    **kwargs,
) -> DataFrame:
    """Signals of all runs, handed to ``evaluate_signals(signals, table)``, which groups by ``run_id``."""
    return evaluate_signals(sweep_signals(table, runs, rule, **kwargs), table)


def explode_run(runs: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Flatten the params and metrics maps (or JSON text) of run records; the old name ``success_rate`` is read as
    ``win_rate``."""
    kinds = dict(runs.dtypes)
    as_map = lambda c: F.from_json(c, "map<string,double>") if kinds[c] == "string" else F.col(c)
    p, m = as_map("params"), as_map("metrics")
    metric = lambda name: F.coalesce(F.element_at(m, name), F.element_at(m, "success_rate")) if name == "win_rate" else F.element_at(m, name)
    others = [c for c in runs.columns if c not in ("params", "metrics", "dataset_path")]
    return runs.select(
        *others, *[F.element_at(p, n).alias(n) for n in params], *[metric(n).alias(n) for n in metrics]
    )
