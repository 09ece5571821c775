"""Picking, sizing, logging and marking of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions import codes, orders as O, scalar as S
from tickloom.operators.asof import asof_join
from tickloom.operators.series import CODE, DT, bucket_of, running
from tickloom.session import stored


def weighted_pick(
    signals: DataFrame, k: Column | int, weight: str = "weight", seed: int = 0, by: tuple[str, ...] = (DT,), key: str = CODE
) -> DataFrame:
    """At most ``k`` signals per day, drawn without replacement with probability by weight.

    The key -ln(u)/w of Efraimidis and Spirakis makes it a plain smallest-k, which Spark limits per task before
    the shuffle when ``k`` is a number.
    """
    draw = F.try_divide(-F.ln(S.uniform(*by, key, seed=seed)), F.col(weight))
    w = Window.partitionBy(*by).orderBy(F.col("_draw").asc_nulls_last(), key)
    ranked = signals.withColumn("_draw", draw).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= k).drop("_draw", "_rank")


def cap_portfolio(
    signals: DataFrame, budgets: DataFrame, max_opens: int, max_size: float, seed: int = 0, by: tuple[str, ...] = (DT,)
) -> DataFrame:
    """Pick at most ``max_opens`` signals a day and add the day's budget: when an equal whole share of it exceeds
    ``max_size`` of all assets, it is cut to that bound per signal.

    ``budgets`` has (by..., budget, total_assets), one row per day.
    """
    picked = weighted_pick(signals, max_opens, seed=seed, by=by)
    counts = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    bound = F.lit(float(max_size)) * F.col("total_assets")
    capped = F.when(F.floor(F.col("budget") / F.col("_n")) > bound, F.col("_n") * bound).otherwise(F.col("budget"))
    limits = counts.join(budgets, list(by)).select(*by, capped.alias("budget"))
    return picked.join(limits, list(by))


def _distribute(options: Column, budget: Column, lot: float) -> Column:
    """Whole lots per option: an equal split first, the rest spent in row order."""
    n = F.size(options).cast("double")
    share = F.floor(budget / n)
    base = F.transform(options, lambda o: F.floor(F.try_divide(share, o["price"] * F.lit(lot))).cast("double"))
    with_base = F.zip_with(options, base, lambda o, b: F.struct((o["price"] * F.lit(lot)).alias("ticket"), b.alias("lots")))
    spent = F.aggregate(with_base, F.lit(0.0), lambda acc, o: acc + o["ticket"] * o["lots"])
    start = F.struct((budget - spent).alias("rest"), F.array().cast("array<double>").alias("lots"))

    def spend(acc, o):
        more = F.greatest(F.floor(F.try_divide(acc["rest"], o["ticket"])), F.lit(0)).cast("double")
        return F.struct(
            (acc["rest"] - more * o["ticket"]).alias("rest"), F.concat(acc["lots"], F.array(o["lots"] + more)).alias("lots")
        )

    return F.aggregate(with_base, start, spend, lambda acc: acc["lots"])


def allocate_budget(
    signals: DataFrame,
    max_opens: int,
    min_trade: float,
    lot: float = 100.0,
    budget: str = "budget",
    by: tuple[str, ...] = (DT,),
    order: str = CODE,
    seed: int = 0,
) -> DataFrame:
    """Add ``lots`` and ``vol``: an equal split of the day's budget into whole lots, the rest spent in row order.

    While the smallest ticket is below ``min_trade`` one option is dropped (by repeatable draw) and the split is
    done again. ``signals`` must hold at most ``max_opens`` rows per day, as ``cap_portfolio`` leaves them, so a
    day is a short array; a day that holds more fails the job rather than being cut.
    """
    option = F.struct(F.col(order).alias("key"), F.col("order_price").alias("price"), S.uniform(*by, order, seed=seed).alias("draw"))
    days = signals.groupBy(*by, F.col(budget).alias("_budget")).agg(F.sort_array(F.collect_list(option)).alias("_options"))
    too_many = F.raise_error(F.concat(F.lit("more signals than max_opens: "), F.size("_options").cast("string")))
    days = days.withColumn("_options", F.when(F.size("_options") <= max_opens, F.col("_options")).otherwise(too_many))
    # the drop order is fixed by the draws, so the state after i drops is the options whose draw rank is >= i
    drops = F.sequence(F.lit(0), F.size("_options") - 1)
    by_draw = F.array_sort(F.transform("_options", lambda o: o["draw"]))

    def attempt(i: Column) -> Column:
        kept = F.filter("_options", lambda o: o["draw"] >= F.element_at(by_draw, i + 1))
        lots = _distribute(kept, F.col("_budget"), float(lot))
        return F.zip_with(kept, lots, lambda o, n: F.struct(o["key"].alias("key"), o["price"].alias("price"), n.alias("lots")))

    def settle(best: Column, i: Column) -> Column:
        return F.when(F.size(best) > 0, best).otherwise(
            F.when(
                F.array_min(F.transform(attempt(i), lambda o: o["price"] * F.lit(float(lot)) * o["lots"])) >= F.lit(float(min_trade)),
                attempt(i),
            ).otherwise(best)
        )

    none = F.array().cast(f"array<struct<key:{signals.schema[order].dataType.simpleString()},price:double,lots:double>>")
    plans = days.withColumn("_plan", F.aggregate(drops, none, settle))
    chosen = plans.select(*by, F.explode("_plan").alias("_p")).select(
        *by, F.col("_p.key").alias(order), F.col("_p.lots").cast("bigint").alias("lots")
    )
    sized = signals.join(chosen, [*by, order]).where(F.col("lots") > 0)
    return sized.withColumn("vol", (F.col("lots") * F.lit(int(lot))).cast("bigint"))


def buy_log(entries: DataFrame) -> DataFrame:
    """Trade-log rows of openings: (code, dt, order_price, vol) → OPEN."""
    positions = entries.select(
        "*",
        F.concat_ws("-", F.col(CODE).cast("string"), F.col(DT).cast("string")).alias("id"),
        F.col("order_price").alias("price"),
        F.col("order_price").alias("latest_price"),
    )
    return positions.select(*O.trade_log_row(DT, codes.OPEN, vol="vol"))


def sell_log(trades: DataFrame) -> DataFrame:
    """Trade-log rows of exits: (code, dt, order_price, vol, exit_dt, exit_price, action)."""
    closed = trades.where(F.col("exit_dt").isNotNull()).select(
        "*",
        F.concat_ws("-", F.col(CODE).cast("string"), F.col(DT).cast("string")).alias("id"),
        F.col("order_price").alias("price"),
        F.col("exit_price").alias("latest_price"),
    )
    return closed.select(*O.trade_log_row("exit_dt", F.col("action"), vol="vol"))


def trade_log(trades: DataFrame) -> DataFrame:
    return buy_log(trades).unionByName(sell_log(trades))


def cash_flows(trades: DataFrame, rate_pct: float, minimum: float, stamp_pct: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., dt, flow): net cash per day. Fees are taken on the day's total bought and the day's total sold."""
    bought = trades.select(*by, F.col(DT), S.cost("order_price", "vol").alias("buy"), F.lit(None).cast("double").alias("sell"))
    sold = trades.where(F.col("exit_dt").isNotNull()).select(
        *by, F.col("exit_dt").alias(DT), F.lit(None).cast("double").alias("buy"), (F.col("exit_price") * F.col("vol")).alias("sell")
    )
    daily = bought.unionByName(sold).groupBy(*by, DT).agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))
    paid = F.when(F.col("buy") > 0, S.buy_total("buy", rate_pct, minimum)).otherwise(F.lit(0.0))
    got = F.when(F.col("sell") > 0, S.sell_net("sell", rate_pct, minimum, stamp_pct)).otherwise(F.lit(0.0))
    return daily.select(*by, DT, (got - paid).alias("flow"))


def holding_changes(trades: DataFrame, bars: DataFrame, until: DataFrame, by: tuple[str, ...] = (), unit: str = "year") -> DataFrame:
    """(by..., dt, cents): by how many cents the value of all holdings changes on a day.

    A trade counts from its entry day until the day before its exit: at its order price before the first later bar of
    its code, then at the code's last close. An event sweep: the order-price part is a plus on the entry day and a minus
    when it ends. The rest is a plus and a minus of volume, netted per code and day; the code's running volume meets its
    closes in one pass, in which a change of either changes the value. So a bar is seen once per (by..., code) that
    holds something in the bar's calendar bucket, however many trades are open and however long they stay so. Values
    are whole cents, so sums don't depend on their order; a code's value is rounded, which for prices in cents is exact.

    ``until`` has one row with the last day to log, ``_end``. A code and bucket is one unit of work.
    """
    held = trades.where((F.col("vol") > 0) & (F.col("exit_dt").isNull() | (F.col("exit_dt") > F.col(DT))))
    held = held.select(*by, CODE, DT, "order_price", "vol", "exit_dt")
    closes = bars.where(F.col("close").isNotNull()).select(CODE, DT, "close")
    first = closes.select(CODE, F.col(DT).alias("_bar_dt"), F.col(DT).alias("_first"))
    # a record's value is its own day, so records of one day are alike
    held = stored(asof_join(held, first, ["_first"], right_on="_bar_dt", direction="forward", allow_exact=False, unit=unit, alike=True), "held")

    entered = F.rint(F.col("order_price") * F.col("vol") * F.lit(100.0)).cast("bigint")
    left = F.least("_first", "exit_dt")
    at_order_price = held.select(*by, F.col(DT), entered.alias("cents")).unionByName(
        held.where(left.isNotNull()).select(*by, left.alias(DT), (-entered).alias("cents")))

    marked = held.where(F.col("_first").isNotNull() & (F.col("exit_dt").isNull() | (F.col("_first") < F.col("exit_dt"))))
    volume = F.col("vol").cast("double")
    events = marked.select(*by, CODE, F.col("_first").alias(DT), volume.alias("_volume")).unionByName(
        marked.where(F.col("exit_dt").isNotNull()).select(*by, CODE, F.col("exit_dt").alias(DT), (-volume).alias("_volume")))
    # the buckets from a trade's first bar to its end, once per code however many trades they hold
    key = [*by, CODE, "_bucket"]
    last = F.coalesce(bucket_of("exit_dt", unit), F.greatest(bucket_of("_end", unit), bucket_of("_first", unit)))
    spans = marked.join(F.broadcast(until)).select(*by, CODE, bucket_of("_first", unit).alias("_from"), last.alias("_to")).distinct()
    active = spans.select(*by, CODE, F.explode(F.sequence("_from", "_to")).alias("_bucket")).distinct()
    prices = closes.withColumn("_bucket", bucket_of(DT, unit)).join(active, [CODE, "_bucket"])
    points = events.withColumn("_bucket", bucket_of(DT, unit)).unionByName(prices, allowMissingColumns=True)
    points = points.groupBy(*key, DT).agg(F.sum("_volume").alias("_volume"), F.max("close").alias("close"))
    points = stored(points.withColumn("_volume", F.coalesce("_volume", F.lit(0.0))), "points")

    # what a bucket starts with: volume and close of the buckets before it
    ends = points.groupBy(*key).agg(F.sum("_volume").alias("_sum"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col(DT))).alias("_close"))
    before = Window.partitionBy(*by, CODE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_held"), F.last("_close", ignorenulls=True).over(before).alias("_known"))
    inside = Window.partitionBy(*key).orderBy(DT)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    value = lambda volume, price: F.coalesce(F.rint(volume * price * F.lit(100.0)).cast("bigint"), F.lit(0).cast("bigint"))
    now = value(F.col("_held") + F.sum("_volume").over(so_far), F.coalesce(F.last("close", ignorenulls=True).over(so_far), F.col("_known")))
    swept = points.join(starts, key).withColumn("_now", now)
    change = F.col("_now") - F.coalesce(F.lag("_now").over(inside), value(F.col("_held"), F.col("_known")))
    at_close = swept.withColumn("cents", change).where(F.col("cents") != 0).select(*by, DT, "cents")
    return at_order_price.unionByName(at_close).groupBy(*by, DT).agg(F.sum("cents").alias("cents"))


def equity_curve(
    trades: DataFrame,
    bars: DataFrame,
    calendar: DataFrame,
    initial_cash: float,
    rate_pct: float = 0.05,
    minimum: float = 5.0,
    stamp_pct: float = 0.1,
    by: tuple[str, ...] = (),
    runs: DataFrame | None = None,
) -> DataFrame:
    """Capital log per day (and run): free cash after all flows so far plus holdings at the last known close.

    ``trades`` holds (by..., code, dt, order_price, vol, exit_dt, exit_price); ``runs`` lists the runs to log, also those
    that never trade, by default those of the trades. The running sums are over one row
    per day; those of the holdings are over the days on which their value changes.
    """
    # read by the flows, the marks and the runs
    trades = stored(trades.select(*by, CODE, DT, "order_price", "vol", "exit_dt", "exit_price"), "trades")
    flows = cash_flows(trades, rate_pct, minimum, stamp_pct, by)
    end = calendar.agg(F.max("dt").alias("_end"))
    changes = holding_changes(trades, bars, end, by)
    if by:
        # every run logs every trade day: unroll the day numbers, then look the days up
        last = calendar.agg(F.max("idx").alias("_end"))
        runs = (trades if runs is None else runs).select(*by).distinct().join(F.broadcast(last))
        days = runs.select(*by, F.explode(F.sequence(F.lit(1).cast("bigint"), "_end")).alias("idx")).join(calendar, "idx").drop("idx")
    else:
        days = calendar.select("dt")
    keys = [*by, DT]
    logged = days.join(flows, keys, "left").withColumn("_logged", F.lit(True))
    # holdings may also change between the days that are logged
    series = logged.unionByName(changes, allowMissingColumns=True).withColumn("_series", F.concat_ws("|", F.lit("run"), *[F.col(b).cast("string") for b in by]))
    series = series.groupBy("_series", *keys).agg(F.max("_logged").alias("_logged"), F.sum("flow").alias("flow"), F.sum("cents").alias("cents"))
    sums = {"_flow": ("sum", F.coalesce("flow", F.lit(0.0))), "_cents": ("sum", F.coalesce("cents", F.lit(0).cast("bigint")))}
    summed = running(series, sums, key="_series", order=DT).where("_logged")
    return summed.select(
        *by,
        DT,
        (F.col("_cents") / F.lit(100.0)).alias("market_value"),
        (F.lit(float(initial_cash)) + F.col("_flow")).alias("free_cash_amount"),
        F.lit(0.0).alias("frozen_cash_amount"),
    )


def market_value(positions: DataFrame, price: str = "latest_price") -> DataFrame:
    return positions.agg(F.coalesce(F.sum(S.value_at(price, "vol")), F.lit(0.0)).alias("market_value"))


def total_assets(account: DataFrame) -> DataFrame:
    total = F.col("market_value") + F.col("free_cash_amount") + F.col("frozen_cash_amount")
    return account.withColumn("total_asset_value", total)


def net_pct_return(trades: DataFrame, rate_pct: float, minimum: float, stamp_pct: float) -> DataFrame:
    value = S.net_return("order_price", "exit_price", "vol", rate_pct, minimum, stamp_pct)
    return trades.withColumn("net_pct_return", value)


def opened_today(orders: DataFrame, max_opens: int) -> DataFrame:
    """One row: buys so far and opens that remain."""
    return orders.agg(F.count_if(F.col("direction") == "buy").alias("n_bought")).select(
        "n_bought", F.greatest(F.lit(0).cast("bigint"), F.lit(max_opens) - F.col("n_bought")).alias("remaining_opens")
    )
