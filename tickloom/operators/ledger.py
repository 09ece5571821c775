"""Orders, positions and the account of a trading day, rebuilt from order records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes, orders as O, scalar as S
from tickloom.operators.series import CODE


def _sum(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0))


def positions_from_orders(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Volumes of each position: overnight + filled buys - filled sells; available: overnight - placed sells +
    cancelled sells. ``invalid`` flags a negative volume. Orders are reduced per code before the join."""
    totals = orders.groupBy(CODE).agg(
        _sum(F.col("filled_vol"), O.is_buy()).alias("_bought"),
        _sum(F.col("filled_vol"), O.is_sell()).alias("_sold"),
        _sum(F.col("vol"), O.is_sell()).alias("_placed"),
        _sum(O.cancelled_vol(), O.is_sell()).alias("_cancelled"),
    )
    zero = F.lit(0).cast("bigint")
    joined = positions.join(totals, CODE, "left")
    vol = F.col("yesterday_vol") + F.coalesce("_bought", zero) - F.coalesce("_sold", zero)
    avail = F.col("yesterday_vol") - F.coalesce("_placed", zero) + F.coalesce("_cancelled", zero)
    sized = joined.withColumns({"vol": vol, "avail_vol": avail}).drop("_bought", "_sold", "_placed", "_cancelled")
    return sized.withColumn("invalid", (F.col("vol") < 0) | (F.col("avail_vol") < 0))


def account_assets(orders: DataFrame, positions: DataFrame, opening: DataFrame) -> DataFrame:
    """One row: free and frozen cash after all orders, market value of the positions.

    ``opening`` is one row with free_cash_amount. All three inputs are single aggregated rows when they meet.
    """
    buy = orders.agg(
        _sum(O.placed_value(), O.is_buy()).alias("_placed"),
        _sum(O.cancelled_value(), O.is_buy()).alias("_cancelled"),
        _sum(O.filled_value(), O.is_buy()).alias("_filled"),
        _sum(O.filled_value(), O.is_sell()).alias("_sold"),
    )
    held = positions.agg(F.coalesce(F.sum(S.value_at("latest_price", "vol")), F.lit(0.0)).alias("market_value"))
    start = opening.agg(F.first("free_cash_amount").alias("_opening"))
    one = start.join(F.broadcast(buy)).join(F.broadcast(held))
    free = F.col("_opening") - F.col("_placed") + F.col("_cancelled") + F.col("_sold")
    frozen = F.col("_placed") - F.col("_filled") - F.col("_cancelled")
    return one.select(
        free.alias("free_cash_amount"),
        frozen.alias("frozen_cash_amount"),
        "market_value",
        ((free < 0) | (frozen < 0)).alias("invalid"),
    )


def expired_orders(orders: DataFrame, ask_bid: DataFrame, now, ttl: float, code: str = CODE) -> DataFrame:
    """Pending orders at least ``ttl`` seconds old whose price is not the best of their side.

    ``ask_bid`` has (code, buy, sell) ladders, best price first. A ``ttl`` of 0 or less means no expiry.
    """
    if ttl <= 0:
        return orders.where(F.lit(False))
    pending = orders.where(O.is_open())
    old = pending.where(O.age_seconds(now) >= F.lit(float(ttl)))
    best = ask_bid.select(code, F.get("buy", F.lit(0)).alias("_buy1"), F.get("sell", F.lit(0)).alias("_sell1"))
    queue = F.when(O.is_buy(), F.col("_buy1")).otherwise(F.col("_sell1"))
    joined = old.join(best, code).where(~F.coalesce(F.col("price") == queue, F.lit(False)))
    return joined.select(*orders.columns)


def classify_closed(positions: DataFrame, sell_orders: DataFrame, divide: bool = True) -> DataFrame:
    """What the day's changed positions were: new → OPEN; closed → the action in the remark of its sell order.

    The entry price is derived back from the remark: price / (1 + pct/100), or price × (1 - pct/100) with
    ``divide=False``. ``problem`` tells of zero or several sell orders, or a remark that cannot be read.
    """
    remark = O.parse_sell_remark("remark")
    per_code = sell_orders.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("_n"), F.min("remark").alias("remark"), F.min("filled_price").alias("_sold_at")
    )
    joined = positions.join(per_code.withColumn("_remark", remark), CODE, "left")
    n, parsed = F.coalesce("_n", F.lit(0)), F.col("_remark")
    pct = parsed["pct_chg"] * F.lit(1e-2)
    entry = parsed["price"] / (F.lit(1.0) + pct) if divide else parsed["price"] * (F.lit(1.0) - pct)
    closed = S.is_closed() & ~S.is_new()
    good = closed & (n == 1) & parsed.isNotNull()
    problem = (
        F.when(closed & (n == 0), F.lit("no sell order"))
        .when(closed & (n > 1), F.lit("several sell orders"))
        .when(closed & parsed.isNull(), F.lit("no readable remark"))
    )
    changed = joined.where(S.is_new() | closed)
    return changed.select(
        *[c for c in positions.columns if c not in ("price", "latest_price")],
        F.when(good, entry).otherwise(F.col("price")).alias("price"),
        F.when(good, F.col("_sold_at")).otherwise(F.col("latest_price")).alias("latest_price"),
        F.when(S.is_new(), F.lit(codes.OPEN)).when(good, parsed["action"]).alias("action"),
        problem.alias("problem"),
    )


def exposure_check(orders: DataFrame, account: DataFrame, positions: DataFrame) -> dict[str, DataFrame]:
    """Will the orders be covered?

    ``cash``: one row with the buy total against free cash and the cash left after accepted buys (all or none).
    ``sells``: every sell order of a held code with the volume left to it; orders are served in order of time
    and id, and one that exceeds what is left takes nothing. ``volumes``: available volume per code after accepted sells.
    """
    buys = orders.where(O.is_buy()).agg(F.coalesce(F.sum(S.rounded("price") * F.col("vol")), F.lit(0.0)).alias("buy_total"))
    cash = account.agg(F.first("free_cash_amount").alias("free"), F.first("frozen_cash_amount").alias("frozen"))
    accepted = F.col("buy_total") <= F.col("free")
    taken = F.when(accepted, F.col("buy_total")).otherwise(F.lit(0.0))
    money = cash.join(F.broadcast(buys)).select(
        "buy_total",
        accepted.alias("accepted"),
        (F.col("free") - taken).alias("free_cash_amount"),
        (F.col("frozen") + taken).alias("frozen_cash_amount"),
    )

    # a code whose sells fit in total needs no order by order check
    sells = orders.where(O.is_sell())
    demand = sells.groupBy(CODE).agg(F.sum("vol").alias("_demand"))
    held = positions.select(CODE, F.col("avail_vol").alias("_avail")).join(demand, CODE)
    served = sells.join(held, CODE)
    fits = F.col("_demand") <= F.col("_avail")
    easy = served.where(fits).select(*orders.columns, F.lit(True).alias("accepted"))
    hard = greedy_sells(served.where(~fits).drop("_demand"), orders.columns)
    checked = easy.unionByName(hard)
    used = checked.groupBy(CODE).agg(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("vol"))), F.lit(0)).alias("_used"))
    volumes = positions.join(used, CODE, "left").withColumn(
        "avail_vol", F.col("avail_vol") - F.coalesce("_used", F.lit(0).cast("bigint"))
    )
    return {"cash": money, "sells": checked, "volumes": volumes.drop("_used")}


def greedy_sells(sells: DataFrame, columns: list[str]) -> DataFrame:
    """Serve sells of over-asked codes in order of time and id, skipping what no longer fits.

    Whether an order fits depends on every earlier order of its code, so each code is walked once, in order. The rows
    stream through the task batch by batch: memory holds one batch and what is left of the current code.
    """
    ordered = sells.repartition(CODE).sortWithinPartitions(CODE, "timestamp", "id").select(CODE, "id", "vol", "_avail")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for batch in batches:
            accepted = []
            for code, vol, avail in zip(batch[CODE], batch["vol"], batch["_avail"]):
                if code != current:
                    current, left = code, avail
                accepted.append(bool(vol <= left))
                left -= vol if accepted[-1] else 0
            yield batch[["id"]].assign(accepted=accepted)

    served = ordered.mapInPandas(serve, f"id {kinds['id']}, accepted boolean")
    return sells.join(served, "id").select(*columns, "accepted")
