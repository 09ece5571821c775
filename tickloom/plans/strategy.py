"""A strategy: factors it needs, rules as Column expressions, hooks on whole DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import codes as C, scalar as S
from tickloom.operators import exits, filters, metrics, portfolio, rule_exits
from tickloom.operators.adjust import adjust_prices
from tickloom.operators.factors import BUILTIN, FactorBook, notna_columns, with_factors
from tickloom.operators.series import CODE, DT, POS
from tickloom.session import stored

Hook = Callable[[DataFrame], DataFrame]
Evaluator = Callable[[DataFrame, DataFrame], DataFrame]

#: Codes of trades that are looked up by a copy in every task.
FEW_CODES = 1_000_000


@dataclass(frozen=True)
class Fees:
    commission_pct: float = 0.05
    min_commission: float = 5.0
    stamp_duty_pct: float = 0.1


@dataclass(frozen=True)
class Slip:
    method: str = "max_pct"
    params: object = 0.02


class Params(dict):
    """Rule parameters by attribute: numbers become literals, names of sweep columns become those columns."""

    def __getattr__(self, name: str) -> Column:
        try:
            value = self[name]
        except KeyError:
            raise AttributeError(name) from None
        return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True)
class Strategy:
    """``should_buy`` and ``should_sell`` take (params) and return a Column condition over the factor table.

    ``factors`` names every factor the rules read. ``pre_process`` sees raw bars before adjustment,
    ``post_process`` the factor table. ``custom_params`` are visible to all rules.

    ``should_stop_loss`` and ``should_take_profit`` take (params) and return an ``ExitRule``, the price at which a position
    is sold on a bar; where one is missing, ``stop_loss`` and ``take_profit`` are levels in percent of the order price.
    """

    name: str
    factors: tuple[str, ...]
    should_buy: Callable[[Params], Column]
    should_sell: Callable[[Params], Column] | None = None
    should_stop_loss: Callable[[Params], rule_exits.ExitRule] | None = None
    should_take_profit: Callable[[Params], rule_exits.ExitRule] | None = None
    price: Callable[[Params], Column] = lambda p: F.col("close")
    weight: Callable[[Params], Column] = lambda p: F.lit(1.0)
    pre_process: Hook | None = None
    post_process: Hook | None = None
    stop_loss: float = 0.0
    take_profit: float = 0.0
    sl_tf_order: str = exits.SL_FIRST
    stop_loss_slip: Slip = Slip()
    take_profit_slip: Slip = Slip()
    max_position_opens: int = 10_000
    max_position_size: float = 1.0
    min_trade_amount: float = 0.0
    custom_params: dict = field(default_factory=dict)
    book: FactorBook = field(default=BUILTIN, compare=False)
    unit: str = "year"

    def with_params(self, **changes) -> "Strategy":
        """Known settings are replaced, all other names become custom parameters."""
        known = {k: v for k, v in changes.items() if k in self.__dataclass_fields__}
        extra = {k: v for k, v in changes.items() if k not in known}
        return replace(self, **known, custom_params={**self.custom_params, **extra})

    @property
    def params(self) -> Params:
        own = {"stop_loss": self.stop_loss, "take_profit": self.take_profit}
        return Params({**own, **self.custom_params})

    def factor_table(self, bars: DataFrame, adjust: DataFrame | None = None, max_abs_pct: float = 21.0) -> DataFrame:
        """Universe → adjusted prices → codes with impossible moves dropped → factors → rows complete."""
        rows = self.pre_process(bars) if self.pre_process else bars
        if adjust is not None and "orig_open" not in rows.columns:
            # read twice by the next step, so stored once; codes are dropped whole, so bar numbers stay right for the factors
            rows = stored(adjust_prices(rows, adjust, unit=self.unit, keep_pos=True), "adjusted")
            rows = filters.drop_suspect_codes(rows, max_abs_pct).select(*[c for c in rows.columns if c != POS], POS)
        rows = with_factors(rows, self.factors, self.book, unit=self.unit, keep_pos=True)
        rows = filters.drop_incomplete(rows, notna_columns(self.factors, self.book))
        return stored(self.post_process(rows) if self.post_process else rows, "factors")

    def signals(self, table: DataFrame, held: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
        p = self.params
        return filters.buy_signals(table, self.should_buy(p), self.price(p), self.weight(p), held, blacklist)

    def closing(self) -> Column:
        return F.lit(False) if self.should_sell is None else self.should_sell(self.params)

    def trades(self, table: DataFrame, signals: DataFrame, seed: int = 0, run_keys: tuple[str, ...] = ()) -> DataFrame:
        """One row per signal with its exit; exits at a level or by a rule are worsened by the slip."""
        how = dict(close=self.closing(), seed=seed, unit=self.unit, run_keys=run_keys)
        if self.should_stop_loss or self.should_take_profit:
            p = self.params
            stop = self.should_stop_loss(p) if self.should_stop_loss else rule_exits.stop_at(self.stop_loss)
            take = self.should_take_profit(p) if self.should_take_profit else rule_exits.take_at(self.take_profit)
            found = rule_exits.rule_exit(signals, table, stop, take, self.sl_tf_order, **how)
        else:
            found = exits.entry_exit(signals, table, self.stop_loss, self.take_profit, self.sl_tf_order, **how)
        return with_slippage(found, self.stop_loss_slip, self.take_profit_slip, seed, run_keys)

    def backtest(
        self,
        table: DataFrame,
        calendar: DataFrame,
        cash: float,
        fees: Fees = Fees(),
        lot: int = 100,
        seed: int = 0,
        blacklist: DataFrame | None = None,
        overlap: bool = False,
        budgets: DataFrame | None = None,
    ) -> dict[str, DataFrame]:
        """Signals → at most ``max_position_opens`` a day → sizes → exits → no overlap → trade log and capital log.

        ``budgets`` gives (dt, budget, total_assets). By default the days with signals share the cash, less the fees
        of spending it, in equal parts: entries can't overspend, whenever they close. Days do not share one running
        account, which would make the whole history one sequential task. Options that get no lot are dropped before
        overlaps are removed, so they block no later entry.
        """
        entries = stored(self.signals(table, blacklist=blacklist), "signals")
        sized = stored(self.size(entries, cash, lot, seed, fees, budgets), "sized")
        traded = self.bars_of(table, sized)
        found = self.trades(traded, sized, seed)
        sized = stored(found if overlap else exits.without_overlap(found), "kept")
        curve = portfolio.equity_curve(
            sized, traded, calendar, cash, fees.commission_pct, fees.min_commission, fees.stamp_duty_pct
        )
        return {"trades": sized, "log": portfolio.trade_log(sized), "capitals": curve}

    @staticmethod
    def bars_of(table: DataFrame, trades: DataFrame) -> DataFrame:
        """The rows of the codes that trade: exits and marks read no others, and days take few signals of many codes.

        With more than ``FEW_CODES`` of them, which are too many to send to every task, the table stays as it is."""
        codes = stored(trades.select(CODE).distinct(), "codes")
        return table.join(F.broadcast(codes), CODE, "left_semi") if codes.count() <= FEW_CODES else table

    def size(self, signals: DataFrame, cash: float, lot: int, seed: int = 0, fees: Fees = Fees(), budgets: DataFrame | None = None) -> DataFrame:
        if budgets is None:
            days = signals.select(DT).distinct()
            spent = max(0.0, cash / (1 + fees.commission_pct / 100))
            share = F.greatest(F.lit(0.0), F.lit(spent) / F.lit(max(1, days.count())) - F.lit(float(fees.min_commission)))
            budgets = days.select(DT, share.alias("budget"), F.lit(float(cash)).alias("total_assets"))
        capped = portfolio.cap_portfolio(signals, budgets, self.max_position_opens, self.max_position_size, seed)
        sized = portfolio.allocate_budget(capped, self.max_position_opens, self.min_trade_amount, lot, seed=seed)
        return sized.drop("budget", "lots")


def with_slippage(trades: DataFrame, stop: Slip, take: Slip, seed: int = 0, run_keys: tuple[str, ...] = ()) -> DataFrame:
    """Worsen stop-loss and take-profit prices; closing at the close has no slip. Runs draw apart by ``run_keys``."""
    orig = "exit_orig_open" if "exit_orig_open" in trades.columns else "exit_price"
    u = S.uniform(CODE, DT, "exit_dt", *run_keys, seed=seed)
    slipped = lambda s: S.slippage("exit_price", s.method, s.params, orig, u)
    price = (
        F.when(F.col("action") == C.STOP_LOSS, slipped(stop))
        .when(F.col("action") == C.TAKE_PROFIT, slipped(take))
        .otherwise(F.col("exit_price"))
    )
    return trades.withColumn("exit_price", price).drop("exit_orig_open")


def basic_evaluator(trades: DataFrame, capitals: DataFrame) -> DataFrame:
    return metrics.evaluate(trades, capitals)


def run_evaluator(trades: DataFrame, capitals: DataFrame, evaluator: Evaluator = basic_evaluator, run_id: str = "run") -> DataFrame:
    """Evaluate one backtest with any callable on (trades, capitals); both get the run's id."""
    tag = lambda df: df if "run_id" in df.columns else df.withColumn("run_id", F.lit(run_id))
    return evaluator(tag(trades), tag(capitals))


def crossing_up(fast: str, slow: str, fast_before: str, slow_before: str) -> Column:
    return (F.col(fast) > F.col(slow)) & (F.col(fast_before) < F.col(slow_before))


