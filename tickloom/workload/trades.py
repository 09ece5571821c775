"""Entries, exits, portfolio, equity, metrics and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import scalar as S
from tickloom.operators import exits, factors as X, filters, joins, metrics as M, portfolio as P
from tickloom.operators.factors import extended
from tickloom.operators.rule_exits import ExitRule
from tickloom.operators.series import CODE, DT
from tickloom.plans import sweep
from tickloom.plans.strategy import Fees, Slip, Strategy, run_evaluator, with_slippage
from tickloom.session import stored
from tickloom.workload.lookups import SIGNAL_SQL, _signal_table, pct_sql, stop_sql, take_sql
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, u, with_views


# -- signals and exits: buy at or under the lower band, close at or over the upper one ------------------------------


def _table(v: Views) -> DataFrame:
    """The factor table of a query, stored with its bar numbers: signals, exits and marks read it."""
    if not hasattr(v, "stored_signal_table"):
        v.stored_signal_table = stored(_signal_table(v, keep_pos=True), "signal-table")
    return v.stored_signal_table


def _signals(v: Views) -> tuple[DataFrame, DataFrame]:
    table = _table(v)
    weight = (F.col(CODE) % 3 + 1).cast("double")
    return table, filters.buy_signals(table, F.col("close") <= F.col("boll_lower"), weight=weight)


SIG = SIGNAL_SQL + ", sig AS (SELECT code, dt, close AS order_price, CAST(code%3+1 AS DOUBLE) AS weight FROM fx WHERE close<=boll_lower)"


def trades_sql(prefer_stop: str = "true", sl: str = "3e0", tp: str = "4e0", sig: str = "sig", out: str = "tr") -> str:
    """Independent exits by looking at every later bar of the code."""
    return f""", {out}_h AS MATERIALIZED (SELECT s.code, s.dt, s.order_price, b.dt AS exit_dt, b.close, b.close>=b.boll_upper AS cs,
  {stop_sql('s.order_price', sl, 'b.open', 'b.low')} AS st, {take_sql('s.order_price', tp, 'b.open', 'b.high')} AS tk
  FROM {sig} s JOIN fx b ON b.code=s.code AND b.dt>s.dt),
{out}_f AS MATERIALIZED (SELECT * FROM {out}_h WHERE st IS NOT NULL OR tk IS NOT NULL OR cs QUALIFY row_number() OVER (PARTITION BY code, dt ORDER BY exit_dt)=1),
{out}_a AS MATERIALIZED (SELECT *, CASE WHEN st IS NOT NULL AND (tk IS NULL OR {prefer_stop}) THEN 'STOP_LOSS' WHEN tk IS NOT NULL THEN 'TAKE_PROFIT' WHEN cs THEN 'CLOSE' END AS action FROM {out}_f),
{out} AS (SELECT s.code, s.dt, s.order_price, s.weight, a.exit_dt, CASE a.action WHEN 'STOP_LOSS' THEN st WHEN 'TAKE_PROFIT' THEN tk WHEN 'CLOSE' THEN close END AS exit_price, a.action
  FROM {sig} s LEFT JOIN {out}_a a ON a.code=s.code AND a.dt=s.dt)"""


TRADE_COLUMNS = "code, dt, order_price, weight, exit_dt, exit_price, action"
COIN = f"{u('code', 'dt', 'exit_dt', seed=5)}<=0.5e0"

for _policy, _sql in ((exits.SL_FIRST, "true"), (exits.TP_FIRST, "false"), (exits.RANDOM, COIN)):
    query(
        "entry_exit_" + _policy.replace(" ", "_"),
        with_views("bars", body=SIG + trades_sql(_sql, "1e0", "1e0") + f"SELECT {TRADE_COLUMNS} FROM tr"),
    )(
        lambda v, policy=_policy: exits.entry_exit(
            _signals(v)[1], _signals(v)[0], 1.0, 1.0, policy, close=F.col("close") >= F.col("boll_upper"), seed=5
        )
    )


def _trades(v: Views) -> DataFrame:
    table, signals = _signals(v)
    return exits.entry_exit(signals, table, 3.0, 4.0, close=F.col("close") >= F.col("boll_upper"))


NEXT = ", nx AS (SELECT t.code, t.dt, min(s.dt) AS nxt FROM tr t JOIN tr s ON s.code=t.code AND s.dt>t.exit_dt GROUP BY ALL)"
CHAIN = NEXT + """, ch AS (SELECT code, min(dt) AS dt FROM tr GROUP BY code UNION ALL SELECT ch.code, nx.nxt FROM ch JOIN nx ON nx.code=ch.code AND nx.dt=ch.dt),
held AS (SELECT tr.* FROM tr JOIN ch USING (code, dt))"""


@query("entry_exit_without_overlap", with_views("bars", body=SIG + trades_sql() + CHAIN + f"SELECT {TRADE_COLUMNS} FROM held", recursive=True))
def _no_overlap(v: Views) -> DataFrame:
    return exits.without_overlap(_trades(v))


@query(
    "first_touch",
    with_views("minute", body=""", s AS (SELECT code, dt, avg(close) AS order_price FROM minute GROUP BY code, dt)
SELECT s.code, s.dt, round_even(s.order_price*1e6,0)/1e6 AS order_price, min(m.time) AS time FROM s JOIN minute m USING (code, dt)
WHERE ((order_price-low>1e-4) OR abs(order_price-low)<1e-4) AND ((high-order_price>1e-4) OR abs(order_price-high)<1e-4) GROUP BY ALL"""),
)
def _first_touch(v: Views) -> DataFrame:
    signals = v.minute.groupBy(CODE, DT).agg(F.avg("close").alias("order_price"))
    return exits.first_touch(v.minute, signals).withColumn("order_price", S.rounded("order_price", 6))


@query(
    "minute_exit",
    with_views("minute", body=f""", pos AS (SELECT code, dt AS entry_dt, max(close) AS price FROM minute WHERE code%3<>0 GROUP BY code, dt),
h AS (SELECT p.code, p.entry_dt, p.price, m.dt, m.time, {take_sql('p.price', '150e0', 'm.open', 'm.high')} AS tk, {stop_sql('p.price', '90e0', 'm.open', 'm.low')} AS st
  FROM pos p JOIN minute m ON m.code=p.code AND m.dt>p.entry_dt),
f AS (SELECT * FROM h WHERE tk IS NOT NULL OR st IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, entry_dt ORDER BY dt, time)=1)
SELECT p.code, p.entry_dt, p.price, f.dt AS exit_dt, f.time AS exit_time, coalesce(tk, st) AS exit_price,
CASE WHEN tk IS NOT NULL THEN 'TAKE_PROFIT' WHEN st IS NOT NULL THEN 'STOP_LOSS' END AS action FROM pos p LEFT JOIN f USING (code, entry_dt)"""),
)
def _minute_exit(v: Views) -> DataFrame:
    held = v.minute.where(F.col(CODE) % 3 != 0).groupBy(CODE, F.col(DT).alias("entry_dt")).agg(F.max("close").alias("price"))
    return exits.minute_exit(held, v.minute, 90.0, 150.0)


# -- slippage ----------------------------------------------------------------------------------------------------------

SLIPS = {
    "max_jump": (2, lambda x, n: f"{x}*(1e0-(1e-2/open)*least(CAST(floor({n}*3e0) AS BIGINT),2))"),
    "max_pct": (0.5, lambda x, n: f"{x}*(1e0-{n}*5e-3)"),
    "weibull": (
        {"shape": 1.25, "scale": 0.1, "shift": -0.025},
        lambda x, n: f"{x}*(1e0-(1e-1*pow(-ln(1e0-{n}),8e-1)+(-25e-3))*1e-2)",
    ),
}

for _method, (_params, _form) in SLIPS.items():
    query(
        f"slippage_{_method}",
        with_views("bars", body=f"SELECT code, dt, {r(_form('close', u('code', 'dt', seed=2)), 8)} AS price FROM bars"),
    )(
        lambda v, m=_method, q=_params: v.bars.select(
            CODE, DT, S.rounded(S.slippage("close", m, q, "open", S.uniform(CODE, DT, seed=2)), 8).alias("price")
        )
    )


@query(
    "live_slippage",
    with_views("bars", body=f"SELECT code, dt, close*(1e0-2e-3) AS live, {r('close*(1e0-' + u('code', 'dt') + '*2e-3)', 8)} AS paper FROM bars"),
)
def _live_slip(v: Views) -> DataFrame:
    paper = S.live_slippage("close", 0.2, paper=True, u=S.uniform(CODE, DT))
    return v.bars.select(CODE, DT, S.live_slippage("close", 0.2).alias("live"), S.rounded(paper, 8).alias("paper"))


# -- picking and sizing --------------------------------------------------------------------------------------------------

PICK = f", pk AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY dt ORDER BY -ln({u('dt', 'code', seed=7)})/weight, code)<=3)"


@query("weighted_pick", with_views("bars", body=SIG + PICK + "SELECT * FROM pk"))
def _pick(v: Views) -> DataFrame:
    return P.weighted_pick(_signals(v)[1], 3, seed=7)


def _budgets(v: Views) -> DataFrame:
    return v.calendar.select(DT, (F.lit(50_000.0) + F.col("idx") * 10).alias("budget"), F.lit(60_000.0).alias("total_assets"))


BUDGET = """, bg AS (SELECT dt, 5e4+idx*10 AS budget, 6e4 AS total_assets FROM calendar),
cp AS (SELECT pk.*, CASE WHEN floor(bg.budget/n)>0.25e0*total_assets THEN n*(0.25e0*total_assets) ELSE bg.budget END AS budget
  FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n FROM pk) pk JOIN bg USING (dt))"""


@query("cap_portfolio", with_views("bars", "calendar", body=SIG + PICK + BUDGET + "SELECT code, dt, order_price, weight, budget FROM cp"))
def _cap(v: Views) -> DataFrame:
    return P.cap_portfolio(_signals(v)[1], _budgets(v), 3, 0.25, seed=7)


ALLOCATE = f""", o1 AS (SELECT code, dt, order_price, weight, budget, order_price*1e2 AS ticket, n,
  row_number() OVER (PARTITION BY dt ORDER BY {u('dt', 'code', seed=1)}) AS dr FROM cp),
tries AS (SELECT o1.*, t.i FROM o1, (SELECT unnest(range(0,3)) AS i) t WHERE t.i<o1.n AND o1.dr>t.i),
base AS (SELECT *, floor(floor(budget/count(*) OVER (PARTITION BY dt, i))/ticket) AS lots0, row_number() OVER (PARTITION BY dt, i ORDER BY code) AS k FROM tries),
spend AS (SELECT dt, i, 0 AS k, any_value(budget)-sum(ticket*lots0) AS rest, CAST(NULL AS BIGINT) AS code, CAST(NULL AS DOUBLE) AS lots FROM base GROUP BY dt, i
  UNION ALL SELECT b.dt, b.i, b.k, s.rest-greatest(floor(s.rest/b.ticket),0e0)*b.ticket, b.code, b.lots0+greatest(floor(s.rest/b.ticket),0e0)
  FROM spend s JOIN base b ON b.dt=s.dt AND b.i=s.i AND b.k=s.k+1),
good AS (SELECT s.dt, s.i FROM spend s JOIN base b USING (dt, i, code) GROUP BY s.dt, s.i HAVING min(b.ticket*s.lots)>=16500),
best AS (SELECT dt, min(i) AS i FROM good GROUP BY dt),
sized AS (SELECT cp.code, cp.dt, cp.order_price, cp.weight, cp.budget, CAST(s.lots AS BIGINT) AS lots, CAST(s.lots*100 AS BIGINT) AS vol
  FROM best JOIN spend s USING (dt, i) JOIN cp ON cp.dt=s.dt AND cp.code=s.code WHERE s.lots>0)"""


@query("allocate_budget", with_views("bars", "calendar", body=SIG + PICK + BUDGET + ALLOCATE + "SELECT * FROM sized", recursive=True))
def _allocate(v: Views) -> DataFrame:
    capped = P.cap_portfolio(_signals(v)[1], _budgets(v), 3, 0.25, seed=7)
    return P.allocate_budget(capped, 3, 16_500, seed=1)


# -- trade log and equity -------------------------------------------------------------------------------------------------

VOL = ", tv AS (SELECT *, (code%4+1)*100 AS vol FROM tr)"


def _sized(v: Views) -> DataFrame:
    return _trades(v).withColumn("vol", (F.col(CODE) % 4 + 1) * 100)


@query(
    "trade_log",
    with_views("bars", body=SIG + trades_sql() + VOL + f""", pc AS (SELECT *, {r('exit_price-order_price')} AS c, CASE WHEN {r('exit_price-order_price')}=0 THEN 0e0 ELSE {pct_sql('order_price', 'exit_price')} END AS q FROM tv)
SELECT dt AS timestamp, 'OPEN' AS action, code || '-' || dt AS id, code, vol, order_price AS price, order_price*vol AS total_value, 0e0 AS chg, 0e0 AS pct_chg, 0e0 AS total_return FROM tv
UNION ALL SELECT exit_dt, action, code || '-' || dt, code, vol, exit_price, exit_price*vol, c, q, (order_price*q*1e-2)*vol FROM pc WHERE exit_dt IS NOT NULL"""),
)
def _trade_log(v: Views) -> DataFrame:
    return P.trade_log(_sized(v))


def fee_sql(amount: str) -> str:
    return r(f"greatest({amount}*(5e-2*1e-2),5e0)")


def duty_sql(amount: str) -> str:
    return r(f"{amount}*(1e-1*1e-2)")


@query(
    "net_pct_return",
    with_views("bars", body=SIG + trades_sql() + VOL + f""", q AS (SELECT *, {r('order_price*vol')} AS cost, {r('exit_price*vol')} AS val FROM tv WHERE exit_dt IS NOT NULL)
SELECT code, dt, ({r('val-cost')}-({fee_sql('cost')}+{fee_sql('val')}+{duty_sql('val')}))/cost AS net_pct_return FROM q"""),
)
def _net(v: Views) -> DataFrame:
    closed = _sized(v).where(F.col("exit_dt").isNotNull())
    return P.net_pct_return(closed, 0.05, 5.0, 0.1).select(CODE, DT, "net_pct_return")


EQUITY = f""", fl AS (SELECT dt, sum(buy) AS buy, sum(sell) AS sell FROM (SELECT dt, {r('order_price*vol')} AS buy, NULL AS sell FROM tv UNION ALL
  SELECT exit_dt, NULL, exit_price*vol FROM tv WHERE exit_dt IS NOT NULL) GROUP BY dt),
net AS (SELECT dt, CASE WHEN sell>0 THEN {r(f"sell-{fee_sql('sell')}-{duty_sql('sell')}")} ELSE 0e0 END - CASE WHEN buy>0 THEN {r(f"buy+{fee_sql('buy')}")} ELSE 0e0 END AS flow FROM fl),
hd AS (SELECT t.code, t.order_price, t.vol, t.dt AS entry_dt, c.dt FROM tv t JOIN calendar c ON c.dt>=t.dt AND (t.exit_dt IS NULL OR c.dt<t.exit_dt)),
mk AS (SELECT hd.dt, sum({r('CASE WHEN b.dt>hd.entry_dt THEN b.close ELSE hd.order_price END*hd.vol')}) AS mv FROM hd ASOF LEFT JOIN fx b ON b.code=hd.code AND hd.dt>=b.dt GROUP BY hd.dt),
eq AS (SELECT c.dt, coalesce(mv,0e0) AS market_value, 1e7+sum(coalesce(flow,0e0)) OVER (ORDER BY c.dt) AS free_cash_amount, 0e0 AS frozen_cash_amount
  FROM calendar c LEFT JOIN net USING (dt) LEFT JOIN mk USING (dt))"""


@query(
    "equity_curve",
    with_views("bars", "calendar", body=SIG + trades_sql() + VOL + EQUITY + f"SELECT dt, {r('market_value', 4)} AS market_value, {r('free_cash_amount', 4)} AS free_cash_amount, frozen_cash_amount FROM eq"),
)
def _equity(v: Views) -> DataFrame:
    curve = P.equity_curve(_sized(v), _table(v), v.calendar, 1e7)
    return curve.withColumns({c: S.rounded(c, 4) for c in ("market_value", "free_cash_amount")})


# -- metrics --------------------------------------------------------------------------------------------------------------

CURVE = """, cu AS (SELECT *, market_value+free_cash_amount+frozen_cash_amount AS capital FROM capitals),
cr AS (SELECT *, coalesce(capital/lag(capital) OVER w-1e0, 0e0) AS pct_chg, capital/max(capital) OVER w-1e0 AS dd FROM cu WINDOW w AS (PARTITION BY run_id ORDER BY dt))"""
CAP_METRICS = f""", cm AS (SELECT run_id, {r('1e2*arg_max(capital,dt)/arg_min(capital,dt)')} AS total_returns, {r('1e2*min(dd)')} AS max_drawdown,
  {r('avg(pct_chg)/stddev_samp(pct_chg)*sqrt(252e0)')} AS sharpe_ratio,
  {r('sum(CASE WHEN pct_chg>=0 THEN pct_chg ELSE 0e0 END)/abs(sum(CASE WHEN pct_chg<0 THEN pct_chg ELSE 0e0 END))', 8)} AS profit_factor FROM cr GROUP BY run_id)"""
TRADE_METRICS = f""", tm AS (SELECT run_id, {r("1e2*count(*) FILTER (action<>'OPEN' AND pct_chg>0)/count(*) FILTER (action<>'OPEN')")} AS win_rate,
  count(*) FILTER (action='OPEN') AS number_of_trades, count(*) FILTER (action='STOP_LOSS') AS number_of_stop_loss,
  count(*) FILTER (action='TAKE_PROFIT') AS number_of_take_profit, count(*) FILTER (action='CLOSE') AS number_of_close,
  {r('avg(pct_chg)')} AS avg_return, {r('stddev_samp(pct_chg)')} AS stddev_return FROM trade_rows GROUP BY run_id)"""
CAP_NAMES = ["total_returns", "max_drawdown", "sharpe_ratio", "profit_factor"]
TRADE_NAMES = ["win_rate", "number_of_trades", "number_of_stop_loss", "number_of_take_profit", "number_of_close", "avg_return", "stddev_return"]


@query("capital_returns", with_views("capitals", body=CURVE + f"SELECT run_id, dt, capital, {r('pct_chg', 10)} AS pct_chg FROM cr"))
def _capital_returns(v: Views) -> DataFrame:
    return M.capital_returns(v.capitals).select("run_id", DT, "capital", S.rounded("pct_chg", 10).alias("pct_chg"))


def _steady(df: DataFrame) -> DataFrame:
    return df.withColumn("profit_factor", S.rounded("profit_factor", 8))


for _metric in CAP_NAMES:
    query(_metric, with_views("capitals", body=CURVE + CAP_METRICS + f"SELECT run_id, {_metric} FROM cm"))(
        lambda v, m=_metric: _steady(M.capital_metrics(v.capitals)).select("run_id", m)
    )

for _metric in TRADE_NAMES:
    query(_metric, with_views("trade_rows", body=TRADE_METRICS + f"SELECT run_id, {_metric} FROM tm"))(
        lambda v, m=_metric: M.trade_metrics(v.trade_rows).select("run_id", m)
    )


@query("evaluate", with_views("capitals", "trade_rows", body=CURVE + CAP_METRICS + TRADE_METRICS + "SELECT * FROM cm LEFT JOIN tm USING (run_id)"))
def _evaluate(v: Views) -> DataFrame:
    return _steady(M.evaluate(v.trade_rows, v.capitals))


@query(
    "custom_evaluator",
    with_views("capitals", "trade_rows", body=CURVE + CAP_METRICS + "SELECT cm.run_id, total_returns, n FROM cm JOIN (SELECT run_id, count(*) AS n FROM trade_rows WHERE pct_chg<-2 GROUP BY run_id) USING (run_id)"),
)
def _custom_evaluator(v: Views) -> DataFrame:
    def losers(trades: DataFrame, capitals: DataFrame) -> DataFrame:
        bad = trades.where(F.col("pct_chg") < -2).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        return M.capital_metrics(capitals).select("run_id", "total_returns").join(bad, "run_id")

    return run_evaluator(v.trade_rows, v.capitals, losers)


RUNS = CURVE + CAP_METRICS + TRADE_METRICS + """, rn AS (SELECT *, CAST(substr(run_id,2) AS INTEGER)%3 AS stop_loss, CAST(substr(run_id,2) AS INTEGER)%2 AS take_profit
  FROM cm LEFT JOIN tm USING (run_id))"""


def _runs(v: Views) -> DataFrame:
    number = F.substring("run_id", 2, 9).cast("int")
    return M.evaluate(v.trade_rows, v.capitals).withColumns({"stop_loss": number % 3, "take_profit": number % 2})


@query(
    "metrics_by_params",
    with_views("capitals", "trade_rows", body=RUNS + "SELECT stop_loss, take_profit, " + ", ".join(
        f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_std" for m in M.CORE_METRICS
    ) + " FROM rn GROUP BY stop_loss, take_profit"),
)
def _by_params(v: Views) -> DataFrame:
    return M.metrics_by_params(_runs(v), ["stop_loss", "take_profit"])


@query(
    "best_params",
    with_views("capitals", "trade_rows", body=RUNS + f"SELECT stop_loss, take_profit, {r('avg(total_returns)')} AS total_returns_mean FROM rn GROUP BY ALL ORDER BY total_returns_mean DESC LIMIT 2"),
)
def _best_params(v: Views) -> DataFrame:
    by = M.metrics_by_params(_runs(v), ["stop_loss", "take_profit"], ["total_returns"])
    return M.best_params(by, 2).select("stop_loss", "take_profit", "total_returns_mean")


@query(
    "describe_metrics",
    with_views("capitals", "trade_rows", body=RUNS + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) AS count, {r(f'avg({m})')} AS mean, {r(f'stddev_samp({m})')} AS std, {r(f'min({m})')} AS min, "
        + ", ".join(f"{r(f'quantile_cont(CAST({m} AS DOUBLE), {q / 100})')} AS p{q}" for q in (25, 50, 75))
        + f", {r(f'max({m})')} AS max FROM rn" for m in M.DESCRIBED
    )),
)
def _describe(v: Views) -> DataFrame:
    return M.describe_metrics(_runs(v))


@query(
    "equity_bands",
    with_views("capitals", body=CURVE + f""", d AS (SELECT dt, avg(capital) AS m, stddev_samp(capital) AS s FROM cu GROUP BY dt)
SELECT dt, {r('m', 4)} AS mean, {r('s', 4)} AS std, {r('m-s', 4)} AS lower, {r('m+s', 4)} AS upper, {r('1e2*(m/max(m) OVER (ORDER BY dt)-1e0)')} AS drawdown FROM d"""),
)
def _bands(v: Views) -> DataFrame:
    bands = M.equity_bands(v.capitals.withColumn("capital", M.capital_of()))
    return bands.withColumns({c: S.rounded(c, 4) for c in ("mean", "std", "lower", "upper")})


@query(
    "return_quartiles",
    with_views("capitals", body=CURVE + f"""SELECT dt, {r('quantile_cont(capital,0.25)', 4)} AS q1, {r('quantile_cont(capital,0.5)', 4)} AS median, {r('quantile_cont(capital,0.75)', 4)} AS q3
FROM cu WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY dt"""),
)
def _quartiles(v: Views) -> DataFrame:
    curves = v.capitals.withColumn("capital", M.capital_of())
    wide = curves.groupBy(DT).pivot("run_id", [f"r{i}" for i in range(25)]).agg(F.first("capital"))
    found = M.return_quartiles(M.wide_to_long(wide), "1996-01-01", "1999-12-31")
    return found.withColumns({c: S.rounded(c, 4) for c in ("q1", "median", "q3")})


@query(
    "benchmark",
    with_views("bars", "capitals", body=CURVE + f""", ix AS (SELECT dt, open, high, low, close FROM bars WHERE code=0),
j AS (SELECT cu.*, ix.open, ix.high, ix.low, ix.close FROM cu JOIN ix USING (dt) WHERE run_id='r3' AND dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')
SELECT dt, capital, open AS SSE_open, high AS SSE_high, low AS SSE_low, close AS SSE_close, {r('1e2*(capital/max(capital) OVER (ORDER BY dt)-1e0)')} AS drawdown FROM j"""),
)
def _benchmark(v: Views) -> DataFrame:
    run = v.capitals.where(F.col("run_id") == "r3").drop("run_id").withColumn("capital", M.capital_of())
    index = v.bars.where(F.col(CODE) == 0)
    found = joins.benchmark(run, index, since="1996-01-01", until="2000-12-31")
    return found.select(DT, "capital", "SSE_open", "SSE_high", "SSE_low", "SSE_close", "drawdown")


# -- sweeps ---------------------------------------------------------------------------------------------------------------

AXES = [("min_vol", [20.0, 40.0, 60.0]), (("dip", "stop_loss", "take_profit"), [(0.0, 2.0, 3.0), (0.5, 4.0, 5.0)])]


#: Buys at so much under the lower band, at such a volume.
RULE = [
    sweep.Threshold("dip", lambda dip: F.col("close") <= F.col("boll_lower") - dip),
    sweep.Threshold("min_vol", lambda least: F.col("vol") >= least),
]


def _sweep_signals(v: Views, repetitions: int = 2) -> tuple[DataFrame, DataFrame]:
    table = _table(v)
    runs = sweep.runs_of(sweep.param_sets(AXES), repetitions)
    return table, sweep.sweep_signals(table, runs, RULE, prefilter=F.col("close") <= F.col("boll_lower"))


GRID = """, g AS (SELECT rep || '-' || (a*2+b+1) AS run_id, rep || '-1' AS batch_id, CAST(rep AS INTEGER) AS repetition, 20e0+20*a AS min_vol, 5e-1*b AS dip, 2e0+2*b AS stop_loss, 3e0+2*b AS take_profit
  FROM (SELECT unnest(range(1,3)) AS rep), (SELECT unnest(range(0,3)) AS a), (SELECT unnest(range(0,2)) AS b)),
ss AS (SELECT g.*, code, dt, close AS order_price, 1e0 AS weight FROM fx JOIN g ON close<=boll_lower-dip AND vol>=min_vol)"""


@query("sweep_signals", with_views("bars", body=SIGNAL_SQL + GRID + "SELECT * FROM ss"))
def _sweep(v: Views) -> DataFrame:
    return _sweep_signals(v)[1]


@query(
    "sweep",
    with_views("bars", body=SIGNAL_SQL + GRID + f""", hh AS (SELECT s.run_id, s.code, s.dt, s.order_price, b.dt AS exit_dt, {stop_sql('s.order_price', 's.stop_loss', 'b.open', 'b.low')} AS st,
  {take_sql('s.order_price', 's.take_profit', 'b.open', 'b.high')} AS tk FROM ss s JOIN fx b ON b.code=s.code AND b.dt>s.dt),
first_hits AS (SELECT * FROM hh WHERE st IS NOT NULL OR tk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, code, dt ORDER BY exit_dt)=1)
SELECT ss.run_id, any_value(ss.min_vol) AS min_vol, any_value(ss.dip) AS dip, count(*) AS n_signals, count(h.exit_dt) AS n_closed, count(st) AS n_stopped,
  {r(f"avg({r('1e2*(coalesce(st,tk)-h.order_price)/h.order_price')})", 6)} AS avg_pct FROM ss LEFT JOIN first_hits h USING (run_id, code, dt) GROUP BY ss.run_id"""),
)
def _sweep_eval(v: Views) -> DataFrame:
    def evaluate(signals: DataFrame, table: DataFrame) -> DataFrame:
        found = exits.shared_exits(signals, table, F.col("stop_loss"), F.col("take_profit"))
        return found.groupBy("run_id").agg(
            F.min("min_vol").alias("min_vol"),
            F.min("dip").alias("dip"),
            F.count(F.lit(1)).alias("n_signals"),
            F.count("exit_dt").alias("n_closed"),
            F.count_if(F.col("action") == "STOP_LOSS").alias("n_stopped"),
            S.rounded(F.avg(S.pct_chg("order_price", "exit_price")), 6).alias("avg_pct"),
        )

    runs = sweep.runs_of(sweep.param_sets(AXES), 2)
    return sweep.sweep(_table(v), runs, RULE, evaluate, prefilter=F.col("close") <= F.col("boll_lower"))


def _wide_grid():
    """36 parameter sets: three by three by two by two."""
    axes = [("dip", [0.0, 0.25, 0.5]), ("min_vol", [20.0, 40.0, 60.0]), ("stop_loss", [2.0, 4.0]), ("take_profit", [3.0, 5.0])]
    yield from sweep.param_sets(axes)


@query(
    "sweep_720_runs",
    with_views("bars", body=SIGNAL_SQL + f""", g AS (SELECT rep || '-' || (((a*3+b)*2+c)*2+d+1) AS run_id, 25e-2*a AS dip, 20e0+20*b AS min_vol, 2e0+2*c AS stop_loss, 3e0+2*d AS take_profit
  FROM (SELECT unnest(range(1,21)) AS rep), (SELECT unnest(range(0,3)) AS a), (SELECT unnest(range(0,3)) AS b), (SELECT unnest(range(0,2)) AS c), (SELECT unnest(range(0,2)) AS d)),
ss AS (SELECT g.*, code, dt, close AS order_price FROM fx JOIN g ON close<=boll_lower-dip AND vol>=min_vol),
one AS (SELECT DISTINCT code, dt, order_price, stop_loss, take_profit FROM ss),
hh AS (SELECT s.*, b.dt AS exit_dt, {stop_sql('s.order_price', 's.stop_loss', 'b.open', 'b.low')} AS st,
  {take_sql('s.order_price', 's.take_profit', 'b.open', 'b.high')} AS tk FROM one s JOIN fx b ON b.code=s.code AND b.dt>s.dt),
fh AS (SELECT * FROM hh WHERE st IS NOT NULL OR tk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, dt, stop_loss, take_profit ORDER BY exit_dt)=1)
SELECT run_id, count(*) AS n_signals, count(st) AS n_stopped, count(exit_dt)-count(st) AS n_taken, {r(f"avg({r('1e2*(coalesce(st,tk)-ss.order_price)/ss.order_price')})", 6)} AS avg_pct
FROM ss LEFT JOIN fh USING (code, dt, stop_loss, take_profit) GROUP BY run_id"""),
)
def _sweep_wide(v: Views) -> DataFrame:
    def evaluate(signals: DataFrame, table: DataFrame) -> DataFrame:
        found = exits.shared_exits(signals, table, F.col("stop_loss"), F.col("take_profit"))
        return found.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_signals"),
            F.count_if(F.col("action") == "STOP_LOSS").alias("n_stopped"),
            F.count_if(F.col("action") == "TAKE_PROFIT").alias("n_taken"),
            S.rounded(F.avg(S.pct_chg("order_price", "exit_price")), 6).alias("avg_pct"),
        )

    return sweep.sweep(_table(v), sweep.runs_of(_wide_grid, 20), RULE, evaluate)


@query(
    "param_grid",
    "SELECT a.*, b.* FROM (SELECT DISTINCT p_size AS size FROM part) a, (SELECT DISTINCT l_discount AS stop_loss, l_discount*2e0 AS take_profit FROM lineitem) b",
)
def _param_grid(v: Views) -> DataFrame:
    sizes = v.table("part").select(F.col("p_size").alias("size"))
    levels = v.table("lineitem").select(F.col("l_discount").alias("stop_loss"), (F.col("l_discount") * F.lit(2.0)).alias("take_profit"))
    return sweep.param_grid([sizes, levels])


@query(
    "explode_run",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS batch_id, CAST(o_orderkey%5 AS INTEGER) AS repetition,
CAST(o_orderkey%7 AS DOUBLE) AS stop_loss, CAST(o_orderkey%11 AS DOUBLE) AS take_profit, o_totalprice AS total_returns, o_totalprice/1e3 AS win_rate FROM orders""",
)
def _explode_run(v: Views) -> DataFrame:
    o, k = v.table("orders"), F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.lit("win_rate")).otherwise(F.lit("success_rate"))
    records = o.select(
        k.cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("batch_id"),
        (k % 5).cast("int").alias("repetition"),
        F.lit("x").alias("dataset_path"),
        F.create_map(F.lit("stop_loss"), (k % 7).cast("double"), F.lit("take_profit"), (k % 11).cast("double")).alias("params"),
        F.to_json(F.create_map(F.lit("total_returns"), F.col("o_totalprice"), name, F.col("o_totalprice") / F.lit(1e3))).alias("metrics"),
    )
    return sweep.explode_run(records, ["stop_loss", "take_profit"], ["total_returns", "win_rate"])


# -- a whole strategy -------------------------------------------------------------------------------------------------------


def rebound(**changes) -> Strategy:
    """Buys a fall of some true ranges below the long average while the short one holds, sells back at the average."""
    book = extended(X.ref_factor("ema10", 1), X.ref_factor("sma30", 1))
    fallen = lambda p: F.col("close") <= F.col("sma120") - p.ranges * F.col("atr")
    rising = lambda p: (F.col("ema10_ref1") > F.col("sma30_ref1") * p.trend) & (F.col("typical_price") >= F.col("close"))
    return Strategy(
        "rebound",
        ("sma120", "ema10", "sma30", "typical_price", "atr", "ema10_ref1", "sma30_ref1"),
        lambda p: fallen(p) & rising(p),
        lambda p: (F.col("close") >= F.col("sma30")) & (F.col("sma30") < F.col("sma30_ref1")),
        stop_loss=6.0,
        take_profit=9.0,
        max_position_opens=4,
        max_position_size=0.2,
        custom_params={"ranges": 0.25, "trend": 0.995},
        book=book,
        pre_process=lambda bars: bars.where(F.col(CODE) % 13 != 0),
    ).with_params(**changes)


@query("strategy_factor_table")
def _factor_table(v: Views) -> DataFrame:
    return rebound().factor_table(v.bars, v.factors).drop("pos")


@query("strategy_signals")
def _strategy_signals(v: Views) -> DataFrame:
    plan = rebound()
    return plan.signals(plan.factor_table(v.bars, v.factors))


@query("strategy_backtest")
def _backtest(v: Views) -> DataFrame:
    plan = rebound()
    table = plan.factor_table(v.bars, v.factors)
    book = plan.backtest(table, v.calendar, 200_000_000.0, Fees(), seed=11)
    return run_evaluator(book["log"], book["capitals"])


def _hooked(v: Views) -> tuple[DataFrame, Strategy]:
    """Stops at a close some way under the lower band, which no summary tells; takes a rise by so much on rising volume."""
    stop = lambda p: ExitRule(lambda bar, position: F.when(bar("close") < bar("boll_lower") - p.under, bar("close")))
    rise = lambda position, p: position("order_price") + p.rise
    take = lambda p: ExitRule(
        lambda bar, position: F.when((bar("high") >= rise(position, p)) & (bar("vol") > bar("vol_ref1")), F.greatest(bar("open"), rise(position, p))),
        {"highest": lambda bar: F.max(F.when(bar("vol") > bar("vol_ref1"), bar("high")))},
        lambda node, position: node("highest") >= rise(position, p),
    )
    plan = Strategy("hooked", (), lambda p: F.col("close") <= F.col("boll_lower"), should_stop_loss=stop, should_take_profit=take,
                    stop_loss_slip=Slip("max_pct", 0.0), take_profit_slip=Slip("max_pct", 0.0)).with_params(under=0.25, rise=2.5)
    return _table(v), plan


@query(
    "strategy_own_exits",
    with_views("bars", body=SIG + """, hk AS MATERIALIZED (SELECT s.code, s.dt, b.dt AS exit_dt, CASE WHEN b.close<b.boll_lower-25e-2 THEN b.close END AS st,
  CASE WHEN b.high>=s.order_price+25e-1 AND b.vol>b.vol1 THEN greatest(b.open, s.order_price+25e-1) END AS tk FROM sig s JOIN fx b ON b.code=s.code AND b.dt>s.dt),
hf AS MATERIALIZED (SELECT * FROM hk WHERE st IS NOT NULL OR tk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, dt ORDER BY exit_dt)=1)
SELECT s.code, s.dt, s.order_price, 1e0 AS weight, exit_dt, coalesce(st, tk) AS exit_price, CASE WHEN st IS NOT NULL THEN 'STOP_LOSS' WHEN tk IS NOT NULL THEN 'TAKE_PROFIT' END AS action
FROM sig s LEFT JOIN hf USING (code, dt)"""),
)
def _own_exits(v: Views) -> DataFrame:
    table, plan = _hooked(v)
    return plan.trades(table, plan.signals(table))


@query("slipped_trades")
def _slipped(v: Views) -> DataFrame:
    table, signals = _signals(v)
    priced = table.withColumn("orig_open", F.col("open"))
    found = exits.entry_exit(signals, priced, 3.0, 4.0, close=F.col("close") >= F.col("boll_upper"))
    return with_slippage(found, Slip("max_jump", 2), Slip("weibull", SLIPS["weibull"][0]))
