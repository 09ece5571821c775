"""Window factors and series operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.scalar import rounded
from tickloom.operators import events, factors as X, filters, joins, series
from tickloom.operators.factors import extended, with_factors
from tickloom.plans.strategy import crossing_up
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, with_views

W = "OVER (PARTITION BY code ORDER BY dt)"
DIGITS = 6


def tail(n: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def shown(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("code", "dt")) -> DataFrame:
    """Keys and rounded values: sums of doubles depend on the order of addition in the last digits."""
    return df.select(*keys, *[rounded(n, DIGITS).alias(n) for n in names])


def p(x: str) -> str:
    return r(x, DIGITS)


NUMBERED = f", n AS (SELECT *, row_number() {W} - 1 AS pos FROM bars)"


def ema_sql(src: str, out: str, x: str, n: int, alpha: str, first: int, keep: str = "*") -> str:
    """Exponential mean of ``x`` (known from bar ``first``) by scaled running sums, as common table expressions."""
    seed_at = first + n - 1
    return f""", {out}_s AS (SELECT {keep}, avg({x}) {tail(n)} AS seed_ FROM {src}),
{out}_z AS (SELECT *, CASE WHEN pos={seed_at} THEN seed_ WHEN pos>{seed_at} THEN {alpha}*{x} ELSE 0e0 END AS z_ FROM {out}_s),
{out} AS (SELECT * EXCLUDE (seed_, z_), CASE WHEN pos>={seed_at} THEN pow(1e0-{alpha},pos)*sum(z_*pow(1e0/(1e0-{alpha}),pos)) {W} END AS {out}_v FROM {out}_z)"""


MA = ["sma5", "sma10", "sma20", "sma30", "sma60", "sma120", "sma250"]


@query(
    "sma",
    with_views("bars", body=NUMBERED + "SELECT code, dt, " + ", ".join(
        f"CASE WHEN pos>={m[3:]}-1 THEN {p(f'avg(close) {tail(int(m[3:]))}')} END AS {m}" for m in MA) + " FROM n"),
)
def _sma(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, MA), MA)


EMAS = [5, 10, 20, 30, 60, 120, 250]


@query(
    "ema",
    with_views("bars", body=NUMBERED + "".join(
        ema_sql("n" if i == 0 else f"e{EMAS[i - 1]}", f"e{n}", "close", n, f"(2e0/{n + 1})", 0) for i, n in enumerate(EMAS))
        + "SELECT code, dt, " + ", ".join(f"{p(f'e{n}_v')} AS ema{n}" for n in EMAS) + " FROM e250"),
)
def _ema(v: Views) -> DataFrame:
    names = [f"ema{n}" for n in EMAS]
    return shown(with_factors(v.bars, names), names)


@query(
    "ma_cross",
    with_views("bars", "listing", body=f""", n AS (SELECT bars.*, row_number() {W} - 1 AS pos FROM bars),
m AS (SELECT code, dt, close, CASE WHEN pos>=9 THEN avg(close) {tail(10)} END AS f, CASE WHEN pos>=29 THEN avg(close) {tail(30)} END AS s FROM n),
c AS (SELECT *, lag(f) {W} AS f1, lag(s) {W} AS s1 FROM m)
SELECT code, dt, close AS order_price, 1e0 AS weight FROM c WHERE f>s AND f1<s1 AND code IN (SELECT code FROM listing WHERE name NOT LIKE '%7')"""),
)
def _ma_cross(v: Views) -> DataFrame:
    """Minimum slice: the 10-day average crosses above the 30-day average, flagged names excluded."""
    named = joins.listed_only(v.bars, filters.universe(v.listing, ~F.col("name").endswith("7")))
    book = extended(X.ref_factor("sma10", 1), X.ref_factor("sma30", 1))
    rows = with_factors(named, ["sma10", "sma30", "sma10_ref1", "sma30_ref1"], book)
    rows = filters.drop_incomplete(rows, ["sma10", "sma30", "sma10_ref1", "sma30_ref1"])
    return filters.buy_signals(rows, crossing_up("sma10", "sma30", "sma10_ref1", "sma30_ref1"))


MACD_SQL = (
    NUMBERED
    + ema_sql("n", "slow", "close", 26, "(2e0/27)", 0)
    + ema_sql("slow", "fast", "close", 12, "(2e0/13)", 14)
    + ", line AS (SELECT *, fast_v-slow_v AS l FROM fast)"
    + ema_sql("line", "sig", "l", 9, "(2e0/10)", 25)
    + f"SELECT code, dt, {p('l-sig_v')} AS macd FROM sig"
)


@query("macd", with_views("bars", body=MACD_SQL))
def _macd(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, ["macd"]), ["macd"])


@query(
    "bollinger",
    with_views("bars", body=NUMBERED + f"""SELECT code, dt, CASE WHEN pos>=19 THEN {p(f'avg(close) {tail(20)} - 2e0*stddev_pop(close) {tail(20)}')} END AS boll_lower,
CASE WHEN pos>=19 THEN {p(f'avg(close) {tail(20)}')} END AS boll_middle,
CASE WHEN pos>=19 THEN {p(f'avg(close) {tail(20)} + 2e0*stddev_pop(close) {tail(20)}')} END AS boll_upper FROM n"""),
)
def _boll(v: Views) -> DataFrame:
    names = ["boll_lower", "boll_middle", "boll_upper"]
    return shown(with_factors(v.bars, names), names)


RSI = {"rsi_fast": 6, "rsi_mid": 12, "rsi_slow": 24}


def _rsi_sql() -> str:
    sql = NUMBERED + f", d AS (SELECT *, close - lag(close) {W} AS c_ FROM n), g AS (SELECT *, greatest(c_,0e0) AS up, greatest(-c_,0e0) AS dn FROM d)"
    src = "g"
    for out, n in RSI.items():
        for side in ("up", "dn"):
            sql += ema_sql(src, f"{out}_{side}", side, n, f"(1e0/{n})", 1)
            src = f"{out}_{side}"
    cols = ", ".join(
        f"CASE WHEN {o}_up_v+{o}_dn_v=0 THEN 0e0 ELSE {p(f'1e2*{o}_up_v/({o}_up_v+{o}_dn_v)')} END AS {o}" for o in RSI
    )
    return sql + f"SELECT code, dt, {cols} FROM {src}"


@query("rsi", with_views("bars", body=_rsi_sql()))
def _rsi(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, list(RSI)), list(RSI))


ATR_SQL = (
    f", n0 AS (SELECT *, row_number() {W} - 1 AS pos, lag(close) {W} AS pc FROM bars)"
    + ", n AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr FROM n0)"
    + ema_sql("n", "a", "tr", 14, "(1e0/14)", 1)
)


@query("atr", with_views("bars", body=ATR_SQL + f"SELECT code, dt, {p('a_v')} AS atr FROM a"))
def _atr(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, ["atr"]), ["atr"])


@query(
    "skdj",
    with_views("bars", body=NUMBERED + f""", lh AS (SELECT *, min(low) {tail(15)} AS lo_, max(high) {tail(15)} AS hi_ FROM n),
raw AS (SELECT *, CASE WHEN pos>=14 THEN CASE WHEN hi_=lo_ THEN 0e0 ELSE (close-lo_)/(hi_-lo_)*1e2 END END AS raw_ FROM lh)"""
        + ema_sql("raw", "rsv", "raw_", 5, "(2e0/6)", 14)
        + ema_sql("rsv", "k", "rsv_v", 5, "(2e0/6)", 18)
        + f"SELECT code, dt, {p('k_v')} AS sdj_k, CASE WHEN pos>=26 THEN {p(f'avg(k_v) {tail(5)}')} END AS sdj_d FROM k"),
)
def _skdj(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, ["sdj_k", "sdj_d"]), ["sdj_k", "sdj_d"])


@query(
    "rolling_min_max",
    with_views("bars", body=NUMBERED + f"""SELECT code, dt, CASE WHEN pos>=14 THEN min(low) {tail(15)} END AS low_min15,
CASE WHEN pos>=14 THEN max(high) {tail(15)} END AS high_max15 FROM n"""),
)
def _rolling(v: Views) -> DataFrame:
    book = extended(X.rolling_min(15), X.rolling_max(15))
    return with_factors(v.bars, ["low_min15", "high_max15"], book).select("code", "dt", "low_min15", "high_max15")


@query(
    "regression_slope",
    with_views("bars", body=NUMBERED + f"SELECT code, dt, CASE WHEN pos>=19 THEN {p(f'regr_slope(close, pos) {tail(20)}')} END AS slope20 FROM n"),
)
def _slope(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, ["slope20"]), ["slope20"])


@query("ref", with_views("bars", body=f"SELECT code, dt, lag(close, 3) {W} AS close_ref3 FROM bars"))
def _ref(v: Views) -> DataFrame:
    return series.ref(v.bars, "close", 3).select("code", "dt", "close_ref3")


@query(
    "returns",
    with_views("bars", body=f""", q AS (SELECT *, lag(close) {W} AS pc FROM bars)
SELECT code, dt, {r('coalesce(close-pc,0e0)')} AS chg, {r('coalesce(1e2*((close-pc)/pc),0e0)')} AS pct_chg FROM q"""),
)
def _returns(v: Views) -> DataFrame:
    return with_factors(v.bars, ["chg", "pct_chg"], extended(X.returns())).select("code", "dt", "chg", "pct_chg")


@query("running_index", with_views("bars", body=f'SELECT code, dt, row_number() {W} - 1 AS "index" FROM bars'))
def _index(v: Views) -> DataFrame:
    return series.running_index(v.bars).select("code", "dt", "index")


def _holes(v: Views) -> DataFrame:
    return v.bars.select("code", "dt", F.when(F.col("vol") > 40, F.col("close")).alias("x"))


HOLES = ", h AS (SELECT code, dt, CASE WHEN vol>40 THEN close END AS x FROM bars)"
FF = "last_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BF = "first_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

for _name, _expr in {"ffill": FF, "bfill": BF, "both": f"coalesce({BF},{FF})", "pad": FF}.items():
    query(f"fill_{_name}", with_views("bars", body=HOLES + f"SELECT code, dt, {_expr} AS x FROM h"))(
        lambda v, how=_name: series.fill(_holes(v), "x", how)
    )


@query(
    "drawdown",
    with_views("bars", body=f"SELECT code, dt, {p('close / max(close) OVER (PARTITION BY code ORDER BY dt) - 1e0')} AS drawdown FROM bars"),
)
def _drawdown(v: Views) -> DataFrame:
    return shown(series.drawdown(v.bars, "close"), ["drawdown"])


@query(
    "impute_mkt_cap",
    with_views("bars", body=f""", val AS (SELECT code, dt, vol*1e3 AS cap FROM bars WHERE vol>45),
j AS (SELECT b.code, b.dt, b.close, v.cap/b.close AS x FROM bars b LEFT JOIN val v ON b.code=v.code AND b.dt=v.dt),
f AS (SELECT code, dt, close, coalesce({BF},{FF}) AS s FROM j)
SELECT code, dt, {r('s*close')} AS mkt_cap FROM f"""),
)
def _impute(v: Views) -> DataFrame:
    known = v.bars.where(F.col("vol") > 45).select("code", "dt", (F.col("vol") * F.lit(1000.0)).alias("mkt_cap"))
    return joins.impute_mkt_cap(v.bars, known).select("code", "dt", "mkt_cap")


@query(
    "tail",
    with_views("bars", body="SELECT code, dt, close FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC)<=2"),
)
def _tail(v: Views) -> DataFrame:
    return series.tail(v.bars, 2).select("code", "dt", "close")


@query(
    "head",
    with_views("bars", body="SELECT code, dt, close FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt)<=1"),
)
def _head(v: Views) -> DataFrame:
    return series.head(v.bars).select("code", "dt", "close")


@query(
    "event_window",
    with_views("bars", "calendar", body=NUMBERED + f""", m AS (SELECT code, dt, close, {r(f'avg(close) {tail(5)}')} AS sma5,
{r(f'avg(close) {tail(20)}')} AS sma20, {r(f'avg(close) {tail(60)}')} AS sma60, pos FROM n),
ev AS (SELECT code, dt AS event_dt, idx FROM bars JOIN calendar USING (dt) WHERE vol>=110)
SELECT ev.code, ev.event_dt, m.dt, m.close, m.sma5, m.sma20, m.sma60 FROM ev
JOIN calendar c ON c.idx BETWEEN ev.idx-200 AND ev.idx+60 JOIN m ON m.code=ev.code AND m.dt=c.dt WHERE m.pos>=59"""),
)
def _event_window(v: Views) -> DataFrame:
    marked = v.bars.where(F.col("vol") >= 110).select("code", F.col("dt").alias("event_dt"))
    found = events.event_window(v.bars, marked, v.calendar)
    return found.select("code", "event_dt", "dt", "close", "sma5", "sma20", "sma60")


@query(
    "forward_equity",
    with_views("bars", "calendar", body=""", h AS (SELECT b.code, c.dt, b2.close FROM (SELECT DISTINCT code FROM bars) b CROSS JOIN calendar c
LEFT JOIN bars b2 ON b2.code=b.code AND b2.dt=c.dt)
SELECT code, dt, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY dt) AS close FROM h"""),
)
def _forward(v: Views) -> DataFrame:
    return events.forward_equity(v.bars, calendar=v.calendar)


@query(
    "typical_price_volatility",
    with_views("bars", body=ATR_SQL + f"""SELECT code, dt, {p('(high+low+close)/3e0')} AS typical_price,
{p('1e2*a_v/((high+low+close)/3e0)')} AS volatility FROM a"""),
)
def _volatility(v: Views) -> DataFrame:
    return shown(with_factors(v.bars, ["typical_price", "volatility"]), ["typical_price", "volatility"])


def _user_book():
    book = X.factor_book()

    @book.factor(outputs=["gap", "gap_ref1"], notna=True, lookback=1)
    def gap_pair(s, sma5, ema10):
        return sma5 - ema10, s.ref("sma5", 1) - s.ref("ema10", 1)

    @book.factor(lookback=4)
    def gap_low(s, gap) -> Column:
        return F.min(gap).over(s.tail(5))

    return book


@query(
    "user_factors",
    with_views("bars", body=NUMBERED + ema_sql("n", "e", "close", 10, "(2e0/11)", 0)
        + f""", g AS (SELECT code, dt, pos, CASE WHEN pos>=4 THEN avg(close) {tail(5)} END - e_v AS gap FROM e),
l AS (SELECT *, lag(gap) {W} AS gap_ref1, min(gap) {tail(5)} AS gap_low FROM g)
SELECT code, dt, {p('gap')} AS gap, {p('gap_ref1')} AS gap_ref1, {p('gap_low')} AS gap_low FROM l WHERE gap IS NOT NULL AND gap_ref1 IS NOT NULL"""),
)
def _user(v: Views) -> DataFrame:
    book = _user_book()
    rows = with_factors(v.bars, ["gap", "gap_ref1", "gap_low"], book)
    required = X.notna_columns(["gap", "gap_ref1", "gap_low"], book)
    return shown(filters.drop_incomplete(rows, required), ["gap", "gap_ref1", "gap_low"])


@query(
    "skip_existing",
    with_views("bars", body=NUMBERED + f"SELECT code, dt, close AS sma5, CASE WHEN pos>=9 THEN {p(f'avg(close) {tail(10)}')} END AS sma10 FROM n"),
)
def _skip(v: Views) -> DataFrame:
    stored = v.bars.withColumn("sma5", F.col("close"))
    rows = with_factors(stored, X.missing_factors(stored, ["sma5", "sma10"]))
    return shown(rows, ["sma10"], ("code", "dt", "sma5"))
