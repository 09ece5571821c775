"""As-of joins, adjustment, lookups, filters and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import dates as D, rules, scalar as S
from tickloom.operators import adjust, factors as X, filters, joins, sets
from tickloom.operators.factors import extended, with_factors
from tickloom.operators.sets import latest_record
from tickloom.sources import readers, writers
from tickloom.workload.factors import ATR_SQL, W, p, shown, tail
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, u, with_views

OHLC = "open, high, low, close"


# -- adjustment -------------------------------------------------------------------------------------------------------


@query("adjust_prices", with_views("adjusted", body=f"SELECT code, dt, orig_open, {OHLC}, chg, pct_chg FROM adjusted"))
def _adjust(v: Views) -> DataFrame:
    return v.adjusted.select("code", "dt", "orig_open", "open", "high", "low", "close", "chg", "pct_chg")


LATEST = ", lf AS (SELECT code, arg_max(factor, valid_from) AS factor FROM factors GROUP BY code)"


@query("latest_factor", with_views("factors", body=LATEST + "SELECT code, factor FROM lf"))
def _latest_factor(v: Views) -> DataFrame:
    return adjust.latest_factor(adjust.pad_factor_bounds(v.factors))


def _last_bars(v: Views) -> DataFrame:
    return latest_record(v.bars)


LAST_BARS = ", lb AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY dt DESC)=1)"


@query(
    "adjust_latest",
    with_views("bars", "factors", body=LATEST + LAST_BARS + "SELECT code, dt, open*factor AS open, high*factor AS high, low*factor AS low, close*factor AS close FROM lb LEFT JOIN lf USING (code)"),
)
def _adjust_latest(v: Views) -> DataFrame:
    return adjust.adjust_latest(_last_bars(v), v.factors).select("code", "dt", "open", "high", "low", "close")


@query(
    "to_real_price",
    with_views("adjusted", body=LATEST + f"SELECT code, dt, {r('close/factor')} AS real_price FROM adjusted LEFT JOIN lf USING (code)"),
)
def _real_price(v: Views) -> DataFrame:
    return adjust.to_real_price(v.adjusted, v.factors, "close").select("code", "dt", "real_price")


@query(
    "pad_factor_bounds",
    with_views("factors", body="""SELECT code, valid_from, factor FROM factors UNION ALL
SELECT code, DATE '1900-01-01', arg_min(factor, valid_from) FROM factors GROUP BY code UNION ALL
SELECT DISTINCT code, DATE '3000-01-01', CAST(NULL AS DOUBLE) FROM factors"""),
)
def _pad(v: Views) -> DataFrame:
    return adjust.pad_factor_bounds(v.factors)


for _dir, _cmp in (("last", ">="), ("next", "<=")):
    query(
        f"nearest_release_{_dir}",
        with_views("bars", "releases", body=f"""SELECT b.code, b.dt, r.dt AS release_dt, r.category AS release_category, r.pct_shares AS release_pct
FROM bars b ASOF LEFT JOIN releases r ON b.code=r.code AND b.dt{_cmp}r.dt"""),
    )(
        lambda v, d=_dir: joins.nearest_release(v.bars, v.releases, d).select(
            "code", "dt", "release_dt", "release_category", "release_pct"
        )
    )


NAMES_SQL = """, ch AS (SELECT code, dt, CASE WHEN code%3=0 AND month(dt)=9 THEN 'ST' || code ELSE 'N' || code || '-' || year(dt) END AS company
  FROM releases WHERE code%4<>1 AND dt>=DATE '1996-01-01')"""


def _name_changes(v: Views) -> DataFrame:
    rows = v.releases.where((F.col("code") % 4 != 1) & (F.col("dt") >= F.lit("1996-01-01").cast("date")))
    code = F.col("code").cast("string")
    flagged = (F.col("code") % 3 == 0) & (F.month("dt") == 9)
    name = F.when(flagged, F.concat(F.lit("ST"), code)).otherwise(
        F.concat(F.lit("N"), code, F.lit("-"), F.year("dt").cast("string"))
    )
    return rows.select("code", "dt", name.alias("company"))


@query(
    "patch_company_names",
    with_views("bars", "releases", "listing", body=NAMES_SQL + """, st AS (SELECT code FROM ch GROUP BY code HAVING max(company LIKE '%ST%')),
ag AS (SELECT code, arg_max(company, dt) AS lastn, arg_min(company, dt) AS firstn FROM ch GROUP BY code),
h AS (SELECT b.code, b.dt, c.company FROM bars b ASOF LEFT JOIN (SELECT * FROM ch WHERE code IN (SELECT code FROM st)) c ON b.code=c.code AND b.dt>=c.dt)
SELECT h.code, h.dt, coalesce(h.company, CASE WHEN h.code IN (SELECT code FROM st) THEN ag.firstn END, ag.lastn, l.name) AS company
FROM h LEFT JOIN ag USING (code) LEFT JOIN listing l USING (code)"""),
)
def _patch(v: Views) -> DataFrame:
    return joins.patch_company_names(v.bars, _name_changes(v), v.listing).select("code", "dt", "company")


# -- lookups ----------------------------------------------------------------------------------------------------------


def _half_listing(v: Views) -> DataFrame:
    return v.listing.where(F.col("total_share") > 4000)


@query("listed_only", with_views("bars", "listing", body=f"SELECT code, dt, {OHLC} FROM bars WHERE code IN (SELECT code FROM listing WHERE total_share>4000)"))
def _listed(v: Views) -> DataFrame:
    return joins.listed_only(v.bars, _half_listing(v)).select("code", "dt", "open", "high", "low", "close")


@query(
    "enrich_listing",
    with_views("listing", body="""SELECT l.code, l.name, i.sector, i.listdate, i.total_share, i.float_share FROM listing l
LEFT JOIN (SELECT code, sector, '1995' || lpad(CAST(code%12+1 AS VARCHAR),2,'0') || '01' AS listdate, total_share, total_share*8e-1 AS float_share
FROM listing WHERE code%5<>0) i USING (code)"""),
)
def _enrich(v: Views) -> DataFrame:
    month = F.lpad((F.col("code") % 12 + 1).cast("string"), 2, "0")
    info = v.listing.where(F.col("code") % 5 != 0).select(
        "code", "sector", F.concat(F.lit("1995"), month, F.lit("01")).alias("listdate"), "total_share",
        (F.col("total_share") * F.lit(0.8)).alias("float_share"),
    )
    return joins.enrich_listing(v.listing.select("code", "name"), info)


for _how in ("left", "inner"):
    query(
        f"attach_indicators_{_how}",
        with_views("bars", body=f"SELECT code, dt, close, pe FROM bars {_how.upper()} JOIN (SELECT code, dt, vol/1e1 AS pe FROM bars WHERE vol>30) USING (code, dt)"),
    )(
        lambda v, how=_how: joins.attach_indicators(
            v.bars.select("code", "dt", "close"),
            v.bars.where(F.col("vol") > 30).select("code", "dt", (F.col("vol") / F.lit(10.0)).alias("pe")),
            how,
        )
    )


HELD = "SELECT code FROM listing WHERE total_share>4000"


@query("not_in", with_views("bars", "listing", body=f"SELECT code, dt, close FROM bars WHERE code NOT IN ({HELD})"))
def _not_in(v: Views) -> DataFrame:
    return filters.not_in(v.bars, _half_listing(v)).select("code", "dt", "close")


BLACK_SQL = ", bl AS (SELECT code, CASE WHEN code%3=0 THEN CAST(NULL AS DATE) ELSE make_date(CAST(1995+code%7 AS INTEGER),6,30) END AS until FROM listing WHERE total_share>4000)"


def _blacklist(v: Views) -> DataFrame:
    until = F.when(F.col("code") % 3 != 0, F.make_date((F.col("code") % 7 + 1995).cast("int"), F.lit(6), F.lit(30)))
    return _half_listing(v).select("code", until.alias("until"))


@query(
    "not_blacklisted",
    with_views("bars", "listing", body=BLACK_SQL + "SELECT code, dt, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.code=b.code AND (bl.until IS NULL OR b.dt<=bl.until))"),
)
def _not_black(v: Views) -> DataFrame:
    return filters.not_blacklisted(v.bars, _blacklist(v)).select("code", "dt", "close")


QUOTES_SQL = """, qt AS (SELECT code, DATE '2001-12-03' AS dt, open+1e0 AS open, high+2e0 AS high, low-1e0 AS low, close+5e-1 AS close, vol,
  CASE WHEN code%4=0 THEN CAST(NULL AS DOUBLE) ELSE close END AS alt FROM lb WHERE code%6<>0)"""


def _quotes(v: Views) -> DataFrame:
    """A later quote for most codes, from their last bar."""
    last = _last_bars(v).where(F.col("code") % 6 != 0)
    return last.select(
        "code", F.lit("2001-12-03").cast("date").alias("dt"), (F.col("open") + 1.0).alias("open"), (F.col("high") + 2.0).alias("high"),
        (F.col("low") - 1.0).alias("low"), (F.col("close") + 0.5).alias("close"), "vol",
    )


@query(
    "overlay_quotes",
    with_views("bars", body=LAST_BARS + QUOTES_SQL + "SELECT lb.code, lb.dt, coalesce(CASE WHEN lb.code%4=0 THEN NULL ELSE qt.close END, lb.close) AS close, coalesce(qt.high, lb.high) AS high, lb.vol FROM lb LEFT JOIN qt USING (code)"),
)
def _overlay(v: Views) -> DataFrame:
    quotes = _quotes(v).select("code", "high", F.when(F.col("code") % 4 != 0, F.col("close")).alias("close"))
    return joins.overlay_quotes(_last_bars(v).select("code", "dt", "close", "high", "vol"), quotes)


@query(
    "merge_quote_into_history",
    with_views("bars", body=LAST_BARS + QUOTES_SQL + """, h AS (SELECT code, dt, close, CASE WHEN code%5<>0 THEN vol/1e2 END AS mkt_cap_rank FROM bars),
lr AS (SELECT code, arg_max(mkt_cap_rank, dt) AS mkt_cap_rank FROM h GROUP BY code),
m AS (SELECT * FROM h UNION ALL SELECT qt.code, qt.dt, qt.close, lr.mkt_cap_rank FROM qt JOIN lr USING (code) WHERE lr.mkt_cap_rank IS NOT NULL)
SELECT code, dt, close, mkt_cap_rank FROM m QUALIFY count(*) OVER (PARTITION BY code)>=530"""),
)
def _merge_quote(v: Views) -> DataFrame:
    hist = v.bars.select("code", "dt", "close", F.when(F.col("code") % 5 != 0, F.col("vol") / F.lit(100.0)).alias("mkt_cap_rank"))
    return joins.merge_quote_into_history(hist, _quotes(v).select("code", "dt", "close"), 530)


@query(
    "append_missing_quote",
    with_views("bars", body=""", q2 AS (SELECT code, DATE '2001-07-02' AS dt, max(close) AS close FROM bars GROUP BY code)
SELECT code, dt, close FROM bars UNION ALL SELECT q2.code, q2.dt, q2.close FROM q2 JOIN (SELECT code, max(dt) AS e FROM bars GROUP BY code) USING (code) WHERE e<q2.dt"""),
)
def _append_quote(v: Views) -> DataFrame:
    quotes = v.bars.groupBy("code").agg(F.lit("2001-07-02").cast("date").alias("dt"), F.max("close").alias("close"))
    return joins.append_missing_quote(v.bars.select("code", "dt", "close"), quotes)


@query("name_to_code", with_views("listing", body="SELECT l.name, l.code, b.n FROM (SELECT s_name AS name, s_nationkey AS n FROM supplier) b JOIN listing l USING (name)"))
def _name_to_code(v: Views) -> DataFrame:
    named = v.table("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    return joins.name_to_code(named, v.listing).select("name", "code", "n")


@query(
    "mkt_cap_rank",
    with_views("bars", body=""", c AS (SELECT code, dt, close*(code+1)*1e2 AS cap FROM bars),
q AS (SELECT dt, quantile_cont(cap, [x/100e0 for x in range(100)]) AS lv FROM c GROUP BY dt)
SELECT code, dt, len(list_filter(lv, lambda y: y < cap))/100e0 AS mkt_cap_rank FROM c JOIN q USING (dt)"""),
)
def _cap_rank(v: Views) -> DataFrame:
    caps = v.bars.select("code", "dt", (F.col("close") * (F.col("code") + 1) * F.lit(100.0)).alias("mkt_cap"))
    return joins.mkt_cap_rank(caps).select("code", "dt", "mkt_cap_rank")


@query(
    "minute_adjust",
    with_views("minute", body=""", d AS (SELECT code, dt, arg_min(open, time) AS orig_open, arg_min(open, time)*(1e0+(code%5)*1e-1) AS open FROM minute WHERE code%7<>0 GROUP BY code, dt)
SELECT m.code, m.dt, m.time, m.open AS orig_open, m.open*(d.open/d.orig_open) AS open, m.high*(d.open/d.orig_open) AS high, m.low*(d.open/d.orig_open) AS low, m.close*(d.open/d.orig_open) AS close
FROM minute m JOIN d USING (code, dt)"""),
)
def _minute_adjust(v: Views) -> DataFrame:
    day = v.minute.where(F.col("code") % 7 != 0).groupBy("code", "dt").agg(F.min_by("open", "time").alias("orig_open"))
    day = day.withColumn("open", F.col("orig_open") * (F.lit(1.0) + (F.col("code") % 5) * F.lit(0.1)))
    return adjust.minute_adjust(v.minute, day).select("code", "dt", "time", "orig_open", "open", "high", "low", "close")


# -- filters ----------------------------------------------------------------------------------------------------------


@query("universe", with_views("listing", body="SELECT * FROM listing WHERE market<>'NATION_7' AND name NOT LIKE '%13%'"))
def _universe(v: Views) -> DataFrame:
    return filters.universe(v.listing, (F.col("market") != "NATION_7") & ~F.col("name").contains("13"))


@query(
    "drop_incomplete",
    with_views("bars", body=f"SELECT code, dt, sma20 FROM (SELECT code, dt, CASE WHEN row_number() {W}>=20 THEN {p(f'avg(close) {tail(20)}')} END AS sma20 FROM bars) WHERE sma20 IS NOT NULL"),
)
def _incomplete(v: Views) -> DataFrame:
    return shown(filters.drop_incomplete(with_factors(v.bars, ["sma20"]), ["sma20"]), ["sma20"])


@query(
    "drop_suspect_codes",
    with_views("adjusted", body="SELECT code, dt, close, pct_chg FROM adjusted QUALIFY max(abs(pct_chg)) OVER (PARTITION BY code)<=16"),
)
def _suspect(v: Views) -> DataFrame:
    return filters.drop_suspect_codes(v.adjusted, 16.0).select("code", "dt", "close", "pct_chg")


@query(
    "drop_codes_without_factors",
    with_views("bars", "factors", body="SELECT code, dt, close FROM bars WHERE code IN (SELECT code FROM factors WHERE factor>1.64)"),
)
def _without_factors(v: Views) -> DataFrame:
    some = v.factors.where(F.col("factor") > 1.64)
    return filters.drop_codes_without_factors(v.bars, some).select("code", "dt", "close")


@query("min_history", with_views("bars", body="SELECT code, dt, close FROM bars QUALIFY count(*) OVER (PARTITION BY code)>=530"))
def _min_history(v: Views) -> DataFrame:
    return filters.min_history(v.bars, 530).select("code", "dt", "close")


@query("since", with_views("bars", body="SELECT code, dt, close FROM bars WHERE dt>=DATE '1999-03-01'"))
def _since(v: Views) -> DataFrame:
    return filters.since(v.bars, "1999-03-01").select("code", "dt", "close")


@query(
    "latest_slice",
    with_views("bars", body=f"SELECT code, dt, sma60 FROM (SELECT code, dt, CASE WHEN row_number() {W}>=60 THEN {p(f'avg(close) {tail(60)}')} END AS sma60 FROM bars) WHERE dt=DATE '2000-05-10'"),
)
def _slice(v: Views) -> DataFrame:
    return shown(filters.latest_slice(with_factors(v.bars, ["sma60"]), "2000-05-10"), ["sma60"])


@query("relabel", with_views("listing", body="SELECT code, CASE market WHEN 'NATION_1' THEN 'NATION_2' ELSE market END AS market FROM listing"))
def _relabel(v: Views) -> DataFrame:
    return filters.relabel(v.listing.select("code", "market"), "market", {"NATION_1": "NATION_2"})


@query("min_mkt_cap", with_views("bars", "listing", body="SELECT code, min(dt) AS dt FROM bars WHERE code IN (SELECT code FROM listing WHERE total_share>=2500) GROUP BY code"))
def _min_cap(v: Views) -> DataFrame:
    jobs = v.bars.groupBy("code").agg(F.min("dt").alias("dt"))
    return filters.min_mkt_cap(jobs, v.listing.withColumn("mkt_cap", F.col("total_share")), 2500)


@query("retain_trade_days", with_views("bars", "calendar", body="SELECT code, dt, close FROM bars WHERE dt IN (SELECT dt FROM calendar ORDER BY dt DESC LIMIT 250)"))
def _retain(v: Views) -> DataFrame:
    return filters.retain_trade_days(v.bars, v.calendar, 250).select("code", "dt", "close")


@query("volatility_filter", with_views("bars", body=ATR_SQL + f"SELECT code, dt, {p('a_v')} AS atr FROM a WHERE 1e2*a_v/((high+low+close)/3e0)>=4.2e0"))
def _vol_filter(v: Views) -> DataFrame:
    return shown(filters.volatility_filter(with_factors(v.bars, ["atr", "typical_price"]), 4.2), ["atr"])


@query("min_price_filter", with_views("adjusted", body="SELECT code, dt, orig_open, close FROM adjusted WHERE orig_open>=51"))
def _price_filter(v: Views) -> DataFrame:
    return filters.min_price_filter(v.adjusted, 51.0).select("code", "dt", "orig_open", "close")


LAGGED = f", g AS (SELECT *, lag(close) {W} AS entry FROM bars)"


def _lagged(v: Views) -> DataFrame:
    return with_factors(v.bars, ["close_ref1"], extended(X.ref_factor("close", 1))).withColumnRenamed("close_ref1", "entry")


@query(
    "tolerant_compare",
    with_views("bars", body=LAGGED + """SELECT code, dt, close-entry>1e-4 AS gt, entry-close>1e-4 AS lt, abs(close-entry)<1e-4 AS eq,
(close-entry>1e-4) OR abs(close-entry)<1e-4 AS gte, (entry-close>1e-4) OR abs(close-entry)<1e-4 AS lte,
((entry-low>1e-4) OR abs(entry-low)<1e-4) AND ((high-entry>1e-4) OR abs(entry-high)<1e-4) AS inside FROM g"""),
)
def _tolerant(v: Views) -> DataFrame:
    return _lagged(v).select(
        "code", "dt", S.gt("close", "entry").alias("gt"), S.lt("close", "entry").alias("lt"), S.eq("close", "entry").alias("eq"),
        S.gte("close", "entry").alias("gte"), S.lte("close", "entry").alias("lte"), S.between("entry", "low", "high").alias("inside"),
    )


def pct_sql(base: str, then: str) -> str:
    return r(f"1e2*({then}-{base})/{base}")


def stop_sql(entry: str, pct: str, open_: str = "open", low: str = "low") -> str:
    return f"CASE WHEN {pct_sql(entry, open_)}<=-{pct} THEN {open_} WHEN {pct_sql(entry, low)}<=-{pct} THEN {r(f'{entry}*(1e0+(-{pct})*1e-2)')} END"


def take_sql(entry: str, pct: str, open_: str = "open", high: str = "high") -> str:
    return f"CASE WHEN {pct_sql(entry, open_)}>={pct} THEN {open_} WHEN {pct_sql(entry, high)}>={pct} THEN {r(f'{entry}*(1e0+{pct}*1e-2)')} END"


@query(
    "exit_rules",
    with_views("bars", body=LAGGED + f"""SELECT code, dt, {stop_sql('entry', '3e0')} AS stop_loss, {take_sql('entry', '4e0')} AS take_profit,
CASE WHEN {pct_sql('entry', 'close')}<=-3e0 THEN close END AS live_stop_loss, CASE WHEN {pct_sql('entry', 'close')}>=4e0 THEN close END AS live_take_profit FROM g"""),
)
def _exit_rules(v: Views) -> DataFrame:
    return _lagged(v).select(
        "code", "dt", rules.stop_loss_price("entry", 3.0).alias("stop_loss"), rules.take_profit_price("entry", 4.0).alias("take_profit"),
        rules.live_stop_loss("entry", 3.0).alias("live_stop_loss"), rules.live_take_profit("entry", 4.0).alias("live_take_profit"),
    )


SIGNAL_SQL = f""", f AS (SELECT *, row_number() {W} AS rn, avg(close) {tail(5)} AS sma5, avg(close) {tail(20)} AS mid, stddev_pop(close) {tail(20)} AS sd,
lag(vol) {W} AS vol1 FROM bars), fx AS (SELECT *, round(mid-2e0*sd,6) AS boll_lower, round(mid+2e0*sd,6) AS boll_upper FROM f WHERE rn>=20)"""


def _signal_table(v: Views, keep_pos: bool = False) -> DataFrame:
    rows = with_factors(v.bars, ["sma5", "boll_lower", "boll_upper", "vol_ref1"], extended(X.ref_factor("vol", 1)), keep_pos=keep_pos)
    rows = filters.drop_incomplete(rows, ["sma5", "boll_lower", "vol_ref1"])
    return rows.withColumns({c: F.round(c, 6) for c in ("boll_lower", "boll_upper")})


def _buy_rule():
    return (F.col("close") <= F.col("boll_lower")) | ((F.col("close") >= F.col("sma5")) & (F.col("vol") > F.col("vol_ref1")))


@query(
    "buy_signals",
    with_views("bars", "listing", body=SIGNAL_SQL + BLACK_SQL + """SELECT code, dt, close AS order_price, 1e0 AS weight FROM fx
WHERE (close<=boll_lower OR (close>=sma5 AND vol>vol1)) AND code NOT IN (SELECT code FROM listing WHERE total_share<1000)
AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.code=fx.code AND (bl.until IS NULL OR fx.dt<=bl.until))"""),
)
def _buy_signals(v: Views) -> DataFrame:
    held = v.listing.where(F.col("total_share") < 1000)
    return filters.buy_signals(_signal_table(v), _buy_rule(), held=held, blacklist=_blacklist(v))


@query(
    "close_signals",
    with_views("bars", "listing", body=SIGNAL_SQL + f"SELECT code, dt FROM fx WHERE close>=boll_upper AND code IN ({HELD})"),
)
def _close_signals(v: Views) -> DataFrame:
    return filters.close_signals(_signal_table(v), F.col("close") >= F.col("boll_upper"), _half_listing(v))


# -- order, top-k, sets ----------------------------------------------------------------------------------------------


@query("order_bars", with_views("bars", body="SELECT code, dt, close FROM bars ORDER BY dt, code"))
def _order(v: Views) -> DataFrame:
    return sets.order_bars(v.bars.select("code", "dt", "close"), by_date_first=True)


@query(
    "closest_name",
    with_views("listing", body="""SELECT code, name, market, sector, total_share, 1e0-levenshtein(name,'Suplier#0000042')/CAST(greatest(length(name),15) AS DOUBLE) AS score
FROM listing ORDER BY score DESC, name LIMIT 1"""),
)
def _closest(v: Views) -> DataFrame:
    return readers.closest_name(v.listing, "Suplier#0000042")


@query(
    "sample_runs",
    with_views("capitals", body=f", s AS (SELECT DISTINCT run_id FROM capitals ORDER BY {u('run_id', seed=3)}, run_id LIMIT 7) SELECT run_id, dt, market_value FROM capitals WHERE run_id IN (SELECT run_id FROM s)"),
)
def _sample(v: Views) -> DataFrame:
    return sets.sample_runs(v.capitals, 7, seed=3).select("run_id", "dt", "market_value")


@query("smallest_mkt_cap_first", with_views("listing", body="SELECT code, name, total_share AS mkt_cap FROM listing ORDER BY mkt_cap"))
def _smallest(v: Views) -> DataFrame:
    return sets.smallest_mkt_cap_first(v.listing.select("code", "name", F.col("total_share").alias("mkt_cap")))


@query("latest_record", with_views("bars", body=LAST_BARS + f"SELECT code, dt, {OHLC}, vol FROM lb"))
def _latest_record(v: Views) -> DataFrame:
    return latest_record(v.bars)


@query("concat_bars", with_views("bars", body="SELECT code, dt, close, CAST(NULL AS DOUBLE) AS vol FROM bars WHERE dt<DATE '1998-01-01' UNION ALL SELECT code, dt, close, vol FROM bars WHERE dt>=DATE '1997-01-01'"))
def _concat(v: Views) -> DataFrame:
    early = filters.until(v.bars, "1997-12-31").select("code", "dt", "close")
    return sets.concat_bars(early, filters.since(v.bars, "1997-01-01").select("code", "dt", "close", "vol"))


@query("append_dedup", with_views("bars", body="SELECT code, dt, close FROM bars WHERE dt<DATE '1998-01-01' UNION SELECT code, dt, close FROM bars WHERE dt>=DATE '1997-01-01'"))
def _append_dedup(v: Views) -> DataFrame:
    bars = v.bars.select("code", "dt", "close")
    return writers.append_dedup(filters.until(bars, "1997-12-31"), filters.since(bars, "1997-01-01"))


@query("codes_except", with_views("listing", body=f"SELECT DISTINCT l_suppkey AS code FROM lineitem WHERE l_suppkey NOT IN ({HELD})"))
def _codes_except(v: Views) -> DataFrame:
    return sets.codes_except(v.bars, _half_listing(v))


@query("codes_union", "SELECT l_suppkey AS code FROM lineitem UNION SELECT c_custkey FROM customer")
def _codes_union(v: Views) -> DataFrame:
    return sets.codes_union(v.bars, v.table("customer").select(F.col("c_custkey").alias("code")))


@query("dedupe", "SELECT DISTINCT o_custkey AS code, CAST(o_orderdate AS DATE) AS dt FROM orders")
def _dedupe(v: Views) -> DataFrame:
    rows = v.table("orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("dt"))
    return sets.dedupe(rows, ["code", "dt"])


@query("duplicate_names", with_views("releases", body=NAMES_SQL + "SELECT code, count(DISTINCT company) AS n_names FROM ch GROUP BY code"))
def _dup_names(v: Views) -> DataFrame:
    return sets.duplicate_names(_name_changes(v))


@query("distinct_codes", "SELECT DISTINCT l_suppkey AS code FROM lineitem")
def _distinct_codes(v: Views) -> DataFrame:
    return readers.distinct_codes(v.bars)


@query("distinct_names", "SELECT DISTINCT p_name AS name FROM part")
def _distinct_names(v: Views) -> DataFrame:
    return readers.distinct_names(v.table("part").select(F.col("p_name").alias("name")))


@query("latest_bar", with_views("bars", body="SELECT code, max(dt) AS latest FROM bars GROUP BY code"))
def _latest_bar(v: Views) -> DataFrame:
    return writers.latest_bar(v.bars)


@query(
    "plan_incremental_update",
    with_views("bars", "listing", body="""SELECT code, CAST(max(dt)+1 AS DATE) AS start_date, DATE '2002-01-31' AS end_date FROM bars WHERE code%9<>4 GROUP BY code HAVING max(dt)<DATE '2001-09-15'
UNION ALL SELECT code, DATE '1995-01-01', DATE '2002-01-31' FROM listing WHERE code%9=4"""),
)
def _incremental(v: Views) -> DataFrame:
    stored = v.bars.where(F.col("code") % 9 != 4)
    return writers.plan_incremental_update(stored, v.listing, "2001-09-15", "1995-01-01", "2002-01-31")


# -- dates ------------------------------------------------------------------------------------------------------------


@query("calendar", with_views("calendar", body="SELECT dt, idx FROM calendar"))
def _calendar(v: Views) -> DataFrame:
    return v.calendar


WEEK_CAL = ", cal AS (SELECT dt FROM calendar WHERE isodow(dt)<6)"


def _weekdays(v: Views) -> DataFrame:
    return D.make_calendar(v.calendar.where(F.weekday("dt") < 5))


@query(
    "nearby_trade_date",
    with_views("calendar", body=WEEK_CAL + ", o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT k, o.dt, cal.dt AS trade_date FROM o ASOF LEFT JOIN cal ON o.dt>=cal.dt"),
)
def _nearby(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("dt"))
    return D.nearby_trade_date(o, _weekdays(v))


@query("latest_trade_date", with_views("calendar", body=WEEK_CAL + "SELECT max(dt) AS dt FROM cal WHERE dt<=DATE '2000-07-02'"))
def _latest_trade_date(v: Views) -> DataFrame:
    return D.latest_trade_date(_weekdays(v), "2000-07-02")


@query(
    "is_trade_day",
    with_views("calendar", body=WEEK_CAL + "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) IN (SELECT dt FROM cal) AS is_trade_day FROM orders"),
)
def _is_trade_day(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("dt"))
    return D.is_trade_day(o, _weekdays(v)).select("k", "is_trade_day")


PHASE_SQL = """CASE WHEN isodow(ts)>5 THEN 'closed' WHEN s<32400 THEN 'closed' WHEN s<33300 THEN 'pre-open' WHEN s<33930 THEN 'pre-open-call-phase-1'
WHEN s<34200 THEN 'pre-open-call-phase-2' WHEN s<41400 THEN 'continuous-trading' WHEN s<46800 THEN 'lunchbreak' WHEN s<53640 THEN 'continuous-trading'
WHEN s<53820 THEN 'continuous-trading-pre-close' WHEN s<54000 THEN 'pre-close-bidding' ELSE 'closed' END"""


@query(
    "market_phase",
    with_views("ticks", body=f"SELECT code, ts, {PHASE_SQL} AS phase FROM (SELECT *, hour(ts)*3600+minute(ts)*60+CAST(floor(second(ts)) AS INTEGER) AS s FROM ticks)"),
)
def _phase(v: Views) -> DataFrame:
    days = D.make_calendar(v.ticks.select("ts").where(F.weekday("ts") < 5), "ts")
    return D.market_phase(v.ticks, days).select("code", "ts", "phase")


@query(
    "date_conversions",
    """SELECT o_orderkey AS k, strftime(o_orderdate,'%Y%m%d') AS compact, strftime(o_orderdate,'%Y-%m-%d') AS iso,
CAST(o_orderdate AS DATE) AS back, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
)
def _dates(v: Views) -> DataFrame:
    o = v.table("orders").withColumn("compact", D.to_compact("o_orderdate"))
    return o.select(
        F.col("o_orderkey").alias("k"), "compact", D.to_iso("o_orderdate").alias("iso"), D.from_compact("compact").alias("back"),
        D.days_between(F.col("o_orderdate"), F.lit("1995-01-01")).cast("bigint").alias("days"),
    )


