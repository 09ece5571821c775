"""Orders, positions, account and code functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import codes as C, orders as O, scalar as S
from tickloom.operators import filters, ledger as L, portfolio as P
from tickloom.operators.series import CODE
from tickloom.workload.registry import query
from tickloom.workload.views import Views, r, with_views

BOOK = ("oledger", "positions")
SIDE_TOTALS = """, tot AS (SELECT code, CAST(sum(CASE WHEN direction='buy' THEN filled_vol ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN direction='sell' THEN filled_vol ELSE 0 END) AS BIGINT) AS s, CAST(sum(CASE WHEN direction='sell' THEN vol ELSE 0 END) AS BIGINT) AS p,
  CAST(sum(CASE WHEN direction='sell' AND status='cancelled' THEN vol-filled_vol ELSE 0 END) AS BIGINT) AS x FROM oledger GROUP BY code),
pos AS (SELECT id, code, price, latest_price, yesterday_vol, yesterday_vol+coalesce(b,0)-coalesce(s,0) AS vol,
  yesterday_vol-coalesce(p,0)+coalesce(x,0) AS avail_vol FROM positions LEFT JOIN tot USING (code))"""


@query("positions_from_orders", with_views(*BOOK, body=SIDE_TOTALS + "SELECT *, vol<0 OR avail_vol<0 AS invalid FROM pos"))
def _positions(v: Views) -> DataFrame:
    return L.positions_from_orders(v.positions, v.orders)


def _opening(v: Views) -> DataFrame:
    return v.capitals.agg(F.sum("market_value").alias("free_cash_amount"))


ACCOUNT = SIDE_TOTALS + f""", opening AS (SELECT sum(market_value) AS free FROM capitals),
flow AS (SELECT sum(CASE WHEN direction='buy' THEN price*vol ELSE 0 END) AS placed, sum(CASE WHEN direction='buy' THEN filled_price*filled_vol ELSE 0 END) AS filled,
  sum(CASE WHEN direction='buy' AND status='cancelled' THEN price*vol-filled_price*filled_vol ELSE 0 END) AS cancelled,
  sum(CASE WHEN direction='sell' THEN filled_price*filled_vol ELSE 0 END) AS sold FROM oledger),
acc AS (SELECT free-placed+cancelled+sold AS free_cash_amount, placed-filled-cancelled AS frozen_cash_amount,
  (SELECT sum({r('latest_price*vol')}) FROM pos) AS market_value FROM opening, flow)"""
MONEY = ["free_cash_amount", "frozen_cash_amount", "market_value"]


def _account(v: Views) -> DataFrame:
    return L.account_assets(v.orders, L.positions_from_orders(v.positions, v.orders), _opening(v))


@query(
    "account_assets",
    with_views(*BOOK, "capitals", body=ACCOUNT + f"SELECT {', '.join(f'{r(c, 1)} AS {c}' for c in MONEY)}, free_cash_amount<0 OR frozen_cash_amount<0 AS invalid FROM acc"),
)
def _account_assets(v: Views) -> DataFrame:
    return _account(v).select(*[S.rounded(c, 1).alias(c) for c in MONEY], "invalid")


@query("total_assets", with_views(*BOOK, "capitals", body=ACCOUNT + f"SELECT {r('market_value+free_cash_amount+frozen_cash_amount', 1)} AS total_asset_value FROM acc"))
def _total_assets(v: Views) -> DataFrame:
    return P.total_assets(_account(v)).select(S.rounded("total_asset_value", 1).alias("total_asset_value"))


@query("market_value", with_views("positions", body=f"SELECT {r('sum(' + r('latest_price*vol') + ')', 1)} AS market_value FROM positions"))
def _market_value(v: Views) -> DataFrame:
    return P.market_value(v.positions).select(S.rounded("market_value", 1).alias("market_value"))


@query("remaining_opens", with_views("oledger", body="SELECT count(*) FILTER (direction='buy') AS n_bought, greatest(0, 100000-count(*) FILTER (direction='buy')) AS remaining_opens FROM oledger"))
def _opened(v: Views) -> DataFrame:
    return P.opened_today(v.orders, 100_000)


ORDER = "id, code, timestamp, price, vol, filled_price, filled_vol, status, direction"
NOW = "1997-01-01 00:00:00"


def _ladder(v: Views) -> DataFrame:
    return v.orders.groupBy(CODE).agg(F.array(F.max("price")).alias("buy"), F.array(F.min("price")).alias("sell"))


@query(
    "expired_orders",
    with_views("oledger", body=f""", best AS (SELECT code, max(price) AS b, min(price) AS s FROM oledger GROUP BY code) SELECT {ORDER} FROM oledger JOIN best USING (code)
WHERE status<>'cancelled' AND vol>filled_vol AND epoch(TIMESTAMP '{NOW}')-epoch(timestamp)>=86400 AND price<>CASE WHEN direction='buy' THEN b ELSE s END"""),
)
def _expired(v: Views) -> DataFrame:
    return L.expired_orders(v.orders, _ladder(v), F.lit(NOW), 86_400.0)


def _exposure(v: Views) -> dict[str, DataFrame]:
    account = _opening(v).withColumns({"free_cash_amount": F.col("free_cash_amount") * 1000, "frozen_cash_amount": F.lit(0.0)})
    return L.exposure_check(v.orders, account, v.positions)


@query(
    "exposure_cash",
    with_views("oledger", "capitals", body=f""", t AS (SELECT (SELECT sum({r('price')}*vol) FROM oledger WHERE direction='buy') AS buy_total, (SELECT sum(market_value)*1000 FROM capitals) AS free)
SELECT {r('buy_total', 1)} AS buy_total, buy_total<=free AS accepted, {r('CASE WHEN buy_total<=free THEN free-buy_total ELSE free END', 1)} AS free_cash_amount,
  {r('CASE WHEN buy_total<=free THEN buy_total ELSE 0e0 END', 1)} AS frozen_cash_amount FROM t"""),
)
def _exposure_cash(v: Views) -> DataFrame:
    return _exposure(v)["cash"].withColumns({c: S.rounded(c, 1) for c in ("buy_total", "free_cash_amount", "frozen_cash_amount")})


GREEDY = """, asked AS (SELECT o.id, o.code, o.vol, p.avail_vol, row_number() OVER (PARTITION BY o.code ORDER BY o.timestamp, o.id) AS n
  FROM oledger o JOIN positions p ON p.code=o.code WHERE direction='sell'),
g AS (SELECT code, n, id, vol<=avail_vol AS accepted, avail_vol-CASE WHEN vol<=avail_vol THEN vol ELSE 0 END AS rest FROM asked WHERE n=1
  UNION ALL SELECT a.code, a.n, a.id, a.vol<=g.rest, g.rest-CASE WHEN a.vol<=g.rest THEN a.vol ELSE 0 END FROM g JOIN asked a ON a.code=g.code AND a.n=g.n+1)"""


@query("exposure_sells", with_views(*BOOK, body=GREEDY + f"SELECT {ORDER.replace('id, code', 'o.id, o.code')}, accepted FROM oledger o JOIN g ON g.id=o.id", recursive=True))
def _exposure_sells(v: Views) -> DataFrame:
    return _exposure(v)["sells"]


@query(
    "exposure_volumes",
    with_views(*BOOK, body=GREEDY + """, used AS (SELECT code, sum(vol) AS u FROM asked JOIN g USING (id, code) WHERE accepted GROUP BY code)
SELECT code, CAST(avail_vol-coalesce(u,0) AS BIGINT) AS avail_vol FROM positions LEFT JOIN used USING (code)""", recursive=True),
)
def _exposure_volumes(v: Views) -> DataFrame:
    return _exposure(v)["volumes"].select(CODE, "avail_vol")


# -- remarks and closed positions -----------------------------------------------------------------------------------


def _sells(v: Views) -> DataFrame:
    """Filled sells with their remark; every fifth remark is not one."""
    key = F.col("id").cast("bigint")
    action = F.element_at(F.array(F.lit(C.CLOSE), F.lit(C.TAKE_PROFIT), F.lit(C.STOP_LOSS)), (key % 3 + 1).cast("int"))
    pct = (key % 21 - 10).cast("double")
    remark = F.when(key % 5 == 0, F.lit("by hand")).otherwise(O.format_sell_remark(action, F.col("price"), F.col("vol"), pct))
    return v.orders.where((F.col("direction") == "sell") & (F.col("status") == "filled")).withColumn("remark", remark)


TWO = lambda x: f"CAST(CAST({r(x)} AS DECIMAL(20,2)) AS VARCHAR)"
SELLS = f""", sells AS (SELECT *, CASE WHEN CAST(id AS BIGINT)%5=0 THEN 'by hand' ELSE ['EX','TP','SL'][CAST(id AS BIGINT)%3+1]||':'||{TWO('price')}||','||CAST(vol AS VARCHAR)||','||{TWO('CAST(CAST(id AS BIGINT)%21-10 AS DOUBLE)')} END AS remark
  FROM oledger WHERE direction='sell' AND status='filled'),
parsed AS (SELECT *, CASE WHEN remark<>'by hand' THEN ['CLOSE','TAKE_PROFIT','STOP_LOSS'][CAST(id AS BIGINT)%3+1] END AS r_action,
  CASE WHEN remark<>'by hand' THEN {r('price')} END AS r_price, CASE WHEN remark<>'by hand' THEN CAST(CAST(id AS BIGINT)%21-10 AS DOUBLE) END AS r_pct FROM sells)"""


@query("sell_remarks", with_views("oledger", body=SELLS + "SELECT id, remark, r_action AS action, r_price AS price, CASE WHEN remark<>'by hand' THEN CAST(vol AS INTEGER) END AS vol, r_pct AS pct_chg FROM parsed"))
def _remarks(v: Views) -> DataFrame:
    return _sells(v).withColumn("p", O.parse_sell_remark("remark")).select("id", "remark", "p.action", "p.price", "p.vol", "p.pct_chg")


@query("serialize_tags", with_views("oledger", body="SELECT id, CASE WHEN vol>500 THEN 'side='||direction||';status='||status ELSE '' END AS tags FROM oledger"))
def _tags(v: Views) -> DataFrame:
    full = F.create_map(F.lit("side"), F.col("direction"), F.lit("status"), F.col("status"))
    tags = F.when(F.col("vol") > 500, full).otherwise(F.create_map().cast("map<string,string>"))
    return v.orders.select("id", O.serialize_tags(tags).alias("tags"))


def _day_end(v: Views) -> DataFrame:
    """Positions of which every second one was sold out."""
    left = F.when(F.col(CODE) % 2 == 0, F.lit(0).cast("bigint"))
    return v.positions.withColumns({"vol": F.coalesce(left, "vol"), "avail_vol": F.coalesce(left, "avail_vol")})


@query(
    "classify_closed",
    with_views(*BOOK, body=SELLS + f""", one AS (SELECT code, count(*) AS n, min(remark) AS remark, min(filled_price) AS sold FROM sells GROUP BY code),
c AS (SELECT p.*, yesterday_vol=0 AS fresh, yesterday_vol>0 AND p.code%2=0 AS shut, coalesce(n,0) AS n, sold, o.remark FROM positions p LEFT JOIN one o USING (code)),
d AS (SELECT c.*, r_action, r_price, r_pct, shut AND n=1 AND r_price IS NOT NULL AS good FROM c LEFT JOIN parsed q ON n=1 AND q.code=c.code WHERE fresh OR shut)
SELECT id, code, yesterday_vol, CASE WHEN code%2=0 THEN 0 ELSE vol END AS vol, CASE WHEN code%2=0 THEN 0 ELSE avail_vol END AS avail_vol,
  {r("CASE WHEN good THEN r_price/(1e0+r_pct*1e-2) ELSE price END", 6)} AS price, CASE WHEN good THEN sold ELSE latest_price END AS latest_price,
  CASE WHEN fresh THEN 'OPEN' WHEN good THEN r_action END AS action,
  CASE WHEN shut AND n=0 THEN 'no sell order' WHEN shut AND n>1 THEN 'several sell orders' WHEN shut AND NOT good THEN 'no readable remark' END AS problem FROM d"""),
)
def _classify(v: Views) -> DataFrame:
    return L.classify_closed(_day_end(v), _sells(v)).withColumn("price", S.rounded("price", 6))


# -- columns ----------------------------------------------------------------------------------------------------------


@query(
    "position_columns",
    with_views("positions", body=f"""SELECT id, {r('price*vol')} AS cost, {r('latest_price*vol')} AS value, {r(r('latest_price*vol') + '-' + r('price*vol'))} AS pnl, {r('latest_price-price')} AS chg,
  CASE WHEN {r('latest_price-price')}=0 THEN 0e0 ELSE {r('1e2*(latest_price-price)/price')} END AS pct_chg, vol=0 AND avail_vol=0 AS is_closed, yesterday_vol=0 AS is_new,
  CASE WHEN vol=0 THEN 0e0 ELSE {r(r('latest_price*vol') + '/vol')} END AS avg_price FROM positions"""),
)
def _position_columns(v: Views) -> DataFrame:
    return v.positions.select(
        "id", S.cost().alias("cost"), S.position_value().alias("value"), S.pnl_at("latest_price").alias("pnl"), S.chg_at("latest_price").alias("chg"),
        S.pct_chg_at("latest_price").alias("pct_chg"), S.is_closed().alias("is_closed"), S.is_new().alias("is_new"), S.avg_price(S.position_value(), "vol").alias("avg_price"),
    )


@query(
    "order_columns",
    with_views("oledger", body=f"""SELECT id, CASE WHEN status='cancelled' THEN vol-filled_vol ELSE 0 END AS cancelled_vol, vol-filled_vol AS pending_vol, filled_price*filled_vol AS filled_value,
  CASE WHEN status='cancelled' THEN price*vol-filled_price*filled_vol ELSE 0e0 END AS cancelled_value, price*vol AS placed_value, price-filled_price AS slip_points, status='filled' AS is_filled,
  CAST(epoch(TIMESTAMP '{NOW}')-epoch(timestamp) AS BIGINT) AS age_seconds FROM oledger"""),
)
def _order_columns(v: Views) -> DataFrame:
    names = ["cancelled_vol", "pending_vol", "filled_value", "cancelled_value", "placed_value", "slip_points", "is_filled", "age_seconds"]
    return O.with_order_columns(v.orders, F.lit(NOW)).select("id", *names)


@query("capital_log_row", with_views("capitals", body="SELECT run_id, DATE '1998-12-01' AS timestamp, market_value, free_cash_amount, frozen_cash_amount FROM capitals"))
def _capital_row(v: Views) -> DataFrame:
    return v.capitals.select("run_id", *O.capital_log_row(F.lit("1998-12-01").cast("date")))


@query("market_cap", with_views("bars", "listing", body="SELECT code, dt, close*total_share AS market_cap FROM bars JOIN listing USING (code)"))
def _market_cap(v: Views) -> DataFrame:
    return v.bars.join(v.listing, CODE).select(CODE, "dt", S.market_cap().alias("market_cap"))


#: A prefix of each market, two that no market has, and the markets and exchanges they belong to.
PREFIXES = {
    "600": ("上证主板", "SH"), "002": ("深证主板", "SZ"), "301": ("创业板", "SZ"), "688": ("科创板", "SH"), "830": ("北交所", "BJ"), "689": ("CDR", "SH"), "430": ("新三板", None), "999": (None, None), "500": (None, None),
}


def coded(df: DataFrame, key: str) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col(key) % len(PREFIXES) + 1).cast("int"))
    return df.withColumn(CODE, F.concat(prefix, F.lpad((F.col(key) % 1000).cast("string"), 3, "0")))


def _list(i: int) -> str:
    return "[" + ",".join("NULL" if x[i] is None else f"'{x[i]}'" for x in PREFIXES.values()) + "]"


CODED = f"""WITH coded AS (SELECT c_custkey AS k, {list(PREFIXES)}[c_custkey%{len(PREFIXES)}+1]||lpad(CAST(c_custkey%1000 AS VARCHAR),3,'0') AS code,
  {_list(0)}[c_custkey%{len(PREFIXES)}+1] AS market, {_list(1)}[c_custkey%{len(PREFIXES)}+1] AS exchange FROM customer) """


def _coded(v: Views) -> DataFrame:
    return coded(v.table("customer").select(F.col("c_custkey").alias("k")), "k")


@query("code_functions", CODED + "SELECT k, code, market, exchange, code||'.'||exchange AS suffixed, code AS bare FROM coded")
def _code_functions(v: Views) -> DataFrame:
    full = C.with_exchange(CODE)
    return _coded(v).select("k", CODE, C.market_of(CODE).alias("market"), C.exchange_of(CODE).alias("exchange"), full.alias("suffixed"), C.without_exchange(F.coalesce(full, CODE)).alias("bare"))


@query("tradable_markets", CODED + "SELECT k, code, market FROM coded WHERE market IN ('上证主板','深证主板','创业板')")
def _tradable(v: Views) -> DataFrame:
    return filters.tradable_markets(_coded(v))


_BROKER = ["ORDER_SUCCEEDED", "ORDER_PART_CANCEL", "ORDER_REPORTED", "ORDER_JUNK", "no such state"]
_STATES = ["filled", "cancelled", "pending", "invalid", "unknown"]
_INDEX = ["sh000001", "sz399006", "sh000300", "sh999999"]
_INDEX_NAMES = "['SSE','ChiNext','CSI-300',NULL]"


@query(
    "broker_codes",
    with_views("oledger", body=f"""SELECT id, {_STATES}[CAST(id AS BIGINT)%5+1] AS status, direction AS side, {_INDEX_NAMES}[CAST(id AS BIGINT)%4+1] AS index_name,
  CASE WHEN CAST(id AS BIGINT)%4<3 THEN {_INDEX}[CAST(id AS BIGINT)%4+1] END AS index_code FROM oledger"""),
)
def _broker(v: Views) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("id").cast("bigint") % len(values) + 1).cast("int"))
    side = F.concat(F.lit("STOCK_"), F.upper("direction"))
    name = C.index_name(pick(_INDEX))
    return v.orders.select("id", C.order_status(pick(_BROKER)).alias("status"), C.order_side(side).alias("side"), name.alias("index_name"), C.index_code(name).alias("index_code"))
