"""Every query of the engine by name, with the DuckDB SQL that gives the same rows.

Doubles are rounded to 6 decimals on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.scalars import money_text
from tessera.operators import benchmark, forecast, frontier, fundamentals, hedge, ml, panel, risk, screen
from tessera.plans import fixtures_sql as X
from tessera.plans import portfolio
from tessera.schemas import FRACTIONS, METRICS
from tessera.sources import store
from tessera.sources import tables as S
from tessera.streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BUDGET, RATE, START = 10_000.0, 0.04, "2024-01-01"
PAIR = ("click_0", "view_0")
CRITERIA = [
    {"metric": "P/E", "operator": "Under", "value": "1,000"},
    {"metric": "ROE", "operator": "Over", "value": "4%"},
    {"metric": "Profit Margin", "operator": ">", "value": "0"},
    {"metric": "Debt/Equity", "operator": "Under", "value": "abc"},
    {"metric": "Beta", "operator": "Over", "value": "1"},
    {"metric": "PEG", "operator": "Near", "value": "1"},
]
LEGACY = {"Index": "S&P 500", "P/E": "Under 500 or so", "Price": "Over 950", "P/B": "Over"}
_BASE = "ticker, company, sector, industry"
_NUMBERS = ["price", "market_cap", "pe", "forward_pe", "pb", "ps", "peg", "debt_equity", "roe", "roa", "profit_margin"]
PERIODS = [f"{y}-12-31" for y in range(2001, 1994, -1)]


def _six(x: Column) -> Column:
    """To 6 decimals as the SQL's round does it, by a product: 941.8 / 640 is a little below 1.4715625 and gives 1.471563."""
    return F.when(F.abs(x) < 1e300, F.round(x * 1e6) / 1e6).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, without negative zero."""
    return df.select(*[(_six(F.col(f.name)) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql:
        ORACLE[name] = sql


def _r(*columns: str) -> str:
    """The rounded columns; ``name=expression`` or a name."""
    return ", ".join(f"round({c.partition('=')[2] or c}, 6) + 0.0 AS {c.partition('=')[0]}" for c in columns)


_W = "PARTITION BY ticker ORDER BY dt"


def _guard(agg: str, x: str, n: int, count: str | None = None) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({count or x}) {frame} = {n} THEN {agg}({x}) {frame} END"


# --- panels ----------------------------------------------------------------------------------

add(
    "scan_history",
    lambda s, d: S.history(S.px_daily(s, d), ["click_0", "view_1", "error_2"], "2024-01-05", "2024-01-20"),
    f"WITH {X.PX_DAILY} SELECT ticker, dt, {_r('close', 'volume')} FROM px_daily WHERE ticker IN ('click_0', 'view_1', 'error_2') AND dt >= DATE '2024-01-05' AND dt < DATE '2024-01-20'",
)
_GRID = "g AS (SELECT t.ticker, c.dt, p.close FROM (SELECT DISTINCT ticker FROM {p}) t CROSS JOIN (SELECT DISTINCT dt FROM {p}) c LEFT JOIN {p} p ON p.ticker = t.ticker AND p.dt = c.dt)"
_FILL = f"last_value(close IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add(
    "panel_fetch_ffill",
    lambda s, d: panel.fetch(S.px_monthly(s, d)),
    f"WITH {X.PX_MONTHLY}, {_GRID.format(p='px_monthly')}, f AS (SELECT ticker, dt, {_FILL} AS close FROM g) SELECT ticker, dt, {_r('close')} FROM f WHERE close IS NOT NULL",
)
add(
    "panel_scrub",
    lambda s, d: panel.scrub(S.px_sparse(s, d)),
    f"""WITH {X.PX_SPARSE}, p AS (SELECT ticker, dt, nullif(CASE WHEN isinf(close) OR isnan(close) THEN NULL ELSE close END, 0) AS close FROM px_sparse), {_GRID.format(p='p')},
f AS (SELECT ticker, dt, {_FILL} AS close FROM g),
b AS (SELECT ticker, dt, first_value(close IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM f)
SELECT ticker, dt, {_r('close')} FROM b WHERE ticker NOT IN (SELECT ticker FROM b GROUP BY ticker HAVING count(*) > count(close) OR max(close) > 1e8)""",
)
add(
    "liveness",
    lambda s, d: panel.liveness(S.px_sparse(s, d)),
    f"WITH {X.PX_SPARSE} SELECT ticker, max(dt) AS last_dt, max(dt) >= (SELECT max(dt) FROM px_sparse) - 14 AS alive FROM px_sparse WHERE close IS NOT NULL GROUP BY ticker",
)
add("latest_price", lambda s, d: panel.ends(S.px_daily(s, d)), f"WITH {X.PX_DAILY} SELECT ticker, {_r('first_close=min_by(close, dt)', 'last_close=max_by(close, dt)')} FROM px_daily GROUP BY ticker")
_LAG = f"lag(close) OVER ({_W})"
add("returns_simple", lambda s, d: hedge.returns(S.px_daily(s, d)), f"WITH {X.PX_DAILY}, x AS (SELECT ticker, dt, close / nullif({_LAG}, 0) - 1 AS r FROM px_daily) SELECT ticker, dt, {_r('r')} FROM x WHERE r IS NOT NULL")
_LOG = f"CASE WHEN close > 0 AND {_LAG} > 0 THEN ln(close / {_LAG}) END"
add("returns_log", lambda s, d: hedge.log_returns(S.px_daily(s, d)), f"WITH {X.PX_DAILY}, x AS (SELECT ticker, dt, {_LOG} AS r FROM px_daily) SELECT ticker, dt, {_r('r')} FROM x WHERE r IS NOT NULL")
add(
    "moving_averages",
    lambda s, d: S.px_daily(s, d).select("ticker", "dt", *[W.rolling(F.col("close"), n, F.avg).alias(f"ma{n}") for n in (7, 21)]),
    f"WITH {X.PX_DAILY}, x AS (SELECT ticker, dt, {_guard('avg', 'close', 7)} AS ma7, {_guard('avg', 'close', 21)} AS ma21 FROM px_daily) SELECT ticker, dt, {_r('ma7', 'ma21')} FROM x",
)
add(
    "regression_features",
    lambda s, d: panel.regression_features(S.px_sparse(s, d)).drop("close"),
    f"""WITH {X.PX_SPARSE}, x AS (SELECT ticker, dt, row_number() OVER ({_W}) - 1 AS t, {_guard('avg', 'close', 7)} AS ma7, {_guard('avg', 'close', 21)} AS ma21, {_LAG} AS lag1, volume,
close - {_LAG} AS change FROM px_sparse) SELECT ticker, dt, t, {_r('ma7', 'ma21', 'lag1', 'volume', 'change')} FROM x WHERE ma21 IS NOT NULL AND lag1 IS NOT NULL AND volume IS NOT NULL""",
)
_RSI = f"""100 - 100 / (1 + ({_guard('avg', 'greatest(coalesce(change, 0), 0)', 14)}) / (({_guard('avg', 'greatest(-coalesce(change, 0), 0)', 14)}) + 1e-10))"""
add(
    "ml_features",
    lambda s, d: panel.ml_features(S.px_sparse(s, d)),
    f"""WITH {X.PX_SPARSE}, b AS (SELECT *, {_LOG} AS log_ret, close - {_LAG} AS change FROM px_sparse),
x AS (SELECT ticker, dt, log_ret, {_guard('sum', 'log_ret', 5)} AS ret5, {_guard('sum', 'log_ret', 20)} AS ret20, ({_guard('avg', 'close', 5)}) / nullif(close, 0) AS ma5,
({_guard('avg', 'close', 20)}) / nullif(close, 0) AS ma20, ({_guard('avg', 'close', 50)}) / nullif(close, 0) AS ma50, {_guard('stddev_samp', 'log_ret', 10)} AS vol10, {_guard('stddev_samp', 'log_ret', 20)} AS vol20,
{_RSI} AS rsi, lead(log_ret) OVER ({_W}) AS target FROM b)
SELECT ticker, dt, {_r('log_ret', 'ret5', 'ret20', 'ma5', 'ma20', 'ma50', 'vol10', 'vol20', 'rsi', 'target')} FROM x""",
)
add(
    "rsi14",
    lambda s, d: S.px_daily(s, d).withColumn("change", F.col("close") - W.previous("close")).select("ticker", "dt", W.rsi(F.col("change")).alias("rsi")),
    f"WITH {X.PX_DAILY}, b AS (SELECT *, close - {_LAG} AS change FROM px_daily), x AS (SELECT ticker, dt, {_RSI} AS rsi FROM b) SELECT ticker, dt, {_r('rsi')} FROM x",
)


def _ema(p: str) -> str:
    """The closed form of the recursion: n (rows, numbered), e (ticker, dt, k, s)."""
    return f"""n AS (SELECT *, row_number() OVER ({_W}) - 1 AS k FROM {p} WHERE close IS NOT NULL),
e AS (SELECT a.ticker, a.dt, a.k, sum(b.close * pow(0.7::DOUBLE, a.k - b.k) * CASE WHEN b.k = 0 THEN 1 ELSE 0.3::DOUBLE END) AS s FROM n a JOIN n b ON a.ticker = b.ticker AND b.k <= a.k GROUP BY 1, 2, 3)"""


add("ema", lambda s, d: S.px_daily(s, d).select("ticker", "dt", W.ema().alias("ema")), f"WITH {X.PX_DAILY}, {_ema('px_daily')} SELECT ticker, dt, {_r('ema=s')} FROM e")
add(
    "cumulative_log_return",
    lambda s, d: S.px_monthly(s, d).withColumn("r", W.log_return()).select("ticker", "dt", W.running_sum(F.col("r")).alias("cum")),
    f"WITH {X.PX_MONTHLY}, x AS (SELECT ticker, dt, {_LOG} AS r FROM px_monthly) SELECT ticker, dt, round(sum(r) OVER ({_W}), 6) + 0.0 AS cum FROM x",
)
add(
    "lookback_sequences",
    lambda s, d: S.px_daily(s, d).withColumn("q", W.lookback("close", 5)).where("q is not null")
    .select("ticker", "dt", F.size("q").cast("long").alias("n"), F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("seq_sum")),
    f"""WITH {X.PX_DAILY}, x AS (SELECT ticker, dt, count(close) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n, sum(close) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seq_sum FROM px_daily)
SELECT ticker, dt, n, {_r('seq_sum')} FROM x WHERE n = 5""",
)

# --- screener --------------------------------------------------------------------------------

_ALL = f"{_BASE}, {_r(*_NUMBERS)}"
add("screen_criteria", lambda s, d: screen.screen(S.fundamentals(s, d), CRITERIA), f"WITH {X.FUNDAMENTALS} SELECT {_ALL} FROM fundamentals WHERE pe < 1000 AND roe > 0.04 AND profit_margin > 0")
add("screen_legacy", lambda s, d: screen.screen(S.fundamentals(s, d), screen.legacy_criteria(LEGACY)), f"WITH {X.FUNDAMENTALS} SELECT {_ALL} FROM fundamentals WHERE pe < 500 AND price > 950")
add(
    "screen_group",
    lambda s, d: screen.screen(screen.of_group(S.fundamentals(s, d), S.ticker_groups(s, d), "PROMO", aliases=False), [{"metric": "P/B", "operator": "<", "value": "10"}]),
    f"WITH {X.FUNDAMENTALS}, {X.TICKER_GROUPS} SELECT {_ALL} FROM fundamentals WHERE pb < 10 AND ticker IN (SELECT symbol FROM ticker_groups WHERE group_name = 'PROMO')",
)
add(
    "screen_top",
    lambda s, d: screen.screen(S.fundamentals(s, d), [{"metric": "Price", "operator": "Over", "value": "100"}], order_by="market_cap", limit=25).select("ticker", "market_cap"),
    f"WITH {X.FUNDAMENTALS}, t AS (SELECT ticker, market_cap FROM fundamentals WHERE price > 100 ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 25) SELECT ticker, {_r('market_cap')} FROM t",
)
add(
    "screen_formatted",
    lambda s, d: S.fundamentals(s, d).select("ticker", money_text(F.floor("market_cap").cast("double")).alias("cap_txt"), F.when(F.col("pe").isNull(), "-").otherwise("x").alias("pe_txt")),
    f"""WITH {X.FUNDAMENTALS}, f AS (SELECT ticker, floor(market_cap) AS m, pe FROM fundamentals) SELECT ticker, CASE WHEN m IS NULL THEN '-' WHEN m > 1e9 THEN printf('$%.2fB', m / 1e9)
WHEN m > 1e6 THEN printf('$%.2fM', m / 1e6) ELSE printf('$%.2f', m) END AS cap_txt, CASE WHEN pe IS NULL THEN '-' ELSE 'x' END AS pe_txt FROM f""",
)
_TEXT = {"money": "CASE WHEN {0} IS NULL THEN '-' WHEN {0} > 1e9 THEN printf('$%.2fB', {0} / 1e9) WHEN {0} > 1e6 THEN printf('$%.2fM', {0} / 1e6) ELSE printf('$%.2f', {0}) END",
         "fraction": "CASE WHEN {0} IS NULL THEN '-' ELSE printf('%.2f%%', {0} * 100) END", "ratio": "CASE WHEN {0} IS NULL THEN '-' ELSE printf('%.2f', {0}) END"}


def _text(metric: str, column: str) -> str:
    """The display text; off the ties at half a cent, which engines round apart."""
    kind = "fraction" if metric in FRACTIONS else "money" if metric in ("Price", "Market Cap") else "ratio"
    return f"{_TEXT[kind].format(column)} AS {column}_txt"


def _off_ties(f: DataFrame) -> DataFrame:
    return f.withColumns({c: F.floor(F.col(c) * 1e6) / 1e6 + 1e-7 for c in METRICS.values()})


add(
    "screen_formatted_all",
    lambda s, d: screen.formatted(_off_ties(S.fundamentals(s, d))),
    f"WITH {X.FUNDAMENTALS}, f AS (SELECT ticker, {', '.join(f'floor({c} * 1e6) / 1e6 + 1e-7::DOUBLE AS {c}' for c in METRICS.values())} FROM fundamentals) SELECT ticker, {', '.join(_text(m, c) for m, c in METRICS.items())} FROM f",
)
add("screen_export", lambda s, d: screen.export(screen.screen(S.fundamentals(s, d), CRITERIA[:1])), f"WITH {X.FUNDAMENTALS} SELECT ticker AS \"Symbol\" FROM fundamentals WHERE pe < 1000")

# --- hedge -----------------------------------------------------------------------------------

_RET = "x AS (SELECT ticker, dt, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY dt), 0) - 1 AS r FROM px_daily), r AS (SELECT * FROM x WHERE r IS NOT NULL)"
_CORR = "covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0)"
add(
    "hedge_pair",
    lambda s, d: hedge.pair(S.px_daily(s, d), *PAIR).drop("ticker1", "ticker2"),
    f"""WITH {X.PX_DAILY}, {_RET}, c AS (SELECT {_CORR} AS r, count(*) AS n FROM r a JOIN r b ON a.dt = b.dt WHERE a.ticker = 'click_0' AND b.ticker = 'view_0')
SELECT {_r('r')}, n, CASE WHEN r < -0.5 THEN 1 ELSE 0 END::INTEGER AS is_hedge, CASE WHEN r IS NULL THEN NULL WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.5 THEN 'Moderate' ELSE 'Weak' END AS strength FROM c""",
)
add(
    "hedge_matrix",
    lambda s, d: hedge.matrix(S.px_daily(s, d)),
    f"WITH {X.PX_DAILY}, {_RET} SELECT a.ticker AS i, b.ticker AS j, round({_CORR}, 6) + 0.0 AS r, count(*) AS n FROM r a JOIN r b ON a.dt = b.dt AND a.ticker < b.ticker GROUP BY 1, 2",
)
add("hedge_pvalue", lambda s, d: hedge.pvalues(S.px_daily(s, d)))

# --- benchmark -------------------------------------------------------------------------------

_SHARES = "sh AS (SELECT w.ticker, CASE WHEN f.first > 0 THEN 10000 * w.weight / nullif(f.first, 0) ELSE 0 END AS shares FROM weights w JOIN (SELECT ticker, min_by(close, dt) AS first FROM px_daily WHERE close IS NOT NULL GROUP BY ticker) f ON f.ticker = w.ticker)"
_PORT = "port AS (SELECT dt, sum(shares * close) AS value FROM px_daily JOIN sh ON sh.ticker = px_daily.ticker GROUP BY dt HAVING sum(shares * close) > 0)"
_INDEX = "ind AS (SELECT dt, 10000 * close / nullif((SELECT min_by(close, dt) FROM idx_daily), 0) AS value FROM idx_daily)"
_FREE = "free AS (SELECT dt, 10000 * pow(1.04::DOUBLE, date_diff('day', DATE '2024-01-01', dt) / 365.0::DOUBLE) AS value FROM (SELECT dt FROM px_daily WHERE ticker IN (SELECT ticker FROM weights) UNION SELECT dt FROM idx_daily))"
_BENCH = f"WITH {X.PX_DAILY}, {X.IDX_DAILY}, {X.WEIGHTS}, {_SHARES}, {_PORT}, {_INDEX}, {_FREE}"
add("bench_shares", lambda s, d: benchmark.shares(S.px_daily(s, d), S.weights(s, d), BUDGET), f"{_BENCH} SELECT ticker, {_r('shares')} FROM sh")
add("bench_portfolio", lambda s, d: benchmark.portfolio(S.px_daily(s, d), S.weights(s, d), BUDGET), f"{_BENCH} SELECT dt, {_r('value')} FROM port")
add("bench_index", lambda s, d: benchmark.index(S.idx_daily(s, d), BUDGET), f"{_BENCH} SELECT dt, {_r('value')} FROM ind")


def _mine(s: SparkSession, d: str) -> DataFrame:
    return S.px_daily(s, d).join(S.weights(s, d).select("ticker"), "ticker", "left_semi")


add("bench_riskfree", lambda s, d: benchmark.riskfree(_mine(s, d), S.idx_daily(s, d), BUDGET, RATE, START), f"{_BENCH} SELECT dt, {_r('value')} FROM free")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return benchmark.timelines(S.px_daily(s, d), S.idx_daily(s, d), S.weights(s, d), BUDGET, RATE, START)


_UNION = "u AS (SELECT 'portfolio' AS series, * FROM port UNION ALL SELECT 'index', * FROM ind UNION ALL SELECT 'risk_free', * FROM free)"
add(
    "bench_summary",
    lambda s, d: benchmark.summary(_lines(s, d), BUDGET),
    f"{_BENCH}, {_UNION}, f AS (SELECT series, max_by(value, dt) AS final FROM u GROUP BY series) SELECT series, {_r('initial=10000::DOUBLE', 'final', 'pl=final - 10000', 'pct=(final - 10000) / 10000 * 100')} FROM f",
)
add(
    "bench_timelines",
    lambda s, d: benchmark.drawdown(_lines(s, d)),
    f"{_BENCH}, {_UNION} SELECT series, dt, {_r('value', 'change=100 * (value / nullif(first_value(value) OVER (PARTITION BY series ORDER BY dt), 0) - 1)')} FROM u",
)

# --- fundamentals ----------------------------------------------------------------------------

add(
    "ratio_debt",
    lambda s, d: fundamentals.debt_ratio(S.statements(s, d)).drop("debt_ratio_txt"),
    f"""WITH {X.STATEMENTS}, p AS (SELECT ticker, period, max(CASE WHEN row_label = 'Total Liabilities' THEN value END) AS debt, max(CASE WHEN row_label = 'Total Assets' THEN value END) AS assets
FROM statements WHERE stmt = 'balance' GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM p)
SELECT ticker, period, {_r('debt_ratio=debt / nullif(assets, 0)')} FROM l WHERE k = 1""",
)
_DEBT = f"""WITH {X.STATEMENTS}, p AS (SELECT ticker, period, max(CASE WHEN row_label = 'Total Liabilities' THEN value END) AS debt, max(CASE WHEN row_label = 'Total Assets' THEN value END) AS assets
FROM statements WHERE stmt = 'balance' GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS k FROM p),
t AS (SELECT ticker, period, CASE WHEN debt / nullif(assets, 0) IS NULL THEN 'N/A' ELSE printf('%.2f', debt / nullif(assets, 0)) END AS debt_ratio_txt FROM l WHERE k = 1)"""
add("ratio_debt_text", lambda s, d: fundamentals.debt_ratio(S.statements(s, d)).drop("debt_ratio"), f"{_DEBT} SELECT ticker, period, debt_ratio_txt FROM t")


def _quoted(s: SparkSession, d: str) -> DataFrame:
    """Each ticker's ratios of one statement's totals to another's, as a company's quoted ratios."""
    total = lambda stmt: F.sum(F.when(F.col("stmt") == stmt, F.col("value")))
    per = lambda a, b: total(a) / F.nullif(total(b), F.lit(0.0))
    return S.statements(s, d).groupBy("ticker").agg(
        per("income", "cash").alias("trailing_pe"), per("balance", "cash").alias("price_to_book"), per("income", "balance").alias("price_to_sales"), per("cash", "none").alias("current_ratio")
    )


def _per(a: str, b: str) -> str:
    x = f"sum(CASE WHEN stmt = '{a}' THEN value END) / nullif(sum(CASE WHEN stmt = '{b}' THEN value END), 0)"
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE printf('%.2f', {x}) END"


add(
    "key_ratios",
    lambda s, d: fundamentals.key_ratios(_quoted(s, d), S.statements(s, d)),
    f"""{_DEBT}, c AS (SELECT ticker, {_per('income', 'cash')} AS trailing_pe, {_per('balance', 'cash')} AS price_to_book, {_per('income', 'balance')} AS price_to_sales, {_per('cash', 'none')} AS current_ratio
FROM statements GROUP BY ticker) SELECT c.*, coalesce(t.debt_ratio_txt, 'N/A') AS debt_ratio FROM c LEFT JOIN t ON t.ticker = c.ticker""",
)
add(
    "statement_pivot",
    lambda s, d: fundamentals.pivot(S.statements(s, d), "NATION_3", "income", PERIODS),
    f"WITH {X.STATEMENTS} SELECT row_label, " + ", ".join(f"round(max(CASE WHEN period = DATE '{p}' THEN value END), 6) + 0.0 AS p{p.replace('-', '_')}" for p in PERIODS)
    + " FROM statements WHERE stmt = 'income' AND ticker = 'NATION_3' GROUP BY row_label",
)


def _company(s: SparkSession, d: str) -> DataFrame:
    f = S.fundamentals(s, d)
    return f.select("ticker", F.when(F.col("sector") == "Brand#1", 0.0).otherwise(F.col("market_cap")).alias("market_cap"), F.col("price").alias("total_assets"))


add(
    "market_caps",
    lambda s, d: fundamentals.market_caps(_company(s, d)),
    f"WITH {X.FUNDAMENTALS}, c AS (SELECT ticker, coalesce(nullif(CASE WHEN sector = 'Brand#1' THEN 0 ELSE market_cap END, 0), nullif(price, 0)) AS cap FROM fundamentals) SELECT ticker, {_r('cap')} FROM c WHERE cap IS NOT NULL",
)

# --- forecasts -------------------------------------------------------------------------------

_CAGR = """CASE WHEN count(close) < 2 THEN 0 WHEN min_by(close, dt) > 0 AND max_by(close, dt) > 0
THEN pow(max_by(close, dt) / nullif(min_by(close, dt), 0), 252.0::DOUBLE / count(close)) - 1 ELSE -0.99 END"""
add("forecast_cagr", lambda s, d: forecast.cagr(S.px_daily(s, d)), f"WITH {X.PX_DAILY} SELECT ticker, {_r(f'mu={_CAGR}', 'uncertainty=0::DOUBLE')} FROM px_daily WHERE close IS NOT NULL GROUP BY ticker")


def _ols(rows: str, value: str, k: int, least: int, name: str) -> str:
    return f"""{name}_l AS (SELECT ticker, dt, {value} AS v, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back, count(*) OVER (PARTITION BY ticker) AS n FROM {rows}),
{name}_o AS (SELECT ticker, max(n) AS n, count(*) AS k, regr_slope(v, CAST(least(n, {k}) - back AS DOUBLE)) AS slope, regr_intercept(v, CAST(least(n, {k}) - back AS DOUBLE)) AS icpt, max_by(v, dt) AS last FROM {name}_l WHERE back <= {k} GROUP BY ticker),
{name} AS (SELECT ticker, CASE WHEN n < {least} OR last <= 0 THEN 0.05 ELSE coalesce((icpt + slope * (k + 252)) / nullif(last, 0) - 1, 0.05) END AS f FROM {name}_o)"""


_VOL = f"""va_r AS (SELECT ticker, close / nullif({_LAG}, 0) - 1 AS r FROM px_monthly), va AS (SELECT ticker, CASE WHEN count(*) < 30 OR count(r) < 10 THEN 0.05
ELSE avg(r) * 252 * CASE WHEN stddev_pop(r) > 0.05 THEN 0.8 ELSE 1 END END AS f FROM va_r GROUP BY ticker)"""
_FORECASTS = f"WITH {X.PX_MONTHLY}, {_ema('px_monthly')}, {_ols('e', 's', 30, 2, 'es')}, {_ols('px_monthly', 'close', 90, 10, 'tr')}, {_VOL}"
for _name, _f, _t in (("forecast_expsmooth", forecast.exp_smoothing, "es"), ("forecast_trend", forecast.trend, "tr"), ("forecast_voladj", forecast.vol_adjusted, "va")):
    add(_name, lambda s, d, f=_f: f(S.px_monthly(s, d)), f"{_FORECASTS} SELECT ticker, {_r('f')} FROM {_t}")
_MIX = "CASE WHEN n.n < 10 THEN 0.05 ELSE greatest(-0.5, least(1, 0.4 * es.f + 0.3 * tr.f + 0.3 * va.f)) END"
add(
    "forecast_lightweight",
    lambda s, d: forecast.forecast(S.px_monthly(s, d), "LIGHTWEIGHT").select("ticker", "mu", "uncertainty"),
    f"{_FORECASTS}, m AS (SELECT es.ticker, {_MIX} AS mu FROM es JOIN tr ON tr.ticker = es.ticker JOIN va ON va.ticker = es.ticker JOIN (SELECT ticker, count(*) AS n FROM px_monthly GROUP BY ticker) n ON n.ticker = es.ticker) SELECT ticker, {_r('mu', 'uncertainty=0.05::DOUBLE')} FROM m",
)
add("forecast_arima", lambda s, d: ml.arima(S.px_sparse(s, d)))
add("forecast_boost", lambda s, d: ml.boost(S.px_sparse(s, d)))
add("forecast_ensemble", lambda s, d: forecast.forecast(S.px_sparse(s, d), "Ensemble"))


def _vote(s: SparkSession, d: str) -> DataFrame:
    """The vote over three given forecasts a ticker, of which some are infinite and some absent."""
    per = S.px_daily(s, d).groupBy("ticker").agg(F.count("close").alias("n"), F.avg("close").alias("m"), F.min("close").alias("lo"), F.max("close").alias("hi"))
    odd = F.when(F.col("n") % 2 == 0, float("inf")).otherwise(F.col("hi") / F.col("m") - 1)
    given = F.array(F.col("m") / F.col("lo") - 1, odd, F.when(F.col("n") % 3 != 0, F.col("lo") / F.col("hi")))
    return ml.vote(per.select("ticker", F.explode(given).alias("f")))


add(
    "ensemble_vote",
    _vote,
    f"""WITH {X.PX_DAILY}, p AS (SELECT ticker, count(close) AS n, avg(close) AS m, min(close) AS lo, max(close) AS hi FROM px_daily GROUP BY ticker),
f AS (SELECT ticker, m / lo - 1 AS f FROM p UNION ALL SELECT ticker, CASE WHEN n % 2 = 0 THEN NULL ELSE hi / m - 1 END FROM p UNION ALL SELECT ticker, CASE WHEN n % 3 <> 0 THEN lo / hi END FROM p),
v AS (SELECT ticker, coalesce(avg(f), 0.08::DOUBLE) AS mu, CASE WHEN count(f) > 1 THEN stddev_pop(f) ELSE 0.05::DOUBLE END AS uncertainty, count(f) AS members FROM f GROUP BY ticker)
SELECT ticker, {_r('mu', 'uncertainty')}, members FROM v""",
)
add("price_regression", lambda s, d: ml.price_regression(S.px_sparse(s, d)))
add("price_projection", lambda s, d: ml.price_projection(S.px_sparse(s, d), 30))

# --- risk and allocation ---------------------------------------------------------------------

add(
    "covariance",
    lambda s, d: risk.covariance(S.px_daily(s, d)),
    f"WITH {X.PX_DAILY}, {_RET} SELECT a.ticker AS i, b.ticker AS j, round(covar_pop(a.r, b.r), 6) + 0.0 AS c FROM r a JOIN r b ON a.dt = b.dt AND a.ticker <= b.ticker GROUP BY 1, 2",
)
_LW = f"""WITH {X.PX_DAILY}, {_GRID.format(p='px_daily')}, f AS (SELECT ticker, dt, {_FILL} AS close FROM g), x AS (SELECT ticker, dt, close / nullif({_LAG}, 0) - 1 AS r FROM f WHERE close IS NOT NULL),
r AS (SELECT * FROM x WHERE r IS NOT NULL), full_ AS (SELECT t.ticker, c.dt, coalesce(r.r, 0) AS r FROM (SELECT DISTINCT ticker FROM r) t CROSS JOIN (SELECT DISTINCT dt FROM r) c LEFT JOIN r ON r.ticker = t.ticker AND r.dt = c.dt),
z AS (SELECT ticker, dt, r - avg(r) OVER (PARTITION BY ticker) AS x FROM full_),
pr AS (SELECT a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / count(*) AS e, sum(a.x * a.x * b.x * b.x) AS q, count(*)::DOUBLE AS n FROM z a JOIN z b ON a.dt = b.dt GROUP BY 1, 2),
ag AS (SELECT sum(e * e) AS ee, sum(CASE WHEN i = j THEN e ELSE 0 END) AS tr, sum(q) AS qq, max(n) AS n, sum(CASE WHEN i = j THEN 1 ELSE 0 END)::DOUBLE AS p FROM pr),
sk AS (SELECT tr / p AS m, (qq / n - ee) / (p * n) AS beta, (ee - 2 * tr / p * tr + tr * tr / p) / p AS delta FROM ag), sh AS (SELECT m, coalesce(least(beta, delta) / nullif(delta, 0), 0) AS s FROM sk),
lw AS (SELECT i, j, 252 * ((1 - s) * e + s * CASE WHEN i = j THEN m ELSE 0 END) AS c, s FROM pr, sh)"""
add("ledoit_wolf", lambda s, d: risk.ledoit_wolf(S.px_daily(s, d)), f"{_LW} SELECT i, j, {_r('c', 'shrinkage=s')} FROM lw")
_DELTA = "SELECT coalesce((252 * avg(r) - 0.04) / nullif(252 * var_samp(r), 0), 2.5) AS delta FROM (SELECT close / nullif(lag(close) OVER (ORDER BY dt), 0) - 1 AS r FROM idx_daily)"
add("risk_aversion", lambda s, d: risk.risk_aversion(S.idx_daily(s, d), RATE), f"WITH {X.IDX_DAILY}, q AS ({_DELTA}) SELECT {_r('delta')} FROM q")


def _caps(s: SparkSession, d: str) -> DataFrame:
    return S.market_caps(s, d).withColumnRenamed("market_cap", "cap")


def _prior(s: SparkSession, d: str, cov: DataFrame | None = None) -> DataFrame:
    return risk.implied_prior(cov or risk.ledoit_wolf(S.px_daily(s, d)), _caps(s, d), risk.risk_aversion(S.idx_daily(s, d), RATE), RATE)


add(
    "implied_prior",
    _prior,
    f"{_LW}, {X.MARKET_CAPS}, {X.IDX_DAILY}, dl AS ({_DELTA}), pi AS (SELECT i AS ticker, max(delta) * sum(c * market_cap / (SELECT sum(market_cap) FROM market_caps)) + 0.04 AS pi FROM lw JOIN market_caps ON ticker = j CROSS JOIN dl GROUP BY i) SELECT ticker, {_r('pi')} FROM pi",
)


def _blended(s: SparkSession, d: str):
    bars = S.px_daily(s, d)
    cov = risk.ledoit_wolf(bars).persist()  # read for the matrix and for the prior
    try:
        return risk.black_litterman(cov, _prior(s, d, cov), forecast.forecast(bars, "LIGHTWEIGHT"))
    finally:
        cov.unpersist()


def _table(s: SparkSession, rows: list, columns: str) -> DataFrame:
    return s.createDataFrame(rows, columns)


def _posterior(s: SparkSession, d: str) -> DataFrame:
    names, mu, _ = _blended(s, d)
    return _table(s, [(t, float(x)) for t, x in zip(names, mu)], "ticker string, mu double")


def _weights(how: Callable) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        names, mu, sigma = _blended(s, d)
        return _table(s, frontier.prune(names, how(mu, sigma)), "ticker string, weight double")

    return query


add("bl_posterior", _posterior)
add("max_sharpe", _weights(lambda mu, sigma: frontier.max_sharpe(mu, sigma, min(RATE, float(mu.max()) - 0.01))))
add("efficient_return", _weights(lambda mu, sigma: frontier.efficient_return(mu, sigma, float(mu.mean()))))
add("efficient_risk", _weights(lambda mu, sigma: frontier.efficient_risk(mu, sigma, 1.05 * float((sigma.sum() ** 0.5) / len(mu)))))


def _ensemble_plan(s: SparkSession, d: str) -> DataFrame:
    """The whole plan with the ensemble's forecasts, over every ticker."""
    out = portfolio.optimise(portfolio.prepare(S.px_sparse(s, d), "1992-01-01", "1999-01-01", method="Ensemble"), rate=0.0)
    return _table(s, list(out["weights"].items()), "ticker string, weight double")


add("optimise_ensemble", _ensemble_plan)
add(
    "get_data",
    lambda s, d: portfolio.get_data(S.px_daily(s, d), "click_0", "2024-01-05", "2024-01-25")["prices"],
    f"WITH {X.PX_DAILY} SELECT ticker, dt, {_r('close')} FROM px_daily WHERE ticker = 'click_0' AND dt >= DATE '2024-01-05' AND dt < DATE '2024-01-25'",
)
add(
    "ema_slow",
    lambda s, d: S.px_monthly(s, d).select("ticker", "dt", W.ema(alpha=0.02).alias("ema")),
    f"""WITH {X.PX_MONTHLY}, n AS (SELECT *, row_number() OVER ({_W}) - 1 AS k FROM px_monthly WHERE close IS NOT NULL)
SELECT a.ticker, a.dt, round(sum(b.close * pow(0.98::DOUBLE, a.k - b.k) * CASE WHEN b.k = 0 THEN 1 ELSE 0.02::DOUBLE END), 6) + 0.0 AS ema FROM n a JOIN n b ON a.ticker = b.ticker AND b.k <= a.k GROUP BY 1, 2""",
)
add(
    "allocation",
    lambda s, d: portfolio.allocation(S.weights(s, d), panel.ends(S.px_daily(s, d)).select("ticker", F.col("last_close").alias("close")), BUDGET),
    f"WITH {X.PX_DAILY}, {X.WEIGHTS}, l AS (SELECT ticker, max_by(close, dt) AS close FROM px_daily GROUP BY ticker) SELECT w.ticker, {_r('amount=weight * 10000', 'shares=weight * 10000 / nullif(coalesce(close, 1), 0)')} FROM weights w LEFT JOIN l ON l.ticker = w.ticker",
)


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    folder = store.shared_folder(s, "saved")
    store.save(S.weights(s, d), panel.ends(S.px_daily(s, d)).select("ticker", F.col("last_close").alias("close")), folder, "growth", {"return": 0.1}, {"method": "LIGHTWEIGHT"})
    return store.load_weights(store.load(s, folder, "growth"))


add("save_load_roundtrip", _round_trip, f"WITH {X.WEIGHTS} SELECT ticker, {_r('weight')} FROM weights")
add("stream_daily_bars", streaming.run_once, f"WITH {X.PX_DAILY} SELECT ticker, dt, {_r('close', 'volume')} FROM px_daily")
