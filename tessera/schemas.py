"""Schemas of the engine's tables. Missing numbers are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D = T.StringType(), T.DoubleType()

BARS = _of(ticker=_S, dt=T.DateType(), close=_D, volume=_D)
FUNDAMENTALS = _of(
    ticker=_S, company=_S, sector=_S, industry=_S, price=_D, market_cap=_D, pe=_D, forward_pe=_D, pb=_D, ps=_D, peg=_D, debt_equity=_D, roe=_D, roa=_D, profit_margin=_D
)
STATEMENTS = _of(ticker=_S, stmt=_S, freq=_S, period=T.DateType(), row_label=_S, value=_D)
COMPANY = _of(ticker=_S, long_name=_S, trailing_pe=_D, price_to_book=_D, price_to_sales=_D, current_ratio=_D, market_cap=_D, total_assets=_D)
TICKER_GROUPS = _of(group_name=_S, symbol=_S)
PORTFOLIO = T.StructType(
    [T.StructField(k, T.MapType(_S, _D)) for k in ("weights", "prices")] + [T.StructField(k, _D) for k in ("return", "risk", "sharpe_ratio")]
)
SAVED = T.StructType([T.StructField("portfolio_id", _S), T.StructField("result", PORTFOLIO), T.StructField("metadata", T.MapType(_S, _S)), T.StructField("saved_at", _S)])

#: Display name of each metric that can be screened, and its column.
METRICS = {
    "Price": "price", "Market Cap": "market_cap", "P/E": "pe", "Forward P/E": "forward_pe", "P/B": "pb", "Price/Sales": "ps",
    "PEG": "peg", "Debt/Equity": "debt_equity", "ROE": "roe", "ROA": "roa", "Profit Margin": "profit_margin",
}
#: Those whose values are fractions, for which 15 means 15 %.
FRACTIONS = {"ROE", "ROA", "Profit Margin"}
