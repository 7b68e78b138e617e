"""Back-valuation of a portfolio against an index and a risk-free asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(bars: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """(ticker, shares) bought at each ticker's first close; tickers without bars are skipped."""
    first = bars.where("close is not null").groupBy("ticker").agg(F.min_by("close", "dt").alias("first"))
    bought = F.when(F.col("first") > 0, budget * F.col("weight") / F.nullif(F.col("first"), F.lit(0.0))).otherwise(0.0)
    return weights.join(first, "ticker").select("ticker", bought.alias("shares"))


def portfolio(bars: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """(dt, value) over the tickers with a bar that day; a missing bar is not filled."""
    held = bars.join(shares(bars, weights, budget), "ticker")
    return held.groupBy("dt").agg(F.sum(F.col("shares") * F.col("close")).alias("value")).where("value > 0")


def index(idx: DataFrame, budget: float) -> DataFrame:
    first = idx.where("close is not null").agg(F.min_by("close", "dt").alias("first"))
    return idx.join(F.broadcast(first)).select("dt", (budget * F.col("close") / F.nullif(F.col("first"), F.lit(0.0))).alias("value"))


def riskfree(bars: DataFrame, idx: DataFrame, budget: float, rate: float, start: str) -> DataFrame:
    """Daily compounding from the requested start over the union calendar."""
    days = F.datediff("dt", F.to_date(F.lit(start)))
    calendar = bars.select("dt").union(idx.select("dt")).distinct()
    return calendar.select("dt", (budget * F.pow(F.lit(1 + rate), days / F.lit(365.0))).alias("value"))


def timelines(bars: DataFrame, idx: DataFrame, weights: DataFrame, budget: float, rate: float, start: str) -> DataFrame:
    """(series, dt, value) of the three."""
    mine = bars.join(weights.select("ticker"), "ticker", "left_semi")
    parts = {"portfolio": portfolio(mine, weights, budget), "index": index(idx, budget), "risk_free": riskfree(mine, idx, budget, rate, start)}
    out = None
    for name, df in parts.items():
        named = df.select(F.lit(name).alias("series"), "dt", "value")
        out = named if out is None else out.unionByName(named)
    return out


def summary(lines: DataFrame, budget: float) -> DataFrame:
    """(series, initial, final, pl, pct)."""
    last = lines.groupBy("series").agg(F.max_by("value", "dt").alias("final"))
    gain = F.col("final") - budget
    return last.select("series", F.lit(float(budget)).alias("initial"), "final", gain.alias("pl"), (gain / budget * 100).alias("pct"))


def drawdown(lines: DataFrame) -> DataFrame:
    """(series, dt, value, change): each timeline with its change in percent since its first date."""
    w = Window.partitionBy("series").orderBy("dt")
    return lines.withColumn("change", 100 * (F.col("value") / F.nullif(F.first("value").over(w), F.lit(0.0)) - 1))
