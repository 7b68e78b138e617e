"""Hedge analysis: correlation of daily returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.pvalue import pearson_p
from tessera.functions.scalars import correlation, strength
from tessera.operators import pairs

HEDGE_BELOW = -0.5


def returns(bars: DataFrame) -> DataFrame:
    """Simple returns on each ticker's own calendar, before any alignment."""
    return bars.withColumn("r", W.simple_return()).where("r is not null").select("ticker", "dt", "r")


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", W.log_return()).where("r is not null").select("ticker", "dt", "r")


def pair(bars: DataFrame, one: str, two: str) -> DataFrame:
    """One row: r, n, is_hedge, strength; n = 0 and no strength where the dates don't meet."""
    r = returns(bars.where(F.col("ticker").isin(one, two)))
    a, b = (r.where(F.col("ticker") == t).select("dt", F.col("r").alias(c)) for t, c in ((one, "x"), (two, "y")))
    out = a.join(b, "dt").agg(correlation("x", "y").alias("r"), F.count("*").alias("n"))
    return out.select(F.lit(one).alias("ticker1"), F.lit(two).alias("ticker2"), "r", "n", F.coalesce((F.col("r") < HEDGE_BELOW).cast("int"), F.lit(0)).alias("is_hedge"), strength(F.col("r")).alias("strength"))


def matrix(bars: DataFrame) -> DataFrame:
    """(i, j, r, n) of every pair i < j that shares a date, from matrix products by blocks of tickers."""
    m = pairs.moments(pairs.pair_sums(returns(bars).withColumnRenamed("r", "x"))).where("i < j")
    r = F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))
    return m.select("i", "j", r.alias("r"), "n")


def pvalues(bars: DataFrame) -> DataFrame:
    return matrix(bars).withColumn("p", pearson_p(F.col("r"), F.col("n").cast("double"))).select("i", "j", "p")


def report(bars: DataFrame, one: str, two: str) -> DataFrame:
    """``pair`` with the p-value; raises if a side has no bars."""
    sides = {r["ticker"] for r in bars.where(F.col("ticker").isin(one, two)).select("ticker").distinct().collect()}
    if missing := {one, two} - sides:
        raise ValueError(f"no bars for {', '.join(sorted(missing))}")
    return pair(bars, one, two).withColumn("p", pearson_p(F.col("r"), F.col("n").cast("double")))
