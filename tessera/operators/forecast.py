"""Annual return forecasts in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.scalars import clip

YEAR = 252
DEFAULT = 0.05


def cagr(bars: DataFrame) -> DataFrame:
    """(P_end / P_start) ** (252 / n) - 1 with n prices; -0.99 if an end isn't positive, 0 below two."""
    seen = bars.where("close is not null").groupBy("ticker").agg(F.count("close").alias("n"), F.min_by("close", "dt").alias("first"), F.max_by("close", "dt").alias("last"))
    ok = (F.col("first") > 0) & (F.col("last") > 0)
    mu = F.when(F.col("n") < 2, 0.0).when(~ok, -0.99).otherwise(F.pow(F.col("last") / F.nullif(F.col("first"), F.lit(0.0)), F.lit(float(YEAR)) / F.col("n")) - 1)
    return seen.select("ticker", mu.alias("mu"), F.lit(0.0).alias("uncertainty"))


def _last(rows: DataFrame, k: int) -> DataFrame:
    """The last k rows of each ticker by date, with x = 0.. in date order and n, the rows there were."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    numbered = rows.withColumn("_back", F.row_number().over(newest)).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    return numbered.where(F.col("_back") <= k).withColumn("x", (F.least(F.col("n"), F.lit(k)) - F.col("_back")).cast("double"))


def _projected(rows: DataFrame, value: str, k: int, least: int) -> DataFrame:
    """OLS over the last k values, read off a year on, over the last value, minus 1."""
    fit = _last(rows, k).groupBy("ticker").agg(
        F.max("n").alias("n"), F.count("*").cast("double").alias("k"), F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("icpt"), F.max_by(value, "dt").alias("last")
    )
    f = (F.col("icpt") + F.col("slope") * (F.col("k") + YEAR)) / F.nullif(F.col("last"), F.lit(0.0)) - 1
    return fit.select("ticker", F.when((F.col("n") < least) | (F.col("last") <= 0), DEFAULT).otherwise(F.coalesce(f, F.lit(DEFAULT))).alias("f"))


def exp_smoothing(bars: DataFrame) -> DataFrame:
    seen = bars.where("close is not null")
    return _projected(seen.withColumn("s", W.ema()), "s", 30, 2)


def trend(bars: DataFrame) -> DataFrame:
    return _projected(bars.where("close is not null"), "close", 90, 10)


def vol_adjusted(bars: DataFrame) -> DataFrame:
    """252 times the mean simple return, times 0.8 where the population deviation exceeds 5 %."""
    r = bars.where("close is not null").withColumn("r", W.simple_return())
    stats = r.groupBy("ticker").agg(F.count("*").alias("n"), F.count("r").alias("k"), F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    f = F.col("m") * YEAR * F.when(F.col("sd") > 0.05, 0.8).otherwise(1.0)
    return stats.select("ticker", F.when((F.col("n") < 30) | (F.col("k") < 10), DEFAULT).otherwise(f).alias("f"))


def _weighed(e: Column, t: Column, v: Column) -> Column:
    return F.coalesce(clip(0.4 * e + 0.3 * t + 0.3 * v, -0.5, 1.0), F.lit(0.0))


def lightweight(bars: DataFrame) -> DataFrame:
    """0.4 smoothing + 0.3 trend + 0.3 volatility-adjusted mean, clipped to [-0.5, 1]."""
    parts = exp_smoothing(bars).withColumnRenamed("f", "e").join(trend(bars).withColumnRenamed("f", "t"), "ticker").join(vol_adjusted(bars).withColumnRenamed("f", "v"), "ticker")
    n = bars.where("close is not null").groupBy("ticker").agg(F.count("close").alias("n"))
    mu = F.when(F.col("n") < 10, DEFAULT).otherwise(_weighed(F.col("e"), F.col("t"), F.col("v")))
    return parts.join(n, "ticker").select("ticker", mu.alias("mu"), F.lit(0.05).alias("uncertainty"))


def sanitise(forecast: DataFrame) -> DataFrame:
    """Infinite forecasts become 0, the rest is clipped to [-1, 10]."""
    x = F.when(F.abs("mu") == float("inf"), 0.0).otherwise(F.col("mu"))
    return forecast.withColumn("mu", F.coalesce(clip(x, -1.0, 10.0), F.lit(0.0)))


def forecast(bars: DataFrame, method: str = "LIGHTWEIGHT") -> DataFrame:
    """(ticker, mu, uncertainty, method, return_kind) by any of the method names; an unknown name means lightweight."""
    if method in ("HISTORICAL", "MPT", "CLASSIC_MPT"):
        out, name, kind = cagr(bars), "historical", "arithmetic"
    elif method in ("DEEP_LEARNING", "Ensemble"):
        from tessera.operators import ml

        out, name, kind = ml.ensemble(bars), "ensemble", "log"
    else:
        out, name, kind = lightweight(bars), "lightweight", "arithmetic"
    return sanitise(out).select("ticker", "mu", "uncertainty", F.lit(name).alias("method"), F.lit(kind).alias("return_kind"))
