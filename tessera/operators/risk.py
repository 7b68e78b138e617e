"""Covariance, shrinkage and Black-Litterman inputs. Everything up to the N x N matrices is
relational; the posterior's linear solve takes the matrices to the driver, where they fit
because the allocation itself is over N tickers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators import pairs, panel

YEAR = 252
TAU = 0.05
DELTA = 2.5
LEAST_UNCERTAINTY, DEFAULT_UNCERTAINTY = 1e-4, 0.05


def covariance(bars: DataFrame) -> DataFrame:
    """(i, j, c), i <= j: population covariance of simple returns on the dates both have."""
    r = bars.withColumn("x", W.simple_return()).where("x is not null")
    return pairs.moments(pairs.pair_sums(r)).select("i", "j", "c")


def centred_returns(bars: DataFrame) -> DataFrame:
    """(ticker, dt, x): returns of the filled panel, missing ones 0, less their mean; over the tickers
    and the dates that have a return. The panel is made once and judged by windows."""
    r = panel.densify(bars).withColumn("close", W.forward_fill()).withColumn("r", W.simple_return()).select("ticker", "dt", "r")
    of_date, of_ticker = Window.partitionBy("dt"), Window.partitionBy("ticker")
    full = r.withColumn("_d", F.count("r").over(of_date)).where("_d > 0").withColumn("_t", F.count("r").over(of_ticker)).where("_t > 0").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return full.select("ticker", "dt", (F.col("r") - F.avg("r").over(of_ticker)).alias("x"))


def ledoit_wolf(bars: DataFrame) -> DataFrame:
    """(i, j, c, shrinkage) for all i, j: the annualised covariance, shrunk to constant variance.
    Only i <= j is summed, in matrix products by blocks, and mirrored at the end."""
    half = pairs.pair_sums(centred_returns(bars)).select("i", "j", "n", F.col("sxy").alias("s"), F.col("sqq").alias("q"))
    e = F.col("s") / F.col("n")
    same = F.col("i") == F.col("j")
    twice = F.when(same, 1.0).otherwise(2.0)
    sums = half.agg(F.sum(twice * e * e).alias("ee"), F.sum(F.when(same, e)).alias("tr"), F.sum(twice * F.col("q")).alias("qq"), F.max("n").alias("n_"), F.count_if(same).cast("double").alias("p"))
    m = F.col("tr") / F.col("p")
    beta = (F.col("qq") / F.col("n_") - F.col("ee")) / (F.col("p") * F.col("n_"))
    delta = (F.col("ee") - 2 * m * F.col("tr") + F.col("p") * m * m) / F.col("p")
    shrink = sums.select(m.alias("m"), F.coalesce(F.least(beta, delta) / F.nullif(delta, F.lit(0.0)), F.lit(0.0)).alias("shrinkage"))
    c = YEAR * ((1 - F.col("shrinkage")) * e + F.col("shrinkage") * F.when(same, F.col("m")).otherwise(0.0))
    told = half.join(F.broadcast(shrink)).select("i", "j", c.alias("c"), "shrinkage")
    one, two = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return told.withColumn("p", F.explode(F.when(same, F.array(one)).otherwise(F.array(one, two)))).select("p.i", "p.j", "c", "shrinkage")


def risk_aversion(idx: DataFrame, rate: float) -> DataFrame:
    """(delta): (252 mean - rate) / (252 var) of the index's returns, 2.5 where that isn't defined."""
    r = idx.select(F.lit("index").alias("ticker"), "dt", "close").withColumn("r", W.simple_return())
    d = (YEAR * F.avg("r") - rate) / F.nullif(YEAR * F.var_samp("r"), F.lit(0.0))
    return r.agg(F.coalesce(d, F.lit(DELTA)).alias("delta"))


def implied_prior(cov: DataFrame, caps: DataFrame, delta: DataFrame, rate: float) -> DataFrame:
    """(ticker, pi) = delta * cov * w + rate, with w in proportion to the caps (ticker, cap)."""
    total = caps.agg(F.sum("cap").alias("total"))
    w = caps.join(F.broadcast(total)).select(F.col("ticker").alias("j"), (F.col("cap") / F.nullif("total", F.lit(0.0))).alias("w"))
    product = cov.join(F.broadcast(w), "j").groupBy("i").agg(F.sum(F.col("c") * F.col("w")).alias("s"))
    return product.join(F.broadcast(delta)).select(F.col("i").alias("ticker"), (F.col("delta") * F.col("s") + rate).alias("pi"))


def as_matrix(cov: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = cov.select("i", "j", "c").toPandas()
    names = sorted(set(rows["i"]))
    place = {t: k for k, t in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    out[rows["i"].map(place), rows["j"].map(place)] = rows["c"]
    return names, out


def posterior(sigma: np.ndarray, pi: np.ndarray, q: np.ndarray, uncertainty: np.ndarray, tau: float = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Black-Litterman mean and covariance with one absolute view q an asset."""
    omega = np.diag(np.maximum(uncertainty, LEAST_UNCERTAINTY) ** 2)
    gain = np.linalg.solve(tau * sigma + omega, tau * sigma).T
    return pi + gain @ (q - pi), sigma + tau * sigma - gain @ (tau * sigma)


def black_litterman(cov: DataFrame, prior: DataFrame, views: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, mean, covariance) from cov (i, j, c), prior (ticker, pi), views (ticker, mu, uncertainty).
    Raises if a ticker has no prior, as when its market cap is missing."""
    names, sigma = as_matrix(cov)
    joined = {r["ticker"]: r for r in prior.join(views, "ticker").collect()}
    if missing := [t for t in names if t not in joined]:
        raise ValueError(f"no market cap or view for {', '.join(missing[:5])}")
    pi, q = (np.array([joined[t][c] for t in names]) for c in ("pi", "mu"))
    u = np.array([DEFAULT_UNCERTAINTY if joined[t]["uncertainty"] is None else joined[t]["uncertainty"] for t in names])
    return names, *posterior(sigma, pi, q, u)
