"""Sums over all pairs of series that share a date, by blocks of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that series are dealt to. A task holds two blocks: with T series and D dates that is
#: 2 T D / BLOCKS numbers, so thousands of series want more blocks.
BLOCKS = 4
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sqq")


def _tables(rows: pd.DataFrame, names: np.ndarray, dates: dict) -> tuple[np.ndarray, np.ndarray]:
    """The values, and which are there, of series by date."""
    x, there = np.zeros((2, len(dates), len(names)))
    at = rows["dt"].map(dates).to_numpy(), np.searchsorted(names, rows["ticker"].to_numpy().astype(str))
    x[at], there[at] = rows["x"].to_numpy(), 1
    return x, there


def pair_sums(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, sqq), i <= j, of series (ticker, dt, x; one row a ticker and
    date, no nulls) over the dates both have: counts and sums of x, y, x^2, y^2, xy and x^2 y^2.

    Each row goes to the ``blocks`` pairs of blocks that its own is in, and a pair of blocks is
    matrix products in one task; rows never meet one by one, so nothing of the size dates x
    tickers^2 is made or shuffled."""
    own = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    to = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("ticker", "dt", "x", own.alias("b")).withColumn("_to", to).select("ticker", "dt", "x", "b", F.least("b", "_to").alias("lo"), F.greatest("b", "_to").alias("hi"))

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        dates = {d: k for k, d in enumerate(rows["dt"].unique())}
        sides = [rows[rows["b"] == b] for b in (lo, hi)]
        names = [np.unique(side["ticker"].to_numpy().astype(str)) for side in sides]
        (x, m), (y, k) = (_tables(side, name, dates) for side, name in zip(sides, names))
        out = {"n": m.T @ k, "sx": x.T @ k, "sy": m.T @ y, "sxx": (x * x).T @ k, "syy": m.T @ (y * y), "sxy": x.T @ y, "sqq": (x * x).T @ (y * y)}
        i, j = np.nonzero(out["n"])
        if lo == hi:
            i, j = i[i <= j], j[i <= j]
        got = pd.DataFrame({"i": names[0][i], "j": names[1][j], **{c: out[c][i, j] for c in SUMS}})
        turned = (got["i"] > got["j"]).to_numpy()
        for one, two in (("i", "j"), ("sx", "sy"), ("sxx", "syy")):
            got.loc[turned, [one, two]] = got.loc[turned, [two, one]].to_numpy()
        return got

    return dealt.groupBy("lo", "hi").applyInPandas(sums, "i string, j string, " + ", ".join(f"{c} double" for c in SUMS))


def moments(sums: DataFrame) -> DataFrame:
    """(i, j, n, c, vx, vy): population covariance and variances over the shared dates; what rounding
    leaves of a constant series' variance is 0."""

    def variance(s: str, q: str):
        mean_square = F.col(q) / F.col("n")
        v = mean_square - (F.col(s) / F.col("n")) ** 2
        return F.when(v <= 1e-13 * mean_square, 0.0).otherwise(v)

    c = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * (F.col("sy") / F.col("n"))
    return sums.select("i", "j", F.col("n").cast("long").alias("n"), c.alias("c"), variance("sx", "sxx").alias("vx"), variance("sy", "syy").alias("vy"))
