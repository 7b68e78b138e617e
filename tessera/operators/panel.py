"""Price panels in long form: densifying, filling and dropping bad tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.scalars import finite

CAP = 1e8
STALE_DAYS = 14


def densify(bars: DataFrame) -> DataFrame:
    """Every ticker on every date of the union calendar, close NULL where it has no bar."""
    grid = bars.select("ticker").distinct().crossJoin(F.broadcast(bars.select("dt").distinct()))
    return grid.join(bars.select("ticker", "dt", "close"), ["ticker", "dt"], "left")


def fetch(bars: DataFrame) -> DataFrame:
    """The forward-filled panel; dates before a ticker's first bar stay out."""
    return densify(bars).withColumn("close", W.forward_fill()).where("close is not null")


def scrub(bars: DataFrame, cap: float = CAP) -> DataFrame:
    """Infinities and zeros are filled from their neighbours; a ticker that still has gaps, or
    ever exceeds the cap, is dropped."""
    clean = bars.withColumn("close", F.nullif(finite(F.col("close")), F.lit(0.0)))
    filled = densify(clean).withColumn("close", W.forward_fill()).withColumn("close", W.backward_fill())
    whole = Window.partitionBy("ticker")  # the partitioning that the fills have already
    judged = filled.withColumn("_gaps", F.count_if(F.col("close").isNull()).over(whole)).withColumn("_top", F.max("close").over(whole))
    return judged.where((F.col("_gaps") == 0) & (F.col("_top") <= cap)).drop("_gaps", "_top")


def liveness(bars: DataFrame, end: str | None = None, days: int = STALE_DAYS, strict: bool = True) -> DataFrame:
    """(ticker, last_dt, alive): alive if the last bar is at most ``days`` before the end (by
    default the panel's last date). Not ``strict``: judged after filling, so only a whole
    panel can be stale."""
    last = bars.where("close is not null").groupBy("ticker").agg(F.max("dt").alias("last_dt"))
    final = bars.agg(F.max("dt").alias("_end"))
    joined = last.join(F.broadcast(final)) if end is None or not strict else last.withColumn("_end", F.to_date(F.lit(end)))
    limit = F.date_sub("_end" if end is None else F.to_date(F.lit(end)), days)
    return joined.select("ticker", "last_dt", ((F.col("last_dt") if strict else F.col("_end")) >= limit).alias("alive"))


def ends(bars: DataFrame) -> DataFrame:
    """First and last close of each ticker by date."""
    seen = bars.where("close is not null")
    return seen.groupBy("ticker").agg(F.min_by("close", "dt").alias("first_close"), F.max_by("close", "dt").alias("last_close"))


def regression_features(bars: DataFrame) -> DataFrame:
    """t, ma7, ma21, lag1, volume and the change to predict; the first 20 rows drop out."""
    return bars.select(
        "ticker", "dt", W.row_index().cast("long").alias("t"), W.rolling(F.col("close"), 7, F.avg).alias("ma7"), W.rolling(F.col("close"), 21, F.avg).alias("ma21"),
        W.previous("close").alias("lag1"), "volume", (F.col("close") - W.previous("close")).alias("change"), "close",
    ).dropna(subset=["ma7", "ma21", "lag1", "volume", "change"])


FEATURES = ["log_ret", "ret5", "ret20", "ma5", "ma20", "ma50", "vol10", "vol20", "rsi"]


def ml_features(bars: DataFrame, *keep: str) -> DataFrame:
    """Nine features of log returns, moving averages, volatility and RSI, and the next log return; plus the columns ``keep``."""
    close = F.nullif(F.col("close"), F.lit(0.0))
    base = bars.withColumn("log_ret", W.log_return()).withColumn("change", F.col("close") - W.previous("close"))
    return base.select(
        "ticker", "dt", *keep, "log_ret",
        *[W.rolling(F.col("log_ret"), n, F.sum).alias(f"ret{n}") for n in (5, 20)],
        *[(W.rolling(F.col("close"), n, F.avg) / close).alias(f"ma{n}") for n in (5, 20, 50)],
        *[W.rolling(F.col("log_ret"), n, F.stddev_samp).alias(f"vol{n}") for n in (10, 20)],
        W.rsi(F.col("change")).alias("rsi"), F.lead("log_ret").over(W.by_ticker()).alias("target"),
    )
