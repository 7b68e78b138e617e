"""Saved results as JSON lines, one folder an id, and the caches of computed inputs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import SAVED

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessera-"))
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that what reads it several times computes it once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(weights: DataFrame, prices: DataFrame | None, folder: str, portfolio_id: str, figures: dict[str, float] | None = None, metadata: dict[str, str] | None = None, saved_at: str | None = None) -> None:
    """Save a portfolio (ticker, weight), with prices (ticker, close), as one JSON record."""
    figures = figures or {}

    def as_map(df: DataFrame, value: str):
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", value)))).alias("m"))

    row = as_map(weights, "weight").withColumnRenamed("m", "weights")
    row = row.join(as_map(prices, "close").withColumnRenamed("m", "prices")) if prices is not None else row.withColumn("prices", F.lit(None).cast("map<string,double>"))
    result = F.struct("weights", "prices", *[F.lit(figures.get(k)).cast("double").alias(k) for k in ("return", "risk", "sharpe_ratio")])
    told = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.lit(None)
    when = saved_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row.select(F.lit(portfolio_id).alias("portfolio_id"), result.alias("result"), told.cast("map<string,string>").alias("metadata"), F.lit(when).alias("saved_at")).write.mode("overwrite").json(f"{folder}/id={portfolio_id}")


def load(spark: SparkSession, folder: str, portfolio_id: str) -> DataFrame | None:
    """The saved record, or None if there is none."""
    found = all_saved(spark, folder)
    if found is None:
        return None
    mine = found.where(F.col("id") == portfolio_id).drop("id")
    return mine if mine.take(1) else None


def all_saved(spark: SparkSession, folder: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SAVED.add("id", "string")).json(folder)
    except AnalysisException:
        return None


def saved_ids(spark: SparkSession, folder: str) -> list[str]:
    found = all_saved(spark, folder)
    return [] if found is None else [r["id"] for r in found.select("id").distinct().orderBy("id").collect()]


def load_weights(saved: DataFrame) -> DataFrame:
    return saved.select(F.explode("result.weights").alias("ticker", "weight"))


def read_portfolio(spark: SparkSession, path: str, benchmark: bool = False) -> DataFrame:
    """An uploaded portfolio (one JSON object) as one row of maps, weights and prices; ValueError if
    weights, or for a benchmark prices, are absent or empty."""
    row = spark.read.schema("weights map<string,double>, prices map<string,double>").json(path, multiLine=True).limit(1)
    needed = ("weights", "prices") if benchmark else ("weights",)
    got = row.select(*[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in needed]).first()
    if missing := [c for c in needed if got is None or got[c] <= 0]:
        raise ValueError(f"the portfolio has no {' and no '.join(missing)}")
    return row


def bundle_key(start: str, end: str, group: str | None, tickers: list[str] | None, method: str) -> str:
    """Key of everything that doesn't depend on the constraints: another optimisation reuses it."""
    return hashlib.md5(json.dumps([start, end, group, sorted(tickers or []), method]).encode()).hexdigest()
