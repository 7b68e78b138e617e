"""Ratios and statement pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio_text

STATEMENTS = {"income", "balance", "cash"}


def scan(statements: DataFrame, stmt: str, freq: str = "annual") -> DataFrame:
    """One kind of statement; any frequency but quarterly means annual."""
    if stmt not in STATEMENTS:
        raise ValueError(f"unknown statement {stmt!r}: one of {', '.join(sorted(STATEMENTS))}")
    return statements.where((F.col("stmt") == stmt) & (F.col("freq") == ("quarterly" if freq == "quarterly" else "annual")))


def debt_ratio(statements: DataFrame) -> DataFrame:
    """(ticker, period, debt_ratio, debt_ratio_txt) of each ticker's latest balance sheet; NULL if
    either line is missing or assets are 0."""
    by_period = scan(statements, "balance").groupBy("ticker", "period").agg(
        *[F.max(F.when(F.col("row_label") == label, F.col("value"))).alias(c) for label, c in (("Total Liabilities", "debt"), ("Total Assets", "assets"))]
    )
    latest = by_period.groupBy("ticker").agg(F.max(F.struct("period", "debt", "assets")).alias("m"))
    ratio = F.col("m.debt") / F.nullif(F.col("m.assets"), F.lit(0.0))
    return latest.select("ticker", F.col("m.period").alias("period"), ratio.alias("debt_ratio"), ratio_text(ratio).alias("debt_ratio_txt"))


def key_ratios(company: DataFrame, statements: DataFrame) -> DataFrame:
    """Display text of the price and liquidity ratios and of the debt ratio."""
    names = ("trailing_pe", "price_to_book", "price_to_sales", "current_ratio")
    joined = company.join(debt_ratio(statements).select("ticker", "debt_ratio_txt"), "ticker", "left")
    return joined.select("ticker", *[ratio_text(F.col(c)).alias(c) for c in names], F.coalesce("debt_ratio_txt", F.lit("N/A")).alias("debt_ratio"))


def pivot(statements: DataFrame, ticker: str, stmt: str, periods: list[str], freq: str = "annual") -> DataFrame:
    """row_label and one column a period (a date), newest first as given."""
    rows = scan(statements, stmt, freq).where(F.col("ticker") == ticker).withColumn("period", F.col("period").cast("string"))
    wide = rows.groupBy("row_label").pivot("period", periods).agg(F.max("value"))
    return wide.toDF("row_label", *[f"p{p.replace('-', '_')}" for p in periods])


def market_caps(company: DataFrame) -> DataFrame:
    """Market cap, else total assets; tickers with neither drop out."""
    cap = F.coalesce(F.nullif("market_cap", F.lit(0.0)), F.nullif("total_assets", F.lit(0.0)))
    return company.select("ticker", cap.alias("cap")).where("cap is not null")
