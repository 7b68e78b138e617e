"""Bars, fundamentals and statements as projections of the base tables, and the file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_ticker() -> Column:
    return F.concat("event_type", F.lit("_"), (F.col("user_id") % 4).cast("string"))


def bars_from_events(events: DataFrame) -> DataFrame:
    return events.groupBy(_event_ticker().alias("ticker"), F.col("ts").cast("date").alias("dt")).agg(F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"))


def _brand_bars(spark: SparkSession, sf_dir: str, dt: Column) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.groupBy(F.col("p_brand").alias("ticker"), dt.alias("dt")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def px_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_bars(spark, sf_dir, F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("date"))


def px_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_bars(spark, sf_dir, F.col("l_shipdate").cast("date"))


def idx_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("dt")).agg(F.avg("value").alias("close"))


def _part_ticker() -> Column:
    return F.concat(F.lit("P"), F.col("p_partkey").cast("string"))


def sums_in_row_order(rows: DataFrame, key: str, **sums: str) -> DataFrame:
    """Sums of a parquet table's columns and the count of rows, by key. Values are added one by one as they stand in the
    files (by path, then row): the last bits of a sum of doubles depend on the order, which partial sums leave to the splits."""
    place = {"file": F.col("_metadata.file_path")} if len(rows.inputFiles()) > 1 else {}
    place["row"] = F.col("_metadata.row_index")
    order = Window.partitionBy(key).orderBy(*place)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(key, *sums.values(), *[c.alias(name) for name, c in place.items()]).select(
        key, *[F.sum(c).over(so_far).alias(name) for name, c in sums.items()], F.count("*").over(so_far).cast("double").alias("cnt"),
        F.lead("row").over(order).isNull().alias("is_last"),
    )
    return running.where("is_last").drop("is_last")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sums = sums_in_row_order(table(spark, sf_dir, "lineitem"), "l_partkey", rev="l_extendedprice", qty="l_quantity", tax="l_tax", disc="l_discount")

    def over(a, b):
        return a / F.nullif(b, F.lit(0.0))

    c = F.col
    size = c("p_size")
    return part.join(sums, c("p_partkey") == c("l_partkey"), "left").select(
        _part_ticker().alias("ticker"), c("p_name").alias("company"), c("p_brand").alias("sector"), c("p_type").alias("industry"),
        c("p_retailprice").alias("price"), c("rev").alias("market_cap"),
        over(c("p_retailprice"), (size % 7).cast("double")).alias("pe"), over(c("p_retailprice"), (size % 5).cast("double")).alias("forward_pe"),
        over(c("p_retailprice"), c("qty")).alias("pb"), over(c("rev"), c("qty") * c("p_retailprice")).alias("ps"),
        over(c("p_retailprice"), ((size % 7) * (size % 3)).cast("double")).alias("peg"), over(100 * c("tax"), c("disc")).alias("debt_equity"),
        over(c("disc"), c("cnt")).alias("roe"), over(c("tax"), c("cnt")).alias("roa"), over(c("disc") - c("tax"), c("disc") + c("tax")).alias("profit_margin"),
    )


def ticker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("group_name"), _part_ticker().alias("symbol")).distinct()


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    stmt = F.when(F.col("o_orderstatus") == "F", "income").when(F.col("o_orderstatus") == "O", "balance").otherwise("cash")
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "Total Assets").when(F.col("o_orderpriority") == "2-HIGH", "Total Liabilities").otherwise(F.col("o_orderpriority"))
    period = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    return joined.groupBy(F.col("n_name").alias("ticker"), stmt.alias("stmt"), F.lit("annual").alias("freq"), period.alias("period"), label.alias("row_label")).agg(F.sum("o_totalprice").alias("value"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "events").where(F.col("user_id") % 4 == 0)
    total = mine.agg(F.count("*").cast("double").alias("n"))
    counted = mine.groupBy(F.concat("event_type", F.lit("_0")).alias("ticker")).agg(F.count("*").cast("double").alias("k"))
    return counted.join(F.broadcast(total)).select("ticker", (F.col("k") / F.col("n")).alias("weight"))


def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(_event_ticker().alias("ticker")).agg(F.sum("value").alias("market_cap"))


# --- files -----------------------------------------------------------------------------------

#: Names under which a group of tickers may be asked for; any other name means the default.
ALIASES = {"DJIA": "Dow", "DOW": "Dow", "Dow": "Dow", "Dow Jones": "Dow", "S&P 500": "S&P"}
DEFAULT_GROUP = "S&P"
_TICKER = r"^[A-Za-z0-9.\-^]+$"


def group_name(asked: str | None) -> str:
    return ALIASES.get(asked or "S&P 500", DEFAULT_GROUP)


def sanitise(tickers: DataFrame, column: str = "symbol") -> DataFrame:
    """Trimmed tickers without trailing backslashes; anything that isn't a ticker is dropped."""
    t = F.regexp_replace(F.trim(F.col(column)), r"\\+$", "")
    return tickers.withColumn(column, t).where(F.col(column).rlike(_TICKER))


def read_group(spark: SparkSession, path: str) -> DataFrame:
    """A group file: CSV with the header Symbol."""
    return sanitise(spark.read.csv(path, header=True).select(F.col("Symbol").alias("symbol"))).dropDuplicates(["symbol"])


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded list: one ticker a line, or several with commas; markup lines are dropped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("{") & ~F.col("value").startswith("}"))
    return sanitise(lines.select(F.explode(F.split("value", r"[\r\n,]+")).alias("symbol"))).dropDuplicates(["symbol"])


def history(bars: DataFrame, tickers: list[str] | None, start: str, end: str) -> DataFrame:
    """Bars of the tickers with start <= dt < end; the predicates reach the scan."""
    inside = bars.where((F.col("dt") >= F.to_date(F.lit(start))) & (F.col("dt") < F.to_date(F.lit(end))))
    return inside if tickers is None else inside.where(F.col("ticker").isin(tickers))
