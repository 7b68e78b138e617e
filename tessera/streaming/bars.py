"""Daily bars from a stream of events (an extension: there is no batch-only counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import shared_folder
from tessera.sources.tables import table


def daily_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(ticker, dt, close, volume) by event day; events later than ``late`` are dropped once their
    day is closed. The average is kept as sum and count, so state is two numbers a ticker and day."""
    ticker = F.concat("event_type", F.lit("_"), (F.col("user_id") % 4).cast("string"))
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    summed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(ticker.alias("ticker"), day.alias("w")).agg(F.avg("value").alias("close"), F.count("*").cast("double").alias("volume"))
    return summed.select("ticker", F.col("w.start").cast("date").alias("dt"), "close", "volume")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that are there, through the streaming plan: each micro-batch's changed bars are
    written under the batch's number (a repeated batch replaces itself), and a bar's latest stands."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = shared_folder(spark, "bars"), shared_folder(spark, "bars-state")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = daily_bars(stream).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    bars = spark.read.parquet(out)
    return bars.groupBy("ticker", "dt").agg(F.max_by("close", "batch").alias("close"), F.max_by("volume", "batch").alias("volume"))
