"""Streams: readings as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.operators.membership import turnover
from tidegraph.sources.tables import valid_price


def windowed_prices(readings: DataFrame, width: str = "7 days", late: str = "30 days") -> DataFrame:
    """``run_id, ticker, start, price, n``: the last valid price of each series and window.

    Readings sent again (same reading_id and fecha) count once within the watermark; what arrives later than ``late`` is left aside. Works on a stream and on a table alike.
    """
    valid = readings.where(valid_price(F.col("adjclose")) & F.col("fecha").isNotNull()).select("reading_id", "run_id", "ticker", F.col("fecha").cast("timestamp").alias("fecha"), "adjclose")
    once = valid.withWatermark("fecha", late).dropDuplicates(["reading_id", "fecha"])
    windows = once.groupBy("run_id", "ticker", F.window("fecha", width).alias("w")).agg(F.max(F.struct("fecha", "reading_id", "adjclose")).alias("last"), F.count("*").alias("n"))
    return windows.select("run_id", "ticker", F.col("w.start").alias("start"), F.col("last.adjclose").alias("price"), "n")


def turnover_on_arrival(members: DataFrame, path: str, name: str):
    """A ``foreachBatch`` function that appends the turnover of snapshot members to ``path``; each batch has its own folder, so a repeated batch writes the same again.

    The members of every batch are kept in ``{path}.members``. The turnover of the indices that a batch brings is worked out over all their members so far, as a batch may follow on a list of an
    earlier one, complete it or come late; what is new or has changed is written. ``arrived_turnover`` takes the last word on each period.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        columns = ["index_code", "n", "effective_date", name]
        batch.select(columns).write.mode("overwrite").parquet(f"{path}.members/batch={batch_id}")
        known = batch.sparkSession.read.parquet(f"{path}.members").where(F.col("batch") <= batch_id)
        codes = known.where(F.col("batch") == batch_id).select(F.col("index_code").alias("_code")).distinct()
        told = known.join(codes, F.col("index_code").eqNullSafe(F.col("_code")), "left_semi")
        rows = turnover(told.select(columns), name).subtract(turnover(told.where(F.col("batch") < batch_id).select(columns), name))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return members.writeStream.foreachBatch(write)


def arrived_turnover(spark: SparkSession, path: str) -> DataFrame:
    """The turnover as of the last batch: of each index and period the row written last."""
    rows = spark.read.parquet(path)
    last = F.row_number().over(Window.partitionBy("index_code", "period_end").orderBy(F.desc("batch")))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", "batch")
