"""Sessions and rolling statistics of interval streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions_stream(stream: DataFrame, key: str, time: str, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """I12's gap rule on a stream: key, s_start, s_end, n. Sessions close when the watermark has passed their gap; rows
    later than `late` are dropped by the watermark, as the only thing a stream may drop."""
    rows = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "n")


def windowed_stats_stream(stream: DataFrame, key: str, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and population deviation per key and window."""
    rows = stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return rows.select(key, F.col("w.start").alias("w_start"), "n", "mean", "std")


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Everything available now, appended as Parquet, exactly once by way of the checkpoint."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
