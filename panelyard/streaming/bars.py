"""An extension: bars from an event stream, with a watermark, for the same feature code."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling_bars(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(date, ticker, open, high, low, close, adj_close, volume): one bar per user and window; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    bars = rows.groupBy(F.window("ts", width).alias("w"), F.col("user_id").cast("string").alias("ticker")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select(F.to_date("w.start").alias("date"), "ticker", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def write_once(bars: DataFrame, path: str, checkpoint: str):
    """Processes what there is and stops; closed windows only."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
