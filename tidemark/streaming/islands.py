"""Gap islands on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Sessions of point events that lie less than ``gap`` apart: key, started, ended (last event plus the gap), n. Late events beyond the watermark are left out."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
