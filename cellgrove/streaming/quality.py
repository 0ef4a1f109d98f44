"""Quality figures of a running delivery of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_stream(transcripts: DataFrame, window: str = "1 hour", late: str = "2 hours", floor: float = 20.0) -> DataFrame:
    """start, feature, n, passed: transcripts per event-time window and feature, and those at or above the quality floor.

    transcripts: a stream (or table) with ts, feature, qv. Rows later than `late` behind the newest are dropped by the
    watermark; a null ts is in no window, a null qv does not pass.
    """
    t = transcripts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy(F.window("ts", window), "feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("qv") >= floor, F.lit(False)).cast("bigint")).alias("passed"))
    return g.select(F.col("window.start").alias("start"), "feature", "n", "passed")
