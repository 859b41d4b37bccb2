"""Verdict counts of judgments that arrive as a stream; the batch expressions, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_counts(judgments: DataFrame, time: str = "ts", key: str = "source_row_index", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, key, verdict, n) of a stream or a table; on a stream, state is dropped once ``late`` has passed."""
    rows = judgments.withWatermark(time, late) if judgments.isStreaming else judgments
    return rows.groupBy(F.window(time, window), key, "verdict").agg(F.count("*").alias("n"))
