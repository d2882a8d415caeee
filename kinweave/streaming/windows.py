"""Counts of events by time, for a table or a stream; what the batch operators take as edges can be kept up to date so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of (ts, event_type, value). late: how long a stream waits for events."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def edge_counts(transfers: DataFrame, width: str, late: str) -> DataFrame:
    """window_start, src, dst, count of a stream of transfers (ts, source, target): partial call graphs, whose sums are the whole one."""
    rows = transfers.where("target IS NOT NULL").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("window_start"), "src", "dst", "count")
