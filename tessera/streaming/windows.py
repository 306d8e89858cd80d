"""Event-time windows, the same for a stream and a table; an extension over the counted windows of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return measured(e.groupBy(F.window("ts", size), *by), by)


def sliding(events: DataFrame, size: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return measured(e.groupBy(F.window("ts", size, step), *by), by)


def measured(groups, by: list[str]) -> DataFrame:
    found = groups.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str | None = None) -> DataFrame:
    """Runs of one key's events with no pause of `gap`; also what tells that a node has missed its heartbeats."""
    e = events.withWatermark("ts", late) if late else events
    found = e.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def newest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The newest state of each key: what a state stream shows in update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_s")).select(key, "_s.*")
