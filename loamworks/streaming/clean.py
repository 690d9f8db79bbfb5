"""Fitted cleaning on streams, and event-time windows. An extension: fitted objects are projections, so they serve a stream as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def clean_stream(stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The stream through fitted transforms, such as NumericImputer(...).fit(history, columns).transform."""
    for step in steps:
        stream = step(stream)
    return stream


def windowed(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of a value by event-time window and keys; events later than `late` are left out once their window is closed."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, keys: Sequence[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of events of the same keys with no gap longer than `gap`."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicated(stream: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def write_clean(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly-once Parquet sink; with `once`, what is there now is worked off and the query ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
