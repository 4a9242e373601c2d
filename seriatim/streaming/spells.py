"""Streaming twins of the batch event operators: windowed extremes and spells of one state.

Late rows are accepted up to the watermark; a window or spell is handed on once the watermark
has passed its end. State is kept per key by Spark and checkpointed with the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_extremes(stream: DataFrame, key: str, time: str, value: str, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count, minimum and maximum of a value by key and tumbling (or sliding) window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "lo", "hi")


def spells(stream: DataFrame, key: str, time: str, state: str, gap: str = "14 hours", late: str = "2 hours") -> DataFrame:
    """Spells of rows of one key and state that are less than a gap apart: key, state, start, last, n.

    Unlike the batch operator another state in between does not end a spell.
    """
    w = F.session_window(time, gap)
    g = stream.withWatermark(time, late).groupBy(key, state, w.alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n"))
    return g.select(key, state, "start", "last", "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """The first delivery of each record within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
