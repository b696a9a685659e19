"""Streaming forms of activity counts and sessions: on a bounded input they give what the batch forms give."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, unit: str = "1 day", late: str = "1 day") -> DataFrame:
    """events: a stream with ts and kind. Saves, deletes and probes for each window, once the watermark has passed it."""
    kinds = {"saves": "save", "deletes": "delete", "probes": "probe"}
    return events.withWatermark("ts", late).groupBy(F.window("ts", unit)).agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()]).select(F.unix_micros("window.start").alias("bucket_us"), *kinds)


def sessions(events: DataFrame, by: str, gap_s: float, late: str = "1 day") -> DataFrame:
    """Sessions of each key. The built-in window ends a session at a gap of its length or more; one microsecond more makes
    the break strict, as in the batch form."""
    gap = f"{int(gap_s * 1_000_000) + 1} microseconds"
    return events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))


def first_seen(events: DataFrame, by: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(by)
