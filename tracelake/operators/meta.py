"""Metadata and time bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.model import Recording


def time_bounds(changes: DataFrame) -> DataFrame:
    """First and last (by order, not by size) time, bare time marks included;
    a change before any mark is at 0, an empty body gives 0 and 0."""
    zero = F.lit(0).cast("long")
    return changes.agg(
        F.coalesce(F.min_by("time", "seq"), zero).alias("start_time"),
        F.coalesce(F.max_by("time", "seq"), zero).alias("end_time"),
    )


def metadata(rec: Recording) -> DataFrame:
    """One row: signal_count (aliases included), timescale, start and end."""
    scale = F.lit(f"{rec.timescale[0]} {rec.timescale[1]}" if rec.timescale else None).cast("string")
    counted = rec.signals.agg(F.count("*").alias("signal_count"))
    return counted.join(time_bounds(rec.changes), F.lit(True)).select(
        "signal_count", scale.alias("timescale"), "start_time", "end_time"
    )
