"""The n-th change of a signal to a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.errors import InvalidOccurrence, MissingSignal, MissingSignals
from tracelake.functions import parse_target, sized
from tracelake.model import Window
from tracelake.operators.select import events
from tracelake.operators.timeline import SEQ_BUCKET, bucket_of


#: Up to this rank a top-k is cheap; beyond it buckets of the order are counted
#: first, and one bucket is ranked.
TOP = 10_000


def nth(rows: DataFrame, order: str, n: int, top: int = TOP, width: int = SEQ_BUCKET) -> DataFrame:
    """The n-th row in the order of ``order``, or none."""
    if n <= top:
        return rows.orderBy(order).offset(n - 1).limit(1)
    rows = rows.withColumn("_bucket", bucket_of(order, width))
    before = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    chosen = counts.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).select("_bucket", "_before")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(order))
    found = rows.join(F.broadcast(chosen), "_bucket").withColumn("_rank", rank)  # chosen has one row at most
    return found.where(F.col("_rank") + F.col("_before") == n).drop("_bucket", "_before", "_rank")


def find_nth(
    signals: DataFrame, changes: DataFrame, name: str, target: str, occurrence: int = 1, window: Window = Window()
) -> DataFrame:
    """One row (found, signal, time, value, sized); nulls if there is none.
    Re-emissions of the value count as occurrences."""
    if occurrence < 1:
        raise InvalidOccurrence()
    try:
        found = events(signals, changes, [name], window)
    except MissingSignals:
        raise MissingSignal(name) from None
    shown = sized(F.col("kind"), F.col("disp"), F.col("hex"), F.col("size")).alias("sized")
    hits = found.where(F.col("norm") == parse_target(target)).select("seq", "time", F.col("disp").alias("value"), shown)
    hit = nth(hits, "seq", occurrence).withColumn("hit", F.lit(True))
    asked = signals.sparkSession.range(1).select(F.lit(name).alias("signal"))
    return asked.join(hit, F.lit(True), "left").select(
        F.coalesce("hit", F.lit(False)).alias("found"), "signal", "time", "value", "sized"
    )
