"""Ordered operators that don't put a whole signal into one task.

A clock can hold a large part of all changes, so a window over a signal alone
would run in one task. Both operators below work in two levels: a window over
(signal, bucket), then one over a row per bucket, which is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import stored

#: Width of a bucket, in units of ``seq`` (bytes of body text for files).
SEQ_BUCKET = 1 << 24
#: Rows that a bucket of times holds on average, whatever the time scale.
BUCKET_ROWS = 1 << 16


def bucket_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def carry_forward(df: DataFrame, keys: list[str], order: str, columns: list[str], include_current: bool = True, kept: bool = False) -> DataFrame:
    """Replaces nulls of ``columns`` by the last earlier non-null value in the
    order of ``order`` among rows of equal ``keys``. With
    ``include_current=False`` every row gets the value before it.

    ``order`` is unique within ``keys``. Nulls stay where nothing precedes.
    The rows are stored first, unless they are (``kept``): the source is read
    once, and the width of buckets follows from the number of rows and their
    span. Rows that fill no more than a bucket need no second level.
    """
    df = df if kept else stored(df, "timeline")
    found = df.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if found["n"] <= BUCKET_ROWS:
        own = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in columns})
    width = max(1, (found["high"] - found["low"] + 1) * BUCKET_ROWS // found["n"])
    df = df.withColumn("_bucket", bucket_of(order, width))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tails = df.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_tail_{c}") for c in columns]
    )
    carried = tails.select(
        *keys, "_bucket", *[F.last(f"_tail_{c}", ignorenulls=True).over(across).alias(f"_carry_{c}") for c in columns]
    )
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns}).drop(
        "_bucket", *[f"_carry_{c}" for c in columns]
    )


def count_switches(df: DataFrame, keys: list[str], order: str, value: str, width: int = SEQ_BUCKET) -> DataFrame:
    """Rows (keys.., switches): how often ``value`` differs from the one before
    it in the order of ``order``. A change from the empty string is not
    counted."""
    df = df.select(*keys, order, value).withColumn("_bucket", bucket_of(order, width))
    before = F.lag(value).over(W.partitionBy(*keys, "_bucket").orderBy(order))
    counts = (F.col("_before") != F.col(value)) & (F.col("_before") != "")
    buckets = (
        df.withColumn("_before", before)
        .groupBy(*keys, "_bucket")
        .agg(
            F.sum(F.when(counts, 1).otherwise(0)).alias("_inside"),
            F.min_by(value, order).alias("_first"),
            F.max_by(value, order).alias("_last"),
        )
        .withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")))
    )
    crossing = F.when((F.col("_before") != F.col("_first")) & (F.col("_before") != ""), 1).otherwise(0)
    return buckets.groupBy(*keys).agg(F.sum(F.col("_inside") + crossing).cast("long").alias("switches"))
