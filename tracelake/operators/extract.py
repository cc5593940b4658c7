"""Values over time: long, aligned (carried forward) and sparse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import sized
from tracelake.model import Window
from tracelake.operators.select import events
from tracelake.operators.timeline import carry_forward


def formatted(fmt: str) -> Column:
    if fmt not in ("plain", "sized"):
        raise ValueError(f"unknown format {fmt!r}")
    return F.col("disp") if fmt == "plain" else sized(F.col("kind"), F.col("disp"), F.col("hex"), F.col("size"))


def extract_long(
    signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window = Window(), fmt: str = "plain"
) -> DataFrame:
    """Rows (seq, req_ord, signal, time, value) in file order, then in order
    of the request."""
    found = events(signals, changes, names, window)
    return found.select("seq", "req_ord", "signal", "time", formatted(fmt).alias("value")).orderBy("seq", "req_ord")


def grid(
    signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window, fmt: str
) -> tuple[DataFrame, list[str], list[str]]:
    """A row per time at which a requested signal changed, a column c0, c1, ..
    per distinct name with the last value at that time or null."""
    distinct = list(dict.fromkeys(names))
    found = events(signals, changes, distinct, window).select("time", "seq", "signal", formatted(fmt).alias("v"))
    cells = [F.max_by(F.when(F.col("signal") == n, F.col("v")), F.when(F.col("signal") == n, F.col("seq"))).alias(f"c{i}") for i, n in enumerate(distinct)]
    return found.groupBy("time").agg(*cells), distinct, [f"c{i}" for i in range(len(distinct))]


def named(df: DataFrame, names: Sequence[str], distinct: list[str]) -> DataFrame:
    place = {n: f"c{i}" for i, n in enumerate(distinct)}
    return df.select("time", *[F.coalesce(F.col(place[n]), F.lit("")).alias(n) for n in names]).orderBy("time")


def extract_sparse(
    signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window = Window(), fmt: str = "plain"
) -> DataFrame:
    """A row per time; a cell is empty unless its signal changed then."""
    df, distinct, _ = grid(signals, changes, names, window, fmt)
    return named(df, names, distinct)


def extract_aligned(
    signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window = Window(), fmt: str = "sized"
) -> DataFrame:
    """A row per time; a cell has its signal's latest value in the window,
    empty before the first. State from before the window isn't carried in."""
    df, distinct, cells = grid(signals, changes, names, window, fmt)
    return named(carry_forward(df, [], "time", cells), names, distinct)
