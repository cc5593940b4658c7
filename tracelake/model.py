"""Relational model of a recording.

A recording is two tables. ``signals`` has a row per declared variable,
``changes`` a row per body token that carries time or a value. Values are kept
as canonical strings, so that every query stays inside Catalyst:

``seq``     total order of the tokens (byte offset in a file)
``time``    ticks
``id_code`` the signal's identifier code, null on time marks
``kind``    ``int``, ``real``, ``text``, or ``time`` for a bare time mark
``disp``    display form
``norm``    form used for equality across kinds (text is lower-cased)
``hex``     lower-case hexadecimal digits, integers only
``bits64``  raw IEEE bits, reals only
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = "0.2.0"

SIGNALS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("id_code", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("var_type", T.StringType()),
        T.StructField("scope", T.ArrayType(T.StringType())),
    ]
)
CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("id_code", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("disp", T.StringType()),
        T.StructField("norm", T.StringType()),
        T.StructField("hex", T.StringType()),
        T.StructField("bits64", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Window:
    """Inclusive range of ticks; either end may be open."""

    start: int | None = None
    end: int | None = None

    def __contains__(self, time: int) -> bool:
        return (self.start is None or time >= self.start) and (self.end is None or time <= self.end)


@dataclass(frozen=True)
class Recording:
    """Both tables of one recording, and its time scale (magnitude, unit)."""

    signals: DataFrame
    changes: DataFrame
    timescale: tuple[int, str] | None = None


@dataclass
class Comparison:
    """Lazy parts of a comparison; ``summary`` has one row."""

    common: DataFrame
    only_first: DataFrame
    only_second: DataFrame
    mismatches: DataFrame
    summary: DataFrame
    options: dict = field(default_factory=dict)
