"""Functions over files that return plain Python values.

They run on the active session (or ``spark=``). Results are what the caller
asked to have on the driver; use the operators for lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tracelake.model import Window
from tracelake.operators import compare as compare_ops
from tracelake.operators import extract as extract_ops
from tracelake.operators import find as find_ops
from tracelake.operators import meta as meta_ops
from tracelake.operators import select as select_ops
from tracelake.operators import toggle as toggle_ops
from tracelake.session import active
from tracelake.sources.vcd import read_header, read_vcd


def list_signals(path: str, filter: str | None = None) -> list[str]:
    """Names in order of declaration; reads the header only."""
    return [s[1] for s in read_header(path).signals if filter is None or filter in s[1]]


def metadata(path: str, spark: SparkSession | None = None) -> dict:
    rec = read_vcd(spark or active(), path)
    return meta_ops.metadata(rec).first().asDict()


def extract(
    path: str,
    signals: Sequence[str],
    start: int | None = None,
    end: int | None = None,
    layout: str = "long",
    fmt: str | None = None,
    spark: SparkSession | None = None,
) -> list[dict]:
    """``layout`` long gives rows (signal, time, value) in plain format;
    aligned (sized by default) and sparse give a row per time, keyed by time
    and the names."""
    if not signals:
        return []
    rec = read_vcd(spark or active(), path)
    window = Window(start, end)
    if layout == "long":
        df = extract_ops.extract_long(rec.signals, rec.changes, signals, window, fmt or "plain")
        return [{"signal": r["signal"], "time": r["time"], "value": r["value"]} for r in df.toLocalIterator()]
    if layout == "aligned":
        df = extract_ops.extract_aligned(rec.signals, rec.changes, signals, window, fmt or "sized")
    elif layout == "sparse":
        df = extract_ops.extract_sparse(rec.signals, rec.changes, signals, window, fmt or "plain")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return [dict(zip(["time", *signals], r, strict=True)) for r in df.toLocalIterator()]


def toggles(
    path: str, signals: Sequence[str], start: int | None = None, end: int | None = None, spark: SparkSession | None = None
) -> dict[str, int]:
    if not signals:
        return {}
    rec = read_vcd(spark or active(), path)
    df = toggle_ops.toggles(rec.signals, rec.changes, signals, Window(start, end))
    return {r["signal"]: r["toggles"] for r in df.toLocalIterator()}


def find(
    path: str,
    signal: str,
    value: str,
    occurrence: int = 1,
    start: int | None = None,
    end: int | None = None,
    fmt: str = "plain",
    spark: SparkSession | None = None,
) -> dict:
    rec = read_vcd(spark or active(), path)
    row = find_ops.find_nth(rec.signals, rec.changes, signal, value, occurrence, Window(start, end)).first()
    return {
        "found": row["found"],
        "signal": row["signal"],
        "time": row["time"],
        "value": row["sized" if fmt == "sized" else "value"],
    }


def compare(
    file1: str,
    file2: str,
    *,
    max_mismatches: int | None = None,
    signals: Sequence[str] | None = None,
    ignore_unknown: bool = False,
    start: int | None = None,
    end: int | None = None,
    spark: SparkSession | None = None,
) -> dict:
    spark = spark or active()
    result = compare_ops.compare(
        read_vcd(spark, file1), read_vcd(spark, file2), signals or (), ignore_unknown, max_mismatches, Window(start, end)
    )
    found = [
        {k: r[k] for k in ("signal", "time", "value1", "value2", "is_unknown")}
        for r in result.mismatches.orderBy("signal", "time").toLocalIterator()
    ]
    return {
        "passed": not found,
        "file1": file1,
        "file2": file2,
        "common_signals": [r["name"] for r in result.common.toLocalIterator()],
        "signals_only_in_file1": [r["name"] for r in result.only_first.toLocalIterator()],
        "signals_only_in_file2": [r["name"] for r in result.only_second.toLocalIterator()],
        "total_mismatches": len(found),
        "signals_with_mismatches": len({m["signal"] for m in found}),
        "mismatches": found,
    }
