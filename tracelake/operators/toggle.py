"""Transition counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import sized
from tracelake.model import Window
from tracelake.operators.select import changes_of, resolve
from tracelake.operators.timeline import count_switches


def toggles(signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window = Window()) -> DataFrame:
    """Rows (req_ord, signal, toggles), also for signals that never change.

    The sized display is compared with the one before it inside the window;
    the first value is no toggle, a re-emission isn't either. Changes are
    counted once per identifier code and joined to the names after that."""
    targets = resolve(signals, list(dict.fromkeys(names)))
    hits = changes_of(targets, changes, window).join(targets.codes, "id_code")
    value = sized(F.col("kind"), F.col("disp"), F.col("hex"), F.col("size"))
    counted = count_switches(hits.select("id_code", "size", "seq", value.alias("v")), ["id_code", "size"], "seq", "v")
    return (
        targets.rows.join(counted, ["id_code", "size"], "left")
        .select("req_ord", "signal", F.coalesce("switches", F.lit(0).cast("long")).alias("toggles"))
        .orderBy("req_ord")
    )
