"""Toggle counts of an unbounded stream of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.session import share_code

OUT = "signal string, toggles long, last_value string"
STATE = "last_value string, toggles long"


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds a micro-batch of one signal into (last value, count). Only the
    batch's own rows are sorted; a batch is bounded by its trigger."""
    last, count = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    values = rows["value"].astype(object)
    before = values.shift(1)
    before.iloc[0] = last
    count += int((before.notna() & (before != "") & (before != values)).sum())
    last = values.iloc[-1]
    state.update((last, count))
    yield pd.DataFrame({"signal": [key[0]], "toggles": [count], "last_value": [last]})


def streaming_toggles(changes: DataFrame) -> DataFrame:
    """Rows (signal, toggles, last_value) for a streaming DataFrame (signal,
    seq, value) whose rows arrive in order of ``seq`` across batches; use
    output mode update."""
    share_code(changes.sparkSession)
    return changes.groupBy("signal").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
