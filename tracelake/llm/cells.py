"""Comparison of rows that share a cell, whatever the cells' sizes.

Cells are counted first, by their keys alone. A cell of more than ``cap`` rows
is cut into chunks by a hash of the member, and every pair of chunks becomes a
group of its own, so that each pair of rows meets in exactly one group and no
group exceeds twice the cap. Rows are shuffled once, to their groups, which are
then streamed, sorted, through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import written
from tracelake.session import share_code


def grouped(rows: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """The rows with ``_s``, their chunk, and ``_i``, ``_j``, the pair of
    chunks that a group compares; sorted by group within partitions."""
    share_code(rows.sparkSession)
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    held = rows.join(written(large, "cells"), keys, "left")
    held = held.withColumn("_k", F.coalesce(F.ceil(F.col("_n") / cap), F.lit(1)).cast("int"))
    held = held.withColumn("_s", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    held = held.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    held = held.withColumns({"_i": F.least("_s", "_o"), "_j": F.greatest("_s", "_o")}).drop("_n", "_k", "_o")
    group = [*keys, "_i", "_j"]
    return held.repartition(*group).sortWithinPartitions(*group)


def whole_groups(batches: Iterable[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with each row's group number; the
    last group of a batch waits for the next batch."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        columns = [table.column(c).to_numpy() for c in group]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield table.slice(0, last), np.cumsum(new[:last]) - 1
        waiting = table.slice(last)
    if waiting is not None and waiting.num_rows > 1:
        yield waiting, np.zeros(waiting.num_rows, np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The links that join what earlier ones haven't joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def compare(group: np.ndarray, crossing: np.ndarray, side: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """All linked pairs of positions within groups, offset by offset.
    ``linked`` tells which of given pairs are; ``crossing`` marks groups of
    two chunks, in which rows of one chunk aren't compared."""
    found = []
    for d in range(1, len(group)):
        a = np.flatnonzero(group[d:] == group[:-d])
        if not len(a):
            break
        a = a[~crossing[a] | (side[a] != side[a + d])]
        a = a[linked(a, a + d)]
        found.append((a, a + d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
