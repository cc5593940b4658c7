"""Packing of tokenised documents into sequences, by best fit with certified
bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to
partitions, each packed by best-fit decreasing. Dual feasible functions give a
lower bound of the bins that a set of lengths needs; a partition at its bound
is certified, and done. The others hand on all their sequences that have a gap;
these are dealt to new partitions of the same size, mixed, and packed again.
Rounds go on until the whole is at the bound of all lengths, every partition is
certified, one is left, or a round saves next to nothing. A repacking is taken
only if it needs fewer sequences.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bpe
from tracelake.llm.arrow import map_slices, strings
from tracelake.llm.shared import written
from tracelake.llm.token_counts import LETTER, NUMBER, SPACE, STABLE

# The split pattern of the word-level vocabulary.
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
CACHE = 300_000
#: Pieces dealt to a partition on average: large enough to fill its sequences.
PIECES = 60_000
#: A round that saves a smaller share of the sequences is the last.
GAIN = 1e-4


class Encoder:
    """Token ids of a text as little-endian 32-bit integers."""

    def __init__(self, tokenizer: str) -> None:
        self.path = bpe.resolve(tokenizer)
        self.merger = bpe.merger(self.path)
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = list(words - self.known.keys())
        if new:
            ids, counts = self.merger.merge([w.encode() for w in new])
            data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            self.known.update(zip(new, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts with special strings or characters of unstable class are
        encoded by the library."""
        own = [None if STABLE.search(t) or "<|" in t else WORD.findall(t.lower()) for t in texts]
        words = set().union(*(w for w in own if w is not None))
        self.learn(words)
        get = self.known.__getitem__
        whole = bpe.library(self.path)
        return [
            b"".join(map(get, w)) if w is not None else np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for w, t in zip(own, texts, strict=True)
        ]


_encoders: dict[str, Encoder] = {}


def _cut(tokenizer: str, capacity: int, with_ids: bool):
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    encoder = _encoders[tokenizer]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, data in enumerate(encoder.encode(strings(batch.column(1)))):
            data += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
        arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return step


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): each text's ids and
    a closing 0, cut only where there are more than ``capacity``."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_slices(df, "text", schema, partial(_cut, tokenizer, capacity, with_ids))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[s] items have size s. The largest
    bound of two families of dual feasible functions and of the plain sum."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)

    def upto(a: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(s >= 0, a[np.clip(s, 0, len(a) - 1)], 0)

    cut = np.arange(0, capacity // 2 + 1)  # items below the cut count nothing, those above its complement a whole bin
    half = np.full_like(cut, capacity // 2)
    large = number[-1] - upto(number, capacity - cut)
    middle = upto(number, capacity - cut) - upto(number, half)
    room = middle * capacity - (upto(weight, capacity - cut) - upto(weight, half))
    small = upto(weight, half) - upto(weight, cut - 1)
    best = max(best, int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))
    for k in range(1, 21):  # rounding functions: sizes in units of capacity / (k + 1)
        units = (k + 1) * sizes
        exact = units % capacity == 0
        value = np.where(exact, units * k, (units // capacity) * capacity * (k + 1))  # times capacity * k * (k + 1)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin has left: items by
    decreasing length, each into the fullest bin that has room."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, left = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(left), capacity
            left.append(capacity)
        where[i], offset[i] = b, capacity - room
        left[b] = room = room - n
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return where, offset, np.array(left, np.int64)


ROUND = "part long, bin long, offset long, settled boolean, certified boolean"


def _pack(frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Packs one group and marks what stays: everything if the group is at its
    bound, else full sequences. The input's own bins stay if packing anew
    doesn't save any."""
    frame = frame.sort_values(["id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = frame["length"].to_numpy(np.int64)
    where, offset, left = best_fit(lengths, capacity)
    if "bin" in frame and (before := frame.groupby(["from", "bin"], sort=True).ngroup().to_numpy()).max() + 1 <= len(left):
        where, offset = before, frame["offset"].to_numpy(np.int64)
        left = capacity - np.bincount(where, lengths, minlength=where.max() + 1).astype(np.int64)
    certified = len(left) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    settled = np.full(len(left), last or certified) | (left == 0)
    out = frame.drop(columns=[c for c in ("bin", "offset", "from", "settled", "certified") if c in frame])
    return out.assign(bin=where, offset=offset, settled=settled[where], certified=certified)


def _packer(capacity: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _pack(frame, capacity, last)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset,
    certified[, ids]), one per piece: sequence_id and offset say where it is.

    Each document's ids are closed by id 0. Null and empty texts are that id
    alone; repeated rows are packed each; no documents give no rows. Other
    columns aren't read. ``certified`` tells that the whole, or the group in
    which a sequence was settled, is at its lower bound. Groups are bounded in
    every round: all that is handed on is dealt to as many as it fills.
    """
    cut = written(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    kind = cut.schema["id"].dataType.simpleString()
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(histogram.values())
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] = n
    bound = lower_bound(counts, capacity)
    parts = max(1, -(-total // PIECES))
    rows = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("long"))
    ids = ["ids"] if with_ids else []
    base = f"id {kind}, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids
    settled: list[DataFrame] = []
    level = done = 0
    before: int | None = None
    while True:
        last = parts == 1
        packed = rows.groupBy("part").applyInPandas(_packer(capacity, last), base + ROUND)
        packed = written(packed.withColumn("level", F.lit(level)), f"packed{level}")
        heads = packed.where("offset = 0").agg(F.count("*").alias("n"), F.count(F.when(F.col("settled"), 1)).alias("settled")).first()
        used = done + heads["n"]
        little = before is not None and before - used <= GAIN * used
        if last or used <= bound or heads["settled"] == heads["n"] or little:
            settled.append(packed)
            break
        settled.append(packed.where("settled"))
        done, before, level = done + heads["settled"], used, level + 1
        left = packed.where("not settled")
        parts = max(1, -(-left.count() // PIECES))
        rows = left.select(
            *["id", "piece", "start", "length", "ids_crc32", *ids, F.col("part").alias("from"), "bin", "offset"],
            F.pmod(F.xxhash64("part", "bin", F.lit(level)), F.lit(parts)).cast("long").alias("part"),
        )
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    sequence = (F.col("level").cast("long") * (1 << 56) + F.col("part") * (1 << 28) + F.col("bin")).alias("sequence_id")
    certified = F.lit(True) if used <= bound else F.col("certified")
    out = out.select("id", "piece", "start", "length", "ids_crc32", sequence, "offset", certified.alias("certified"), *ids)
    return out.withColumnRenamed("id", id_col)
