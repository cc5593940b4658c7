"""Removal of byte strings that an earlier document has, by merged
Burrows-Wheeler transforms.

Candidate passages come from ``windows``. A shard cuts its passages into pieces
and transforms each. The transforms are merged by refining an interleave: it
starts as one transform after the other; a round sorts it, stably, by the
characters that precede each entry and follows them, after which entries are in
order by that many more characters. Within each piece nothing is sorted again.
Entries that rounds can't tell apart share a prefix; those that still are
together at the full width are the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracelake.llm.windows import FREQUENT, UNITS, Contexts, Part, Units, remove_repeats

#: Text that is transformed as a piece, and that is merged at a time.
PIECE, MERGED = 1 << 17, 1 << 20
#: Ends a passage; no UTF-8 text has this byte.
END = b"\xff"


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the rotations of a text, by doubling the compared length."""
    n = len(text)
    wide = np.concatenate([np.tile(text, 8 // n + 1), text])[: n + 8] if n < 8 else np.concatenate([text, text[:8]])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    have = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        if rank[order[-1]] == n - 1 or have >= n:
            return np.argsort(rank, kind="stable")
        key = (rank << 32) | np.roll(rank, -(have % n))
        have *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform, where each entry's predecessor is, and
    each entry's place in the text."""
    order = suffix_order(text)
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    return text[order - 1], place[order - 1], order


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of transforms by ``depth`` characters: entries (numbered
    through the parts) in order, and numbers that entries with equal prefixes
    of that length share."""
    sizes = [len(p[0]) for p in parts]
    shift = np.cumsum([0, *sizes[:-1]])
    last = np.concatenate([p[0] for p in parts]).astype(np.uint16)
    back = np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=True)]).astype(np.int32)
    pair, back2 = (last[back] << np.uint16(8)) | last, back[back]
    entries = np.arange(len(last), dtype=np.int32)
    shared = np.zeros(len(last), np.int32)
    done = 0
    while done < depth:
        key, step, n = (last, back, 1) if (depth - done) % 2 else (pair, back2, 2)
        chars = key[entries]
        order = np.argsort(chars, kind="stable")
        chars, before = chars[order], shared[order]
        entries = step[entries[order]]
        shared = np.zeros(len(last), np.int32)
        np.cumsum((chars[1:] != chars[:-1]) | (before[1:] != before[:-1]), out=shared[1:])
        done += n
    return entries, shared


def least_starts(texts: list[bytes], least: np.ndarray, width: int) -> np.ndarray:
    """For each window of each text, one text after another, the least of
    ``least`` among the texts that hold it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(PIECE, int(ends[-1]), PIECE), "right")).tolist(), len(texts)]
    parts, owner, offset = [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        parts.append(transform(np.frombuffer(END.join(texts[a:b]) + END, np.uint8)))
        sizes = lengths[a:b] + 1
        order = parts[-1][2]
        owner.append(np.repeat(np.arange(a, b, dtype=np.int32), sizes)[order])
        offset.append((np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order])
    entries, shared = merge(parts, width)
    own, at = np.concatenate(owner)[entries], np.concatenate(offset)[entries]
    whole = at <= lengths[own] - width
    own, at, shared = own[whole], at[whole], shared[whole]
    begin = np.flatnonzero(np.r_[True, shared[1:] != shared[:-1]])
    lowest = np.repeat(np.minimum.reduceat(least[own], begin), np.diff(np.r_[begin, len(own)]))
    counts = lengths - width + 1
    out = np.empty(int(counts.sum()), np.int64)
    out[(np.cumsum(counts) - counts)[own] + at] = lowest
    return out


def decide_for(width: int):
    def decide(found: Contexts) -> np.ndarray:
        out = np.repeat(found.least, found.windows)  # right where a group has one context
        begin = np.cumsum(found.windows) - found.windows
        batch: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal batch, size
            if batch:
                own = np.concatenate(batch)
                n = found.windows[own]
                place = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out[place] = least_starts([found.texts[c] for c in own.tolist()], found.least[own], width)
            batch, size = [], 0

        for members in found.compared():
            batch.append(members)
            size += int(found.windows[members].sum()) + len(members) * width
            if size > MERGED:
                flush()
        flush()
        return out

    return decide


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and each text's number; null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, np.diff(ends)


class Bytes(Units):
    """Bytes of UTF-8. Rows without an id have none: nothing is earlier than
    they are or they than anything."""

    def __init__(self, text_col: str, id_col: str, width: int, gram: int) -> None:
        self.text_col, self.id_col, self.width, self.gram = text_col, id_col, width, gram

    def texts(self, rows: pa.Table) -> pa.Array:
        return pc.if_else(pc.is_valid(rows.column(self.id_col)), rows.column(self.text_col), "")

    def count(self, rows: pa.Table) -> np.ndarray:
        return utf8(self.texts(rows))[1]

    def read(self, rows: pa.Table) -> Part:
        raw, sizes = utf8(self.texts(rows))

        def spans(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
            n = b - a
            place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            return raw[place].tobytes(), n

        return Part(UNITS[raw], sizes, pc.fill_null(rows.column(self.id_col).cast(pa.int64()), 0).to_numpy(), spans)


def remove_earlier(
    docs: DataFrame,
    width: int = 50,
    gram: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one per row
    of ``docs``: each byte goes that a string of ``width`` bytes covers which
    also starts in a document of smaller id.

    Texts are whole; strings don't cross documents; repeated rows have equal
    ids and so don't remove each other's bytes. Null texts are empty. A row
    with a null id keeps all its bytes and removes none elsewhere. ``kept`` is
    binary, as cuts may fall inside characters. Other columns aren't read.
    """
    units = Bytes("text", "id", width, gram)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def finish(rows: pa.Table, sizes: np.ndarray, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw, whole = utf8(rows.column("text"))
        out, kept = [], []
        at = begin = 0
        for n, m in zip(whole.tolist(), sizes.tolist(), strict=True):
            text = raw[begin : begin + n]
            gone = removed[at : at + m]
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] > gone[:-1])) if m else 0
            left = (text[~gone] if spans else text).tobytes()
            out.append((n, n - len(left), spans, hashlib.sha256(left).hexdigest()))
            if with_text:
                kept.append(left)
            at, begin = at + m, begin + n
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        arrays = [rows.column("id").combine_chunks(), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = remove_repeats(df, "text", units, decide_for(width), finish, schema, frequent)
    return out.withColumnRenamed("id", id_col)
