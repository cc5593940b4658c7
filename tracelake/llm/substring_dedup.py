"""Removal of passages that start more than once, by suffix automata.

Within a corpus, ``windows`` brings together the passages that may repeat; the
passages around one anchor are a reference shard. Its suffix automaton, with
the number of occurrences of each state, is matched by the same passages: the
matching statistics over states that occur at least twice give the maximal
repeated spans, and spans of the full width are removed. All passages of
repeated anchors are decided so, a single one with its copies too; only windows
of very frequent anchors are counted by their hashes. Shards of a corpus grow
with it, so they are sent to tasks by their anchor instead of to all.

Against a reference of bounded size, ``remove_reference`` broadcasts the
automata of its shards, and documents stream past them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tracelake.llm.arrow import map_slices
from tracelake.llm.windows import FREQUENT, Contexts, Part, Units, remove_repeats

#: Words that a broadcast reference may have, and words of one of its shards.
REFERENCE_WORDS, SHARD_WORDS = 1_000_000, 100_000


class Automaton:
    """The suffix automaton of several sequences, each with a weight."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _split(self, p: int, q: int, symbol) -> int:
        """A copy of state q for the strings that reach it through p."""
        following, link, c = self.next, self.link, len(self.next)
        following.append(following[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        link[q] = c
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = c
            p = link[p]
        return c

    def add(self, sequence: Iterable, weight: int = 1) -> None:
        following, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
            else:
                new = len(following)
                following.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0 and symbol not in following[p]:
                    following[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
                last = new
            count[last] += weight

    def settle(self) -> None:
        """Adds up occurrences: a state's strings end wherever longer ones do."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def statistics(self, sequence: Iterable, least: int = 1) -> list[int]:
        """At each place the length of the longest string that ends there and
        occurs ``least`` times or more in the sequences."""
        following, link, length, count = self.next, self.link, self.length, self.count
        state, matched, out = 0, 0, []
        for symbol in sequence:
            q = following[state].get(symbol)
            while state and (q is None or count[q] < least):
                state = link[state]
                matched = length[state]
                q = following[state].get(symbol)
            if q is not None and count[q] >= least:
                state, matched = q, matched + 1
            out.append(matched)
        return out


def repeated(texts: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """For each window of each passage whether it occurs twice or more."""
    words = [t.split(b" ") for t in texts]
    automaton = Automaton()
    for w, n in zip(words, counts, strict=True):
        automaton.add(w, n)
    automaton.settle()
    return [np.array(automaton.statistics(w, 2)[width - 1 :]) >= width for w in words]


def decide_for(width: int):
    def decide(found: Contexts) -> np.ndarray:
        out = np.repeat(found.count > 1, found.windows)  # what very frequent anchors' windows keep
        begin = np.cumsum(found.windows) - found.windows
        for members in found.compared(every=True):
            own = members.tolist()
            for c, x in zip(own, repeated([found.texts[c] for c in own], found.count[members].tolist(), width), strict=True):
                out[begin[c] : begin[c] + len(x)] = x
        return out

    return decide


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and the controls 9 to 13."""
    return (text or "").encode("utf-8").split()


class Words(Units):
    def __init__(self, text_col: str, width: int, gram: int) -> None:
        self.text_col, self.width, self.gram = text_col, width, gram

    def count(self, rows: pa.Table) -> np.ndarray:
        return np.array([len(words_of(t)) for t in rows.column(self.text_col).to_pylist()], np.int64)

    def read(self, rows: pa.Table) -> Part:
        lists = [words_of(t) for t in rows.column(self.text_col).to_pylist()]
        words = [w for own in lists for w in own]
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends + 1])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

        def spans(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
            first, stop = starts[a], ends[b - 1]
            return b"".join([data[x:y] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]), stop - first

        return Part(hashes, np.fromiter(map(len, lists), np.int64, len(lists)), np.zeros(len(lists), np.int64), spans)


RESULT = "n_words long, n_removed long, kept_sha256 string"


def kept_of(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)


def remove_repeated(
    docs: DataFrame,
    width: int = 35,
    gram: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256[, kept]), one per row of
    ``docs``: each word goes that a window of ``width`` words covers which also
    starts elsewhere, in any row, the same one included.

    All copies go, the first too; repeated rows are copies. Null texts have no
    words. Null ids are kept as they are. ``kept`` has the remaining words
    joined by a space. Other columns aren't read.
    """
    units = Words("text", width, gram)
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(rows: pa.Table, sizes: np.ndarray, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, kept, at = [], [], 0
        for text, n in zip(rows.column("text").to_pylist(), sizes.tolist(), strict=True):
            gone = removed[at : at + n]
            left = kept_of(words_of(text), gone)
            out.append((n, int(gone.sum()), hashlib.sha256(left).hexdigest()))
            if with_text:
                kept.append(left.decode("utf-8"))
            at += n
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        arrays = [rows.column("id").combine_chunks(), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept, pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    df = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, {RESULT}" + ", kept string" * with_text
    out = remove_repeats(df, "text", units, decide_for(width), finish, schema, frequent, every=True)
    return out.withColumnRenamed("id", id_col)


def without_repeated(docs: DataFrame, width: int = 35, gram: int = 16, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the same columns, texts without repeated
    passages. A text that loses nothing stays as it is, white space included;
    others have their kept words joined by a space. ``length_col``, if given
    and present, becomes the new text's number of characters."""
    units = Words(text_col, width, gram)

    def finish(rows: pa.Table, sizes: np.ndarray, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts, at = [], 0
        for text, n in zip(rows.column(text_col).to_pylist(), sizes.tolist(), strict=True):
            gone = removed[at : at + n]
            texts.append(kept_of(words_of(text), gone).decode("utf-8") if gone.any() else text)
            at += n
        out = rows.set_column(rows.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
        if length_col in rows.column_names:
            lengths = [None if t is None else len(t) for t in texts]
            k = rows.schema.get_field_index(length_col)
            changed = pa.array([a != b for a, b in zip(texts, rows.column(text_col).to_pylist(), strict=True)])
            fresh = pa.array(lengths, rows.schema.field(k).type)
            out = out.set_column(k, length_col, pa.compute.if_else(changed, fresh, rows.column(length_col)))
        yield from out.combine_chunks().to_batches()

    return remove_repeats(docs, text_col, units, decide_for(width), finish, docs.schema, FREQUENT, every=True)


def remove_reference(
    docs: DataFrame, reference: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text"
) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256): words covered by a span of
    ``width`` words or more that a reference text holds are removed.

    The reference must have REFERENCE_WORDS words at most; that is checked, and
    a larger one is an error: dedup it with the documents instead. Its shards'
    automata are broadcast. Null texts are empty on either side.
    """
    spark = docs.sparkSession
    from pyspark.sql import functions as F

    size = reference.agg(F.sum(F.size(F.split(F.coalesce(reference_col, F.lit("")), "[ \\t-\\r]+"))).alias("n")).first()["n"] or 0
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words, more than {REFERENCE_WORDS}")
    shards, held = [Automaton()], 0
    for row in reference.select(F.col(reference_col).alias("text")).collect():
        words = words_of(row["text"])
        if held and held + len(words) > SHARD_WORDS:
            shards.append(Automaton())
            held = 0
        shards[-1].add(words)
        held += len(words)
    sent = spark.sparkContext.broadcast(shards)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                change = np.zeros(len(words) + 1, np.int64)
                for automaton in sent.value:
                    matched = np.array(automaton.statistics(words), np.int64)
                    end = np.flatnonzero(matched >= width)
                    np.add.at(change, end + 1 - matched[end], 1)
                    np.add.at(change, end + 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept_of(words, gone)).hexdigest()))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_words", "n_removed", "kept_sha256"])

        return step

    return map_slices(df, "text", f"id {kind}, {RESULT}", make).withColumnRenamed("id", id_col)
