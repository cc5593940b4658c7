"""Repeated windows of a corpus, exactly, without shuffling every window.

A window is a run of ``width`` units (bytes or words) of one document. Of the
grams of ``gram`` units in a window the one with the least hash is its anchor
(the leftmost of equals); equal windows have equal anchors at equal places.
Neighbouring windows mostly share theirs, so that a corpus has far fewer
anchors than windows.

1. Every block sends shards its distinct anchors with their contexts (the text
   that the windows of one anchor in one place cover), both as hashes. The
   shards answer which anchors occur more than once, number their contexts, and
   choose for each context one block that is to send its text; that of the only
   context of an anchor is needed only by a method that wants every text.
2. Every block sends shards the places of the numbered contexts, and the texts
   asked for. An anchor with very many contexts isn't compared as a whole: each
   of its windows goes as a hash to a shard that this hash names.
3. Shards decide which windows of each context are to be removed (``decide``)
   and answer with runs of windows at the places; blocks apply them.

Two contexts, and two windows of a very frequent anchor, are taken as equal if
128 bits of hashes are: over 10^14 of them a false equality has a chance of
10^-10. Windows of unequal contexts are compared by their text.

A shard has the hashes of one range. There are as many as the corpus needs for
a shard to be small, and a message between a block and a shard holds one key at
least, so messages never outnumber keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tracelake.llm.blocks import answered, blocks, by_shard, each_block, shards_for, spread, squeeze, with_steps

BASE, OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Contexts beyond which an anchor's windows are sent one by one.
FREQUENT = 2_000
#: Least number of shards for each shuffle partition.
SHARDS = 2
#: Units that anchors are searched in at a time (caches).
SPAN = 1 << 17
UNITS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Part:
    """A block's documents as units: their hashes one after another, each row's
    number of units and id, and the texts of spans [a, b) of units, joined,
    with their sizes."""

    units: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    texts: Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray]]


class Units:
    """How documents become units; subclasses say for bytes and words."""

    width: int
    gram: int

    def read(self, rows: pa.Table) -> Part:
        raise NotImplementedError

    def count(self, rows: pa.Table) -> np.ndarray:
        """Each row's number of units, without the rest."""
        raise NotImplementedError


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, by doubling."""
    if len(units) < k:
        return np.zeros(0, np.uint64)
    power = {1: units}
    n = 1
    while 2 * n <= k:
        a = power[n]
        power[2 * n] = a[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + a[n:]
        n *= 2
    out, have = power[n], n
    while have < k:
        n = 1 << ((k - have).bit_length() - 1)
        m = len(units) - have - n + 1
        out = out[:m] * np.uint64(pow(BASE, n, 1 << 64)) + power[n][have : have + m]
        have += n
    return mixed(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (w - n)], v[w - n :]) if n < w else v


@dataclass
class Runs:
    """Runs of windows with one anchor: the document, the first window's place
    and the last's (in units of the block), a hash of the anchor (mixed anew:
    least hashes lie low, and shards are ranges), and one of the whole context."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    content: np.ndarray


def runs_of(units: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> Runs:
    """Runs of all documents of a block, given their units one after another."""
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    wide = 1 << (width.bit_length() - 1)  # grams that cover a context in a few steps
    steps = -(-(2 * width - gram) // wide)
    d = 0
    while d < len(sizes):
        e = max(d + 1, int(np.searchsorted(ends, starts[d] + SPAN, "right")))
        base, stop = int(starts[d]), int(ends[e - 1])
        if stop - base >= width:
            h = gram_hashes(units[base:stop], gram)
            place = np.arange(len(h), dtype=np.uint64)
            shift = np.uint64(max(1, int(len(h)).bit_length()))
            least = sliding_min((h >> shift << shift) | place, width - gram + 1)
            at = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            doc = np.repeat(np.arange(d, e), sizes[d:e])[: len(at)]
            window = np.flatnonzero(np.arange(len(at)) + base + width <= ends[doc])
            if len(window):
                at, doc = at[window], doc[window]
                new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
                begin = np.flatnonzero(new)
                close = np.r_[begin[1:], len(window)] - 1
                first, end = window[begin], window[close] + width
                g = gram_hashes(units[base:stop], wide)
                content = g[first] ^ (end - first).astype(np.uint64)
                for k in range(1, steps):
                    content = mixed(content * np.uint64(BASE) + g[np.minimum(first + k * wide, end - wide)])
                for out, x in zip(found, (doc[begin], first + base, window[close] + base, mixed(h[at[begin]]), content), strict=True):
                    out.append(x)
        d = e
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return Runs(*[np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, kinds, strict=True)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pairs(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of (anchor, context), where distinct pairs begin there,
    and each run's pair."""
    order = np.lexsort((runs.content, runs.key))
    key, content = runs.key[order], runs.content[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), pair


def _anchors(block: int, runs: Runs, shards: int) -> Iterator[pa.RecordBatch]:
    order, begin, _ = _pairs(runs)
    key, content = runs.key[order[begin]], runs.content[order[begin]]
    twice = (np.diff(np.r_[begin, len(order)]) > 1).astype(np.uint8)
    cuts = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)).tolist()
    which = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
    data = []
    for s in which:
        own = slice(cuts[s], cuts[s + 1])
        data.append(squeeze(with_steps(key[own]), content[own], twice[own]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int32()), pa.array([block] * len(which), pa.int64()), pa.array(data, pa.binary())], names=["shard", "block", "data"]
    )


#: Grades of a pair: unique, the only context of a repeated anchor, one of
#: several and to be sent, one of several, one of very many.
UNIQUE, ONLY, SENT, KNOWN, MANY = range(5)


def _grades(frame: pd.DataFrame, frequent: int, every: bool) -> pd.DataFrame:
    """A shard's answer to each block: the grades of the pairs it sent, then
    for those of repeated anchors the numbers of anchor and context."""
    parts = [spread(x) for x in frame["data"]]
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    content, twice = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_pair = new_key | np.r_[True, c[1:] != c[:-1]]
    begin = np.flatnonzero(new_key)
    sizes = np.diff(np.r_[begin, len(k)])
    repeated = (sizes > 1) | (np.maximum.reduceat(twice[order], begin) > 0)
    contexts = np.add.reduceat(new_pair, begin, dtype=np.int64)
    verdict = np.where(~repeated, UNIQUE, np.where(contexts == 1, ONLY, np.where(contexts > frequent, MANY, KNOWN)))
    ranked = np.repeat(verdict, sizes).astype(np.uint8)
    numbered = (ranked == ONLY) | (ranked == KNOWN)
    ranked[new_pair & ((ranked == KNOWN) | every & (ranked == ONLY))] = SENT
    grade, group, number = np.empty(len(k), np.uint8), np.empty(len(k), np.int32), np.empty(len(k), np.int32)
    grade[order] = ranked
    group[order] = np.cumsum(new_key & numbered) - 1
    number[order] = np.cumsum(new_pair & numbered) - 1
    out, at = [], 0
    for p in parts:
        own = slice(at, at + len(p[0]))
        at += len(p[0])
        held = np.flatnonzero((grade[own] != UNIQUE) & (grade[own] != MANY))
        out.append(squeeze(grade[own], with_steps(group[own][held]), with_steps(number[own][held])))
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "data": out})


def span_hashes(units: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span, as two words."""
    out = [np.zeros(len(first), np.uint64) for _ in range(2)]
    for k in range(width):
        unit = units[first + k]
        out = [out[0] * np.uint64(BASE) + unit, out[1] * np.uint64(OTHER) + mixed(unit)]
    return mixed(mixed(out[0])), mixed(out[1])


def _contexts(block: int, runs: Runs, part: Part, answers: list[tuple[int, bytes]], width: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows for the shards: numbered contexts, hashed windows, their places."""
    if not answers:
        return
    starts = np.cumsum(part.sizes) - part.sizes
    order, begin, pair = _pairs(runs)
    parts = [spread(x) for _, x in answers]
    grade = np.concatenate([p[0] for p in parts])
    held = np.flatnonzero((grade != UNIQUE) & (grade != MANY))
    group, number = np.zeros(len(grade), np.int32), np.zeros(len(grade), np.int32)
    group[held] = np.concatenate([np.cumsum(p[1], dtype=np.int32) for p in parts])
    number[held] = np.concatenate([np.cumsum(p[2], dtype=np.int32) for p in parts])
    reps = order[begin]  # a run of each pair
    shard = shard_of(runs.key[reps], shards)
    # places of numbered contexts, pair after pair
    run = order[np.isin(grade[pair[order]], (ONLY, SENT, KNOWN))]
    places = np.bincount(pair[run], minlength=len(grade))
    # windows of very frequent anchors
    single = np.flatnonzero(grade[pair] == MANY)
    n = runs.last[single] - runs.first[single] + 1
    window = np.repeat(runs.first[single] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    doc, (hashes, others) = np.repeat(runs.doc[single], n), span_hashes(part.units, window, width)
    by_hash = np.lexsort((others, hashes))
    window, doc, hashes, others = window[by_hash], doc[by_hash], hashes[by_hash], others[by_hash]
    fresh = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1])][: len(hashes)])
    many = np.diff(np.r_[fresh, len(hashes)])
    window_shard = shard_of(hashes[fresh], shards)

    sent = np.flatnonzero(grade == SENT)
    texts, sizes = part.texts(runs.first[reps[sent]], runs.last[reps[sent]] + width)
    text_cuts = np.concatenate([[0], np.cumsum(sizes)])
    packer = zstandard.ZstdCompressor(level=3)
    span = np.arange(shards + 1)
    pair_cuts, held_cuts, sent_cuts = (np.searchsorted(shard[x], span) for x in (slice(None), held, sent))
    run_cuts = np.concatenate([[0], np.cumsum(places)])[pair_cuts]
    hash_cuts = np.searchsorted(window_shard, span)
    window_cuts = np.concatenate([fresh, [len(hashes)]])[hash_cuts]
    which, rows = [], []
    for s in range(shards):
        own, hashed = held[held_cuts[s] : held_cuts[s + 1]], slice(hash_cuts[s], hash_cuts[s + 1])
        if not len(own) and hash_cuts[s] == hash_cuts[s + 1]:
            continue
        r, w = run[run_cuts[s] : run_cuts[s + 1]], slice(window_cuts[s], window_cuts[s + 1])
        t = slice(sent_cuts[s], sent_cuts[s + 1])
        rep = reps[own]
        docs = np.concatenate([runs.doc[r], doc[w]])
        at = np.concatenate([runs.first[r], window[w]]) - starts[docs]
        data = squeeze(
            with_steps(number[own]), with_steps(group[own]), (runs.last[rep] - runs.first[rep] + 1).astype(np.int32), places[own].astype(np.int32),
            number[sent[t]], sizes[t].astype(np.int32), with_steps(hashes[fresh[hashed]]), others[fresh[hashed]],
            many[hashed].astype(np.int32), docs.astype(np.int32), at.astype(np.int64), part.ids[docs],
        )
        which.append(s)
        rows.append((packer.compress(texts[text_cuts[t.start] : text_cuts[t.stop]]), data))
    if which:
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(np.full(len(which), block)), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]],
            names=["shard", "block", "texts", "data"],
        )


@dataclass
class Contexts:
    """What a shard decides on. Context c has a group (its anchor), the number
    of its windows and places, and the least document id among these. Texts are
    there where a group has several contexts. Windows of very frequent anchors
    are contexts too, in no group (-1)."""

    texts: list[bytes | None]
    group: np.ndarray
    windows: np.ndarray
    count: np.ndarray
    least: np.ndarray

    def compared(self, every: bool = False) -> Iterator[np.ndarray]:
        """Groups of contexts that differ but may share windows, or every
        group."""
        order = np.argsort(self.group, kind="stable")
        group = self.group[order]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[cuts, len(group)])
        most = np.maximum.reduceat(self.windows[order], cuts)
        for k in np.flatnonzero((every | (sizes > 1) & (most > 1)) & (group[cuts] >= 0)).tolist():
            yield order[cuts[k] : cuts[k] + sizes[k]]


#: Gives, for the windows of each class one after another, whether they go from
#: all places, or the least document id in which the window starts (it goes
#: from larger ones).
Decide = Callable[[Contexts], np.ndarray]


def _decide(frame: pd.DataFrame, decide: Decide) -> pd.DataFrame:
    """Decides a shard's contexts and answers each block with runs of windows
    to remove: document, first window, number of windows."""
    parts = [spread(x) for x in frame["data"]]
    numbers = [np.cumsum(p[0], dtype=np.int64) for p in parts]
    size = 1 + max((int(n[-1]) for n in numbers if len(n)), default=-1)
    group, windows = np.full(size, -1), np.ones(size, np.int64)
    texts: list[bytes | None] = [None] * size
    for p, n, packed in zip(parts, numbers, frame["texts"], strict=True):
        group[n] = np.cumsum(p[1], dtype=np.int64)
        windows[n] = p[2]
        ends = np.cumsum(p[5]).tolist()
        raw = zstandard.decompress(packed) if ends else b""
        for c, a, b in zip(p[4].tolist(), [0, *ends], ends, strict=False):
            texts[c] = raw[a:b]
    hashes = [np.cumsum(p[6], dtype=np.uint64) for p in parts]
    first, second = np.concatenate(hashes), np.concatenate([p[7] for p in parts])
    order = np.lexsort((second, first))
    new = np.r_[True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)][: len(order)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    singles = int(new.sum())
    cuts = np.cumsum([0, *map(len, hashes)])
    of = [
        np.concatenate([np.repeat(n, p[3]), np.repeat(size + which[a:b], p[8])])
        for p, n, a, b in zip(parts, numbers, cuts, cuts[1:], strict=False)
    ]
    total = size + singles
    every, ids = np.concatenate(of), np.concatenate([p[11] for p in parts])
    least = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(least, every, ids)
    extra = np.ones(singles, np.int64)
    widths = np.concatenate([windows, extra])
    verdicts = decide(Contexts(texts + [None] * singles, np.concatenate([group, -extra]), widths, np.bincount(every, minlength=total), least))
    begin = np.cumsum(widths) - widths
    out = []
    for own, p in zip(of, parts, strict=True):
        doc, at, ids = p[9:]
        n = widths[own]
        row = np.repeat(np.arange(len(own)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        verdict = verdicts[begin[own][row] + step]
        edge = np.flatnonzero(verdict if verdict.dtype == bool else verdict < ids[row])
        if not len(edge):
            out.append(None)
            continue
        new = np.r_[True, (np.diff(edge) > 1) | (row[edge[1:]] != row[edge[:-1]])]
        first = edge[new]
        length = np.diff(np.r_[np.flatnonzero(new), len(edge)])
        out.append(squeeze(doc[row[first]], at[row[first]] + step[first], length.astype(np.int32)))
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "data": out}).dropna()


def covered(answers: list[tuple[int, bytes]], sizes: np.ndarray, width: int) -> np.ndarray:
    """A mark for each unit of a block: whether a removed window covers it."""
    ends = np.cumsum(sizes)
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    for _, data in answers:
        doc, at, n = spread(data)
        first = (ends - sizes)[doc] + at
        np.add.at(change, first, 1)
        np.add.at(change, first + n + width - 1, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(
    docs: DataFrame,
    text_col: str,
    units: Units,
    decide: Decide,
    finish: Callable[[pa.Table, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]],
    schema: str,
    frequent: int = FREQUENT,
    every: bool = False,
) -> DataFrame:
    """The whole exchange. ``finish(rows, sizes, removed)`` makes a block's
    output rows from a mark for each of its units. With ``every`` the text of
    a context is sent even if it is the only one of its anchor."""
    held = blocks(docs, text_col)
    shards = shards_for(held, SHARDS)

    def runs(part: Part) -> Runs:
        return runs_of(part.units, part.sizes, units.width, units.gram)

    def anchors(block, rows, _):
        return _anchors(block, runs(units.read(rows)), shards)

    def contexts(block, rows, answers):
        part = units.read(rows)
        return _contexts(block, runs(part), part, answers, units.width, shards)

    def grades(frame: pd.DataFrame) -> pd.DataFrame:
        return _grades(frame, frequent, every)

    def decisions(frame: pd.DataFrame) -> pd.DataFrame:
        return _decide(frame, decide)

    def output(block, rows, answers):
        sizes = units.count(rows)
        return finish(rows, sizes, covered(answers, sizes, units.width))

    reply = "block long, shard int, data binary"
    sent = each_block(held, "shard int, block long, data binary", anchors)
    graded = by_shard(sent, shards, reply, grades)
    sent = each_block(answered(held, graded), "shard int, block long, texts binary, data binary", contexts)
    decided = by_shard(sent, shards, reply, decisions)
    return each_block(answered(held, decided), schema, output)
