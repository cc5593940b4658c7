"""Byte-pair merges on ragged numpy arrays.

All sequences advance together. In a round, each looks up the rank of every
adjacent pair, takes its lowest, and merges all places of that pair at once
(from the left where they overlap). A merge makes symbols that only later
merges use, so this equals merging one place at a time in order of rank.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import cached_property, lru_cache

import numpy as np

NONE = np.int64(1) << np.int64(40)
#: Symbols beyond which a word is merged on its own: rounds of all words would
#: wait for it, and each costs its whole length.
LONG = 1_000


def resolve(name: str) -> str:
    """A path as it is, a bare file name among the installed tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each
    byte: itself where printable, else the next unused one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in shown else extra)
        extra += b not in shown
    return out


class PairTable:
    """Vectorised lookup of values by pairs of small ids."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << self.bits, np.int64)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot[todo], -1), return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            at = todo[won]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], value[at]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray, default: np.int64) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], default)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class RankMerger:
    """The merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.inner = np.array([vocab.get(c, 0) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + suffix, 0) for c in alphabet], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        self.table, self.made = PairTable(left, right, np.arange(len(pairs), dtype=np.int64)), made
        self.left, self.right = left, right

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        return {(a, b): k for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}

    def long_word(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word, from a heap of its pairs: lowest
        rank first, the leftmost of equals."""
        n, made = len(symbols), self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = int(made[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive, word after word, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        full = sizes > 0
        symbols[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        if len(long := np.flatnonzero(sizes > LONG)):
            for k in long.tolist():
                done_symbols.append(np.array(self.long_word(symbols[ends[k] - sizes[k] : ends[k]].tolist()), np.int64))
                done_owner.append(np.full(len(done_symbols[-1]), k))
            short = np.repeat(sizes <= LONG, sizes)
            symbols, owner = symbols[short], owner[short]
        while len(symbols):
            ranks = np.full(len(symbols), NONE)
            if len(symbols) > 1:
                inside = owner[:-1] == owner[1:]
                ranks[:-1] = np.where(inside, self.table.get(symbols[:-1], symbols[1:], NONE), NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            active = lowest < NONE
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, ranks, lowest = symbols[active], owner[active], ranks[active], lowest[active]
                if not len(symbols):
                    break
            hit = ranks == lowest
            again = np.flatnonzero(hit[1:] & hit[:-1])
            if len(again):  # a run such as aaa: every other place from its left
                at = np.flatnonzero(hit)
                first = np.r_[True, np.diff(at) > 1]
                begin = np.repeat(at[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
                hit[at[(at - begin) % 2 == 1]] = False
            place = np.flatnonzero(hit)
            symbols[place] = self.made[ranks[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return symbols, np.zeros(len(words), np.int64)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


@lru_cache(maxsize=4)
def library(path: str):
    """The library's own tokenizer, single-threaded as tasks are."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
