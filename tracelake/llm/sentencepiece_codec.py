"""SentencePiece BPE with seeded merge-dropout, and its decoder.

Encoding is the agenda of SentencePiece's BPE: the best-scored adjacent pair
merges first, the leftmost of equals. A candidate is skipped for good if a
hash of its key is below the dropout rate. The key holds the seed, the
document, the place of the unit of text in it, and the candidate's place in the
unit: every occurrence of a word draws for itself, and the same input gives the
same pieces anywhere.

What an agenda does depends on the unit and on the candidates skipped so far
alone. So agendas are kept as paths: the merges from some point on, if nothing
more is skipped, and the pieces they end with. All occurrences of a batch draw
for all merges of their paths at once, on arrays; those that skip a merge go on
with the path that branches off there. Paths are worked out, many at a time, when
they are first met.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bpe
from tracelake.llm.arrow import map_slices, strings

#: No piece holds these behind or before other characters, and none holds a
#: space behind another character, so agendas of units are independent.
UNIT = re.compile(r"[\n\t]| *[^ \n\t]+| +")
#: A longer unit runs its agenda on a heap, alone.
LONG = 400
#: Merges of known paths after which a worker forgets them all; that bounds
#: memory and changes no result.
KNOWN = 5_000_000
#: Merges drawn for at a time (caches).
DRAWS = 1 << 17
#: Orders after every rank.
NEVER = 1 << 60
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_key(owner: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for a candidate; places in a unit that isn't long have 9 bits."""
    return (owner.astype(np.int64) << 27) | (start.astype(np.int64) << 18) | (middle.astype(np.int64) << 9) | end


class Codec:
    """A SentencePiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_id = np.zeros(256, np.int64)
        self.decoded = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
                self.decoded[i] = bytes([int(pieces[i][3:5], 16)])
        text = {i: pieces[i].replace("▁", " ") for i in plain}
        for i, t in text.items():
            self.decoded[i] = t.encode()
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.zeros(size + 70_000, np.int64)
        self.rank[order] = np.arange(len(order))
        self.symbol = {t: i for i, t in text.items()}
        self.size = size
        lone = sorted({c for t in text.values() for c in t} - self.symbol.keys())
        known = self.symbol | {c: size + k for k, c in enumerate(lone)}
        self.chars = {c: i for c, i in known.items() if len(c) == 1}
        left, right, made = [], [], []
        for t, i in self.symbol.items():
            for k in range(1, len(t)):
                if t[:k] in known and t[k:] in known:
                    left.append(known[t[:k]])
                    right.append(known[t[k:]])
                    made.append(i)
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (left, right, made))
        self.pairs = bpe.PairTable(self.left, self.right, self.made)
        self.unknown = size + len(lone)  # any other character: merges with none
        self.char_table = np.full(0x110000, self.unknown, np.int32)
        self.char_table[[ord(c) for c in self.chars]] = list(self.chars.values())

    @property
    @lru_cache(maxsize=1)  # noqa: B019 - one per worker
    def by_pair(self) -> dict[tuple[int, int], int]:
        return {(a, b): m for a, b, m in zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True)}

    def skipped(self, base, start, middle, end, limit):
        """Whether the candidate that joins [start, middle) and [middle, end)
        of a unit is skipped; base stands for seed, document and place."""
        key = base + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = mix(key ^ (middle.astype(np.uint64) << np.uint64(32)) ^ end.astype(np.uint64))
        return (key >> np.uint64(11)) < limit

    def heap_agenda(self, symbols: list[int], base: int, limit: int) -> list[tuple[int, int, int]]:
        """(symbol, start, end) of one unit, by a heap of candidates."""
        n = len(symbols)
        after, before, end, ids = [*range(1, n), -1], [-1, *range(n - 1)], [*range(1, n + 1)], list(symbols)
        pairs, rank, heap = self.by_pair, self.rank, []

        def offer(a: int, b: int) -> None:
            made = pairs.get((ids[a], ids[b]))
            if made is not None and not bool(self.skipped(np.array([base], np.uint64), *(np.array([x]) for x in (a, b, end[b])), np.uint64(limit))[0]):
                heapq.heappush(heap, (int(rank[made]), a, b, end[b], made))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, stop, made = heapq.heappop(heap)
            if ids[a] < 0 or ids[b] < 0 or after[a] != b or end[b] != stop or end[a] != b:
                continue
            ids[a], ids[b], end[a], after[a] = made, -1, stop, after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        out, i = [], 0
        while i >= 0 and n:
            out.append((ids[i], i, end[i]))
            i = after[i]
        return out

    def agendas(self, symbols: np.ndarray, owner: np.ndarray, skips: np.ndarray):
        """The agendas of many units side by side, a merge of each a round.
        ``skips`` holds the places (see ``place_key``) that are skipped. Gives
        the merges (owner, start, middle, end) and what is left (symbol, owner,
        start, end), each in order of the owner, merges in order of time."""
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
        start = np.arange(len(symbols)) - np.repeat(firsts, np.diff(np.r_[firsts, len(symbols)]))
        end, done, merges = start + 1, [], []
        none = np.int64(NEVER)
        while len(symbols):
            order = np.full(len(symbols), none)
            made = self.pairs.get(symbols[:-1], symbols[1:], np.int64(-1))
            at = np.flatnonzero((made >= 0) & (owner[:-1] == owner[1:]))
            if len(skips):
                key = place_key(owner[at], start[at], start[at + 1], end[at + 1])
                near = np.minimum(np.searchsorted(skips, key), len(skips) - 1)
                at = at[skips[near] != key]
            order[at] = (self.rank[made[at]] << np.int64(32)) | at
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(order, firsts)
            live = best < none
            active = np.repeat(live, np.diff(np.r_[firsts, len(symbols)]))
            if not active.all():
                done.append((symbols[~active], owner[~active], start[~active], end[~active]))
            place = best[live] & np.int64(0xFFFFFFFF)
            merges.append((owner[place], start[place], start[place + 1], end[place + 1]))
            symbols[place], end[place] = made[place], end[place + 1]
            active[place + 1] = False
            symbols, owner, start, end = symbols[active], owner[active], start[active], end[active]
        out = []
        for parts, by in ((merges, 0), (done, 1)):
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
            order = np.argsort(columns[by], kind="stable")
            out.append([c[order] for c in columns])
        return out

    def fall_back(self, found, unit: str) -> bytes:
        """Ids, a character that is no piece as those of its bytes."""
        ids: list[int] = []
        for symbol, a, b in found:
            if symbol < self.size:
                ids.append(symbol)
            else:
                ids.extend(self.byte_id[list(unit[a:b].encode("utf-8", "surrogatepass"))].tolist())
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids; inverse of encoding."""
        table = self.decoded
        data = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.removeprefix(b" ").decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.zeros(1024, kind), 0

    def extend(self, values) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(end, 2 * len(self.held)) - len(self.held), self.held.dtype)])
        self.held[self.size : end] = values
        self.size = end


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each, ``count`` numbers, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Paths:
    """Agendas met so far, as columns. Path p belongs to a unit and, unless it
    is the unit's first, skips the merge ``cause[p]`` of its ``parent[p]`` and
    shares what came before that. It has ``count[p]`` merges from ``first[p]``
    on, each with the path that skipping it leads to (-1: not met), and its
    pieces."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.root: dict[str, int] = {}
        self.text: list[str] = []
        self.symbols, self.symbol_first, self.symbol_count = Column(np.int32), Column(np.int64), Column(np.int32)
        self.unit, self.parent, self.cause, self.taken, self.count, self.pieces = (Column(np.int32) for _ in range(6))
        self.first, self.leaf = Column(np.int64), Column(np.int64)
        self.start, self.middle, self.end = (Column(np.int16) for _ in range(3))
        self.branch, self.ids = Column(np.int32), Column(np.int32)

    def _add(self, unit: np.ndarray, parent: np.ndarray, cause: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """New paths of units, after so many merges ``taken`` before."""
        n, made = len(unit), self.unit.size
        sizes = self.symbol_count.held[unit].astype(np.int64)
        symbols = self.symbols.held[ranges(self.symbol_first.held[unit], sizes)].astype(np.int64)
        keys, own, up, why = [], np.arange(n), parent, cause
        while len(own := own[keep := why >= 0]):
            up, why = up[keep], why[keep]
            keys.append(place_key(own, *(c.held[why] for c in (self.start, self.middle, self.end))))
            up, why = self.parent.held[up], self.cause.held[up]
        skips = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        merges, left = self.codec.agendas(symbols, np.repeat(np.arange(n), sizes), skips)
        counts = np.bincount(merges[0], minlength=n)
        rest = ranges(np.zeros(n, np.int64), counts) >= np.repeat(taken, counts)
        counts = counts - taken
        pieces = np.bincount(left[1], minlength=n)
        ids, ends = left[0], np.cumsum(pieces)
        odd = np.unique(left[1][ids >= self.codec.size])
        if len(odd):  # some character is no piece
            parts, at = [], 0
            for k in odd.tolist():
                cut = slice(int(ends[k] - pieces[k]), int(ends[k]))
                found = self.codec.fall_back(zip(*(left[c][cut].tolist() for c in (0, 2, 3)), strict=True), self.text[unit[k]])
                parts += [ids[at : cut.start], np.frombuffer(found, "<i4")]
                at = cut.stop
                pieces[k] = len(found) // 4
            ids = np.concatenate([*parts, ids[at:]])
        self.first.extend(self.start.size + np.cumsum(counts) - counts)
        self.leaf.extend(self.ids.size + np.cumsum(pieces) - pieces)
        for column, values in (
            *((c, m[rest]) for c, m in zip((self.start, self.middle, self.end), merges[1:], strict=True)),
            *((self.branch, np.full(int(counts.sum()), -1)), (self.ids, ids), (self.count, counts), (self.pieces, pieces)),
            *((self.unit, unit), (self.parent, parent), (self.cause, cause), (self.taken, taken)),
        ):
            column.extend(values)
        return np.arange(made, made + n)

    def learn(self, units: set[str]) -> None:
        new = list(units - self.root.keys())
        if not new:
            return
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        unit = len(self.text) + np.arange(len(new))
        self.symbol_first.extend(self.symbols.size + np.cumsum(sizes) - sizes)
        self.symbol_count.extend(sizes)
        self.symbols.extend(self.codec.char_table[points])
        self.text += new
        none = np.full(len(new), -1)
        self.root.update(zip(new, self._add(unit, none, none, np.zeros(len(new), np.int64)).tolist(), strict=True))

    def _branches(self, path: np.ndarray, merge: np.ndarray) -> None:
        """Makes the paths that skip merges, given by their places."""
        found = self._add(self.unit.held[path], path, merge, self.taken.held[path] + (merge - self.first.held[path]))
        self.branch.held[merge] = found

    def draw(self, path: np.ndarray, bases: np.ndarray, limit: int) -> np.ndarray:
        """The path on which each occurrence ends, from the one it begins on."""
        path = path.copy()
        active = np.arange(len(path)) if limit else np.zeros(0, np.int64)
        while len(active):
            active = active[self.count.held[path[active]] > 0]
            total = np.cumsum(self.count.held[path[active]], dtype=np.int64)
            cuts = np.searchsorted(total, np.arange(DRAWS, (int(total[-1]) if len(total) else 0) + DRAWS, DRAWS), "right")
            on = []
            for own in np.split(active, np.unique(cuts[:-1])):
                count = self.count.held[path[own]].astype(np.int64)
                merge = ranges(self.first.held[path[own]], count)
                places = (c.held[merge] for c in (self.start, self.middle, self.end))
                hit = np.flatnonzero(self.codec.skipped(np.repeat(bases[own], count), *places, np.uint64(limit)))
                which = np.repeat(np.arange(len(own)), count)[hit]
                new = np.r_[True, which[1:] != which[:-1]][: len(which)]  # the first merge that is skipped
                own, merge = own[which[new]], merge[hit[new]]
                on.append((own, merge))
            active, merge = (np.concatenate(x) for x in zip(*on, strict=True))
            unmet = np.flatnonzero(self.branch.held[merge] < 0)
            if len(unmet):
                new, at = np.unique(merge[unmet], return_index=True)
                self._branches(path[active[unmet[at]]], new)
            path[active] = self.branch.held[merge]
        return path


class Sampler:
    """Encodes texts, each under a key of its own."""

    def __init__(self, model: str, dropout: float, seed: int) -> None:
        self.codec = codec(bpe.resolve(model))
        self.limit = round(dropout * (1 << 53))
        self.seed = seed
        self.paths = Paths(self.codec)

    def bases(self, keys: list[str], sizes: np.ndarray) -> np.ndarray:
        """A number for each unit, from seed, key and place in the text."""
        seed = (self.seed * 0x9E3779B97F4A7C15) & MASK
        own = np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed) for k in keys), np.uint64, len(keys))
        place = ranges(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
        return mix(np.repeat(own, sizes) + place * np.uint64(0xD1B54A32D192ED03))

    def encode(self, keys: list[str], texts: list[str]) -> list[bytes]:
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        every = [u for own in units for u in own]
        if self.paths.start.size > KNOWN:
            self.paths = Paths(self.codec)
        paths, distinct = self.paths, set(every)
        long = {u for u in distinct if len(u) > LONG}
        paths.learn(distinct - long | {""})
        root = paths.root
        found = map(root.__getitem__, every) if not long else (root.get(u, root[""]) for u in every)
        begin = np.fromiter(found, np.int64, len(every))
        bases = self.bases(keys, sizes)
        end = paths.draw(begin, bases, self.limit)
        count = paths.pieces.held[end].astype(np.int64)
        ids = paths.ids.held[ranges(paths.leaf.held[end], count)].astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(count)]) * 4
        firsts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        out = []
        for a, b, own in zip(firsts, firsts[1:], units, strict=False):
            at, parts = int(ends[a]), []
            for i in [i for i, u in enumerate(own) if u in long] if long else []:
                found = self.codec.heap_agenda([self.codec.chars.get(c, self.codec.unknown) for c in own[i]], int(bases[a + i]), self.limit)
                parts += [ids[at : int(ends[a + i])], self.codec.fall_back(found, own[i])]
                at = int(ends[a + i])
            out.append(b"".join([*parts, ids[at : int(ends[b])]]))
        return out


_samplers: dict[tuple, Sampler] = {}


def _step(model: str, dropout: float, seed: int, with_ids: bool):
    key = (model, dropout, seed)
    if key not in _samplers:
        _samplers[key] = Sampler(*key)
    sampler = _samplers[key]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, names = strings(batch.column(1)), strings(batch.column(2))
        found = sampler.encode(names, texts)
        whole = [sampler.codec.decode(x) == t for x, t in zip(found, texts, strict=True)]
        arrays = [
            batch.column(0),
            pa.array([len(x) // 4 for x in found], pa.int64()),
            pa.array([zlib.crc32(x) for x in found], pa.int64()),
            pa.array(whole, pa.bool_()),
        ]
        fields = ["id", "n_pieces", "ids_crc32", "lossless"]
        if with_ids:
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4"))))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=fields)

    return step


def encode_documents(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    dropout: float = 0.1,
    seed: int = 1,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_pieces, ids_crc32, lossless[, ids]), one per row.

    The seed, the id and the place in the text decide what is skipped, so a
    word has as many segmentations as it occurs. With ``dropout=0`` the ids
    are SentencePiece's (a literal U+2581 is encoded by its bytes here, so that
    it is not lost). ``lossless`` is the check that decoding gives the text
    again. A null or empty text has no pieces; a null id counts as the empty
    string; repeated rows get equal results; other columns aren't read.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("key"))
    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    out = map_slices(df, "text", schema, partial(_step, model, dropout, seed, with_ids))
    return out.withColumnRenamed("id", id_col)


def _decode_step(model: str):
    decoder = codec(bpe.resolve(model))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat = np.asarray(lists.flatten()).astype("<u4")
        ends = np.cumsum([len(x) if x.is_valid else 0 for x in lists]).tolist()
        texts = [decoder.decode(flat[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return step


def decode_documents(
    encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Rows (id, text) of encoded documents; null or no ids give the empty
    text."""
    df = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = df.schema["id"].dataType.simpleString()
    return map_slices(df, "ids", f"id {kind}, text string", partial(_decode_step, model)).withColumnRenamed("id", id_col)
