"""Value-change dumps (IEEE 1364, section 18) as a splittable Spark source.

``read_vcd`` gives a Recording. The header is read on the driver: it is bounded
by the design, not by the simulated time. ``seq`` is the byte offset, a total
order that needs no coordination between tasks.

The body is cut at nominal offsets, but what stands at an offset depends on
what comes before: it may lie in a comment, or in a value that awaits its
identifier. One parallel pass therefore outlines every nominal chunk: for each
state it may begin in, the state it ends in, its first time mark, its last and
its greatest time. Chained over the chunks, of which there are few, that gives
cuts at true time marks and the time before each, so that any cutting gives the
rows, and the errors, of the whole.

Times that go back are an error. A query with an end stops at the first time
mark past it, and errors behind that mark aren't seen.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tracelake.errors import DuplicateSignal, MissingEndDefinitions, ParseError
from tracelake.model import CHANGES, SIGNALS, Recording
from tracelake.session import share_code

#: Least and largest size of a chunk; between them a file is cut so that every
#: core gets a few.
SMALL_CHUNK, CHUNK = 4 << 20, 128 << 20
#: Text that is turned into arrays at a time.
SLICE = 2 << 20
ARROW = pa.schema(
    [
        ("seq", pa.int64()),
        ("time", pa.int64()),
        ("id_code", pa.string()),
        ("kind", pa.string()),
        ("disp", pa.string()),
        ("norm", pa.string()),
        ("hex", pa.string()),
        ("bits64", pa.int64()),
    ]
)
MAX_TIME = (1 << 63) - 1

_TOKEN = re.compile(rb"\S+")
_PLAIN_SCOPE = re.compile(r"[A-Za-z_][A-Za-z0-9_$().]*")


def open_file(path: str):
    """A seekable file, local or of any file system that Arrow knows."""
    path = path if "://" in path else path.removeprefix("file:")
    system, inner = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Header:
    signals: list[tuple]
    timescale: tuple[int, str] | None
    body: int
    size: int


def sanitize_scopes(text: str) -> str:
    """Escapes $scope identifiers that aren't plain. Such a line keeps its
    indent, kind and identifier; what follows on it is dropped."""
    out = []
    for line in re.findall(r"[^\n\r]*[\n\r]|[^\n\r]+", text):
        body = line.lstrip()
        parts = body.split()
        if body.startswith("$scope ") and len(parts) >= 4:
            name = parts[2] if parts[2].startswith("\\") or _PLAIN_SCOPE.fullmatch(parts[2]) else "\\" + parts[2]
            line = f"{line[: len(line) - len(body)]}$scope {parts[1]} {name} $end" + "\n" * line.endswith("\n")
        out.append(line)
    return "".join(out)


def parse_header(text: str) -> tuple[list[tuple], tuple[int, str] | None]:
    """Signals in order of declaration, scopes joined by dots, a bit range
    appended to its name. A leading backslash of an escaped scope is kept."""
    signals: list[tuple] = []
    scope: list[str] = []
    timescale = None
    words = iter(sanitize_scopes(text).split())
    for word in words:
        if word == "$enddefinitions":
            break
        if not word.startswith("$"):
            raise ParseError(f"unexpected {word!r} in header")
        args = []
        for arg in words:
            if arg == "$end":
                break
            args.append(arg)
        if word == "$scope":
            if len(args) < 2:
                raise ParseError("incomplete $scope")
            scope.append(args[1])
        elif word == "$upscope":
            if not scope:
                raise ParseError("$upscope without $scope")
            scope.pop()
        elif word == "$var":
            if len(args) < 4 or not args[1].isdigit():
                raise ParseError("incomplete $var")
            name = ".".join([*scope, args[3] + "".join(args[4:])])
            signals.append((len(signals), name, args[2], int(args[1]), args[0], list(scope)))
        elif word == "$timescale":
            m = re.fullmatch(r"(\d+)\s*(s|ms|us|ns|ps|fs)", "".join(args))
            if not m:
                raise ParseError("bad $timescale")
            timescale = int(m[1]), m[2]
    return signals, timescale


def read_header(path: str) -> Header:
    """Up to the first line that holds $enddefinitions; the body starts at the
    next line. A name declared twice is an error."""
    with open_file(path) as f:
        size, head = f.size(), b""
        while True:
            more = f.read(1 << 20)
            head += more
            at = head.find(b"$enddefinitions")
            end = head.find(b"\n", at) if at >= 0 else -1
            if end >= 0 or not more:
                break
        if at < 0:
            raise MissingEndDefinitions()
        body = end + 1 if end >= 0 else len(head)
    signals, timescale = parse_header(head[:body].decode("utf-8", "replace"))
    seen: set[str] = set()
    for s in signals:
        if s[1] in seen:
            raise DuplicateSignal(s[1])
        seen.add(s[1])
    return Header(signals, timescale, body, size)


def float_display(x: float) -> str:
    """Shortest digits that round-trip, never an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    text = np.format_float_positional(x, trim="-")
    return text


def decode_vector(bits: str) -> tuple[str, str, str, str | None]:
    """kind, disp, norm and hex of a vector's digits. Only 0 and 1 in up to
    128 digits make an integer; other vectors keep their digits as text."""
    bits = bits.lower()
    if len(bits) <= 128 and not bits.strip("01"):
        n = int(bits or "0", 2)
        return "int", str(n), str(n), format(n, "x")
    if bits.strip("01xz"):
        raise ParseError(f"bad vector {bits[:40]!r}")
    return "text", bits, bits, None


def tokens(data: bytes, base: int, time: int) -> Iterator[tuple]:
    """Rows of CHANGES from body text that starts at offset base and time.
    This is the definition; ``scan`` gives the same rows from arrays."""
    found = _TOKEN.finditer(data)
    skip = False
    for m in found:
        word, seq = m[0], base + m.start()
        first = word[:1]
        if skip:
            skip = word != b"$end"
        elif first == b"#":
            if not word[1:].isdigit():
                raise ParseError(f"bad time {word[:40]!r}")
            now = int(word[1:])
            if now > MAX_TIME:
                raise ParseError(f"time {now} does not fit 63 bits")
            if now < time:
                raise ParseError(f"time goes back from {time} to {now}")
            time = now
            yield seq, time, None, "time", None, None, None, None
        elif first in b"01xzXZ":
            value = first.decode().lower()
            if len(word) == 1:
                raise ParseError("scalar without identifier")
            yield seq, time, word[1:].decode("utf-8", "replace"), "text", value, value, None, None
        elif first in b"bBrRsS":
            code = next(found, None)
            if code is None:
                raise ParseError(f"{word[:40]!r} without identifier")
            ident, raw = code[0].decode("utf-8", "replace"), word[1:].decode("utf-8", "replace")
            if first in b"bB":
                yield seq, time, ident, *decode_vector(raw), None
            elif first in b"rR":
                try:
                    x = float(raw)
                except ValueError:
                    raise ParseError(f"bad real {raw!r}") from None
                text = float_display(x)
                yield seq, time, ident, "real", text, text, None, struct.unpack("<q", struct.pack("<d", x))[0]
            else:
                yield seq, time, ident, "text", raw, raw.lower(), None, None
        elif word == b"$comment":
            skip = True
        elif word not in (b"$dumpvars", b"$dumpall", b"$dumpon", b"$dumpoff", b"$end"):
            raise ParseError(f"unexpected {word[:40]!r}")


class Odd(Exception):
    """Text that is left to ``tokens``: unusual, or in error."""


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans of an ASCII buffer as strings."""
    ends = np.cumsum(size)
    place = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(buf[place]))


def hex_strings(value: np.ndarray) -> pa.Array:
    """Lower-case hexadecimal digits without leading zeros."""
    size = np.ones(len(value), np.int64)
    for k in range(1, 16):
        size += value >= np.uint64(1 << (4 * k))
    shift = np.arange(60, -4, -4).astype(np.uint64)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[((value[:, None] >> shift) & np.uint64(15)).astype(np.int64)]
    kept = digits[np.arange(16) >= 16 - size[:, None]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(value), pa.py_buffer(offsets), pa.py_buffer(kept))


def digits_of(buf: np.ndarray, start: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the spans in base 2 or 10, and whether all digits are such;
    spans have 64 or 18 digits at most."""
    value, good = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        digit = buf[start[own] + k] - np.uint8(48)  # wraps for what is below 0
        good[own] &= digit < base
        value[own] = value[own] * np.uint64(base) + digit
    return value, good


_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"#")], _CLASS[list(b"01xzXZ")], _CLASS[list(b"$")] = 1, 2, 3
_CLASS[list(b"bB")], _CLASS[list(b"rRsS")] = 4, 5
_KEYWORDS = pa.array(["$dumpvars", "$dumpall", "$dumpon", "$dumpoff", "$end"])


def scan(data: bytes, base: int, ids: set[str] | None, low: int | None, high: int | None, time: int = 0) -> tuple[list[pa.RecordBatch], int]:
    """The rows of ``tokens`` that the filters keep, by kind, not in order, and
    the last time. Raises Odd where the text needs ``tokens``."""
    buf = np.frombuffer(data, np.uint8)
    space = buf <= 32
    if b"$comment" in data or (buf > 126).any() or (space & (buf != 32) & ((buf < 9) | (buf > 13))).any():
        raise Odd
    edge = np.diff(np.concatenate([[0], (~space).view(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - start
    if not len(start):
        return [], time
    kind = _CLASS[buf[start]]
    # a b, r or s token is followed by an identifier, whatever that starts
    # with: in a run of tokens that look like values, every other one is
    looks = kind >= 4
    begins = looks & ~np.concatenate([[False], looks[:-1]])
    run = np.maximum.accumulate(np.where(begins, np.arange(len(start)), 0))
    value = looks & ((np.arange(len(start)) - run) % 2 == 0)
    ident = np.concatenate([[False], value[:-1]])
    if len(value) and value[-1]:
        raise Odd
    kind[ident] = 6
    word, scalar, mark = kind == 3, np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)
    if (kind == 0).any() or (size[scalar] == 1).any() or not pc.all(pc.is_in(gathered(buf, start[word], size[word]), _KEYWORDS)).as_py() and word.any():
        raise Odd
    if len(mark) and (size[mark].max() > 19 or size[mark].min() < 2):
        raise Odd
    ticks, good = digits_of(buf, start[mark] + 1, size[mark] - 1, 10)
    ticks = ticks.astype(np.int64)
    if not good.all() or (np.diff(ticks, prepend=time) < 0).any():
        raise Odd
    at = np.full(len(start), time)
    at[mark] = ticks
    at = np.maximum.accumulate(at)
    inside = np.ones(len(start), bool)
    if low is not None:
        inside &= at >= low
    if high is not None:
        inside &= at <= high
    wanted = None if ids is None else pa.array(sorted(ids), pa.string())
    out: list[pa.RecordBatch] = []

    def rows(place: np.ndarray, code, kinds: str, disp, norm, hexa=None, bits=None) -> None:
        n = len(place)
        nothing = pa.nulls(n, pa.string())
        columns = [pa.array(base + start[place]), pa.array(at[place]), nothing if code is None else code, pa.array([kinds] * n, pa.string())]
        columns += [nothing if x is None else x for x in (disp, norm, hexa)] + [pa.nulls(n, pa.int64()) if bits is None else bits]
        if n:
            out.append(pa.RecordBatch.from_arrays(columns, schema=ARROW))

    def kept(place: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Of tokens in the window those of wanted identifiers, and these."""
        own = inside[place]
        place, begin, length = place[own], begin[own], length[own]
        code = gathered(buf, begin, length)
        if wanted is None:
            return place, code
        hit = pc.is_in(code, wanted)
        return place[hit.to_numpy(zero_copy_only=False)], code.filter(hit)

    if ids is None:
        rows(mark[inside[mark]], None, "time", None, None)
    place, code = kept(scalar, start[scalar] + 1, size[scalar] - 1)
    digit = pc.ascii_lower(gathered(buf, start[place], np.ones(len(place), np.int64)))
    rows(place, code, "text", digit, digit)
    vector = np.flatnonzero(kind == 4)
    vector = vector[value[vector]]
    place, code = kept(vector, start[vector + 1], size[vector + 1])
    begin, length = start[place] + 1, size[place] - 1
    short = length <= 64
    number, whole = digits_of(buf, begin, np.where(short, length, 0), 2)
    plain = np.flatnonzero(short & whole)
    decimal = pa.array(number[plain]).cast(pa.string())
    rows(place[plain], code.take(pa.array(plain)), "int", decimal, decimal, hex_strings(number[plain]))
    other = np.flatnonzero(~(short & whole))
    found = [decode_vector(x) for x in gathered(buf, begin[other], length[other]).to_pylist()]
    for name in ("int", "text"):
        own = [i for i, f in enumerate(found) if f[0] == name]
        columns = [pa.array([found[i][k] for i in own], pa.string()) for k in (1, 2, 3)]
        rows(place[other[own]] if own else place[:0], code.take(pa.array(other[own] if own else [], pa.int64())), name, *columns)
    rest = np.flatnonzero(value & (kind == 5))
    place, code = kept(rest, start[rest + 1], size[rest + 1])
    found = []
    for p, c in zip(place.tolist(), code.to_pylist(), strict=True):
        text = data[start[p] : start[p] + size[p]] + b" " + c.encode()
        found += [(base + int(start[p]), int(at[p]), *r[2:]) for r in tokens(text, 0, 0)]
    if found:
        out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), ARROW, strict=True)], schema=ARROW))
    return out, int(at[-1])


#: What stands before a place of the body: nothing special, an open comment, or
#: a value that awaits its identifier.
OUT, COMMENT, IDENT = range(3)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True


@dataclass(frozen=True)
class Outline:
    """Of some text: the state behind it, the offset of its first time mark
    (-1: none), its last time and its greatest (-1: none)."""

    state: int
    first: int = -1
    last: int = -1
    most: int = -1


def outlines(data: bytes, states: Iterable[int] = (OUT, COMMENT, IDENT)) -> list[Outline]:
    """Outlines of whole tokens for each state they may begin in."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[0], (~_SPACE[buf]).view(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - start
    n = len(start)
    if not n:
        return [Outline(s) for s in states]
    kind = _CLASS[buf[start]]
    looks = kind >= 4
    run = np.maximum.accumulate(np.where(looks & ~np.concatenate([[False], looks[:-1]]), np.arange(n), 0))
    mark = np.flatnonzero(kind == 1)
    words = [(k, data[start[k] : start[k] + size[k]]) for k in np.flatnonzero((kind == 3) & ((size == 4) | (size == 8))).tolist()]
    opens, closes = ([k for k, w in words if w == name] for name in (b"$comment", b"$end"))

    def named(k: np.ndarray, since: int) -> np.ndarray:
        """Whether tokens k are identifiers, if ``since`` is none: then every
        other token of a run that looks like values is one."""
        before = k - 1
        return (before >= since) & looks[before] & ((before - np.maximum(run[before], since)) % 2 == 0)

    def times(k: np.ndarray) -> list[int]:
        texts = [data[start[i] + 1 : start[i] + size[i]] for i in k.tolist()]
        return [min(int(t), MAX_TIME) for t in texts if t.isdigit()]

    def spans(state: int) -> tuple[list[tuple[int, int]], int]:
        """Runs of tokens outside comments, and the state at the end."""
        since, found = 0, []
        while True:
            if state == COMMENT:
                at = next((k for k in closes if k >= since), None)
                if at is None:
                    return found, COMMENT
                since, state = at + 1, OUT
            if state == IDENT:
                if since >= n:
                    return found, IDENT
                since, state = since + 1, OUT
            at = next((k for k in opens if k >= since and not named(np.array([k]), since)[0]), None)
            if at is None:
                found.append((since, n))
                return found, IDENT if named(np.array([n]), since)[0] else OUT
            found.append((since, at))
            since, state = at + 1, COMMENT

    out = []
    for state in states:
        own, end = spans(state)
        first, last, most = -1, -1, -1
        for a, b in own:
            k = mark[(mark >= a) & (mark < b)]
            k = k[~named(k, a)]
            if not len(k):
                continue
            first = int(start[k[0]]) if first < 0 else first
            plain = size[k].max() <= 19 and size[k].min() >= 2
            ticks, good = digits_of(buf, start[k] + 1, size[k] - 1, 10) if plain else (None, np.zeros(1, bool))
            ticks = ticks.astype(np.int64).tolist() if good.all() else times(k)
            if ticks:
                last, most = ticks[-1], max(most, max(ticks))
        out.append(Outline(end, first, last, most))
    return out


def parsed(
    data: bytes, base: int, ids: set[str] | None, low: int | None, high: int | None, step: int = SLICE, time: int = 0
) -> Iterator[pa.RecordBatch]:
    """``scan`` in slices that start with a time mark; a slice that it leaves
    goes through ``tokens``. The text begins outside of comments and at
    ``time``. Nothing past the first time mark behind the window is read."""
    at, mark = 0, re.compile(rb"\n#\d")
    while at < len(data) and (high is None or time <= high):
        probe = at + step
        while True:
            cut = mark.search(data, probe)
            end = cut.start() + 1 if cut else len(data)
            part = data[at:end]
            if cut is None or ends_outside(part):
                break
            probe = end
        try:
            batches, time = scan(part, base + at, ids, low, high, time)
            yield from batches
        except (Odd, ParseError):
            rows = []
            for row in tokens(part, base + at, time):
                time = row[1]
                if high is not None and time > high:
                    break
                if (low is None or time >= low) and (ids is None or row[2] in ids):
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
        at = end


def ends_outside(part: bytes) -> bool:
    """Whether text that begins outside of comments ends so, with no value
    that awaits its identifier."""
    if b"$comment" in part:
        return outlines(part, [OUT])[0].state == OUT
    waiting, end = False, len(part)
    while True:  # back over tokens that look like values
        token = _TOKEN_BEFORE.search(part, max(0, end - 4096), end) or _TOKEN_BEFORE.search(part, 0, end)
        if token is None or token[1][:1] not in b"bBrRsS":
            return not waiting
        waiting, end = not waiting, token.start(1)


_TOKEN_BEFORE = re.compile(rb"(?:^|(?<=\s))(\S+)\s*\Z")


@dataclass(frozen=True)
class Cut:
    """A part of the body that begins with a time mark (or is the first): its
    offsets, the time before it, and the greatest time before it."""

    start: int
    end: int
    time: int
    most: int


def outline_at(path: str, start: int, end: int, first: bool) -> list[Outline]:
    """Outlines of the tokens that begin in [start, end), offsets from the
    beginning of the file."""
    with open_file(path) as f:
        size = f.size()
        f.seek(start if first else start - 1)
        data = f.read(end - f.tell())
        at = start if first else start - 1
        tail = len(data)
        while f.tell() < size and not data[-1:].isspace() and not re.search(rb"\s", data[tail:]):
            tail = len(data)
            data += f.read(1 << 16)
        stop = re.search(rb"\s", data[tail:]) if tail < len(data) else None
        data = data[: tail + stop.start()] if stop else data
    if not first and not data[:1].isspace():  # a token that began before
        space = re.search(rb"\s", data)
        skip = space.start() if space else len(data)
        data, at = data[skip:], at + skip
    return [Outline(o.state, o.first + at if o.first >= 0 else -1, o.last, o.most) for o in outlines(data)]


def chained(head: Header, found: Iterable[list[Outline]]) -> list[Cut]:
    """Cuts from the outlines of all nominal chunks in order."""
    state, time, most = OUT, 0, 0
    starts = [(head.body, 0, 0)]
    for k, per_state in enumerate(found):
        own = per_state[state]
        if k and own.first >= 0:
            starts.append((own.first, time, most))
        state = own.state
        if own.most >= 0:
            time, most = own.last, max(most, own.most)
    ends = [s[0] for s in starts[1:]] + [head.size]
    return [Cut(s, e, time, most) for (s, time, most), e in zip(starts, ends, strict=True)]


class Chunk(InputPartition):
    def __init__(self, path: str, cut: Cut) -> None:
        super().__init__(f"{path}:{cut.start}")
        self.path, self.cut = path, cut


class VcdReader(DataSourceReader):
    """Pushes down lists of identifier codes and bounds of time. The option
    ``cuts`` holds a JSON list of cuts; without it the file is one part."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.cuts = options.get("cuts")
        self.ids: set[str] | None = None
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (In, EqualTo)) and f.attribute == ("id_code",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.ids = wanted if self.ids is None else self.ids & wanted
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("time",):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("time",):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # Spark checks all of them again

    def partitions(self) -> list[Chunk]:
        if self.cuts is None:
            head = read_header(self.path)
            return [Chunk(self.path, Cut(head.body, head.size, 0, 0))]
        return [Chunk(self.path, Cut(*c)) for c in json.loads(self.cuts)]

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        cut = part.cut
        if self.high is not None and cut.most > self.high:
            return
        with open_file(part.path) as f:
            f.seek(cut.start)
            data = f.read(cut.end - cut.start)
        yield from parsed(data, cut.start, self.ids, self.low, self.high, time=cut.time)


class VcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcd"

    def schema(self) -> StructType:
        return CHANGES

    def reader(self, schema: StructType) -> VcdReader:
        return VcdReader(dict(self.options))


def cuts_of(spark: SparkSession, path: str, head: Header, step: int) -> list[Cut]:
    """Cuts about every ``step`` bytes, from outlines made on executors."""
    starts = list(range(head.body, head.size, step))
    if len(starts) < 2:
        return [Cut(head.body, head.size, 0, 0)]

    def outline(frames):
        for frame in frames:
            for k, at in zip(frame["k"], frame["at"], strict=True):
                found = outline_at(path, int(at), min(int(at) + step, head.size), at == head.body)
                yield pd.DataFrame({"k": [k] * 3, "state": range(3), "out": [[o.state, o.first, o.last, o.most] for o in found]})

    asked = spark.createDataFrame(pa.table({"k": np.arange(len(starts)), "at": np.array(starts, np.int64)}))
    asked = asked.repartition(min(len(starts), 4 * spark.sparkContext.defaultParallelism), "k")
    rows = asked.mapInPandas(outline, "k long, state int, out array<long>").collect()  # three small rows a chunk
    found = [[Outline(OUT)] * 3 for _ in starts]
    for r in rows:
        found[r["k"]][r["state"]] = Outline(*r["out"])
    return chained(head, found)


def read_vcd(spark: SparkSession, path: str, splittable: bool = True, chunk_bytes: int | None = None) -> Recording:
    share_code(spark)
    spark.dataSource.register(VcdSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    head = read_header(path)
    if chunk_bytes is None:
        chunk_bytes = min(CHUNK, max(SMALL_CHUNK, head.size // (4 * spark.sparkContext.defaultParallelism)))
    cuts = cuts_of(spark, path, head, chunk_bytes) if splittable else [Cut(head.body, head.size, 0, 0)]
    changes = spark.read.format("vcd").option("cuts", json.dumps([[c.start, c.end, c.time, c.most] for c in cuts])).load(path)
    columns = list(zip(*head.signals, strict=True)) or [()] * len(SIGNALS)
    declared = pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, SIGNALS, strict=True)], names=SIGNALS.names)
    return Recording(spark.createDataFrame(declared, SIGNALS), changes, head.timescale)


def raw_tokens(path: str) -> Iterator[tuple]:
    """The rows of CHANGES of a file, one after another, without Spark."""
    head = read_header(path)
    with open_file(path) as f:
        f.seek(head.body)
        yield from tokens(f.read(head.size - head.body), head.body, 0)


def signal_list(lines: DataFrame) -> DataFrame:
    """Names of a signals file's lines (column ``value``): comments after #,
    blanks at either end and empty lines go."""
    name = F.trim(F.regexp_replace(F.split_part(F.col("value"), F.lit("#"), F.lit(1)), "\\s+$|^\\s+", ""))
    return lines.withColumn("name", name).where("name <> ''")


def load_signal_list(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [name for line in f if (name := line.split("#")[0].strip())]


def value_lines() -> Column:
    """A change's line: a scalar where the value is one digit of text, a vector
    for integers and for digits with x or z, else a real or a string, so that
    reading gives the same kind and display."""
    disp, code = F.col("disp"), F.col("id_code")
    bits = F.array_join(F.transform(F.split("hex", "(?!$)"), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    bits = F.regexp_replace(bits, "^0+(?=.)", "")
    vector = disp.rlike("^[01xz]{2,}$") & (disp.rlike("[xz]") | (F.length(disp) > 128))
    return (
        F.when(F.col("kind") == "time", F.concat(F.lit("#"), F.col("time").cast("string")))
        .when(F.col("kind") == "int", F.concat(F.lit("b"), bits, F.lit(" "), code))
        .when(F.col("kind") == "real", F.concat(F.lit("r"), disp, F.lit(" "), code))
        .when(disp.isin("0", "1", "x", "z"), F.concat(disp, code))
        .otherwise(F.concat(F.when(vector, F.lit("b")).otherwise(F.lit("s")), disp, F.lit(" "), code))
    )


def body_text(rec: Recording, note: str | None = None) -> DataFrame:
    """The lines of the body (column ``value``) in order, partition after
    partition. Each partition begins with its time, and with ``note`` as a
    comment if given; a time that repeats what went before changes nothing."""
    share_code(rec.changes.sparkSession)
    rows = rec.changes.select("seq", "time", "kind", value_lines().alias("line"))
    rows = rows.repartitionByRange("seq").sortWithinPartitions("seq")

    def text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("time").to_numpy()
            marked = pc.equal(batch.column("kind"), "time").to_numpy(zero_copy_only=False)
            begins = np.diff(at, prepend=at[0] if time is None else time) != 0
            begins[0] |= time is None and bool(at[0] or note)
            before = np.flatnonzero(begins & ~marked)
            lines = batch.column("line").to_pylist()
            for k in before.tolist():
                lines[k] = f"#{at[k]}\n{lines[k]}"
            if time is None and note:
                lines[0] = f"$comment\n{note}\n$end\n{lines[0]}"
            time = int(at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return rows.mapInArrow(text, "value string")


def header_text(signals: DataFrame, timescale: tuple[int, str] | None) -> str:
    """A header; it is bounded by the design."""
    out = [f"$timescale {timescale[0]} {timescale[1]} $end\n"] if timescale else []
    for s in signals.orderBy("ord").collect():
        parts = s["name"].split(".")
        out += [f"$scope module {p} $end\n" for p in parts[:-1]]
        out.append(f"$var {s['var_type']} {s['size']} {s['id_code']} {parts[-1]} $end\n")
        out.append("$upscope $end\n" * (len(parts) - 1))
    return "".join([*out, "$enddefinitions $end\n"])


def write_vcd(rec: Recording, path: str, note: str | None = None) -> None:
    """A file with the recording's changes. Executors write the body in parts,
    one a partition, which are then copied behind the header as bytes."""
    spark = rec.changes.sparkSession
    parts = f"{path}.parts"
    body_text(rec, note).write.mode("overwrite").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray(header_text(rec.signals, rec.timescale).encode("utf-8")))
    for name in sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")):
        part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()
    fs.delete(folder, True)
