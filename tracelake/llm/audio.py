"""Media columns: payloads as 8-bit audio, and features of what is stored.

A payload is stored as a WAV file of unsigned 8-bit mono samples. Features come
from the samples read back: polyphase resampling, log-mel filterbanks of
overlapped frames, and a hysteresis segmentation by energy. Log-mels are kept
as tensors of one fixed shape with their spans of time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.arrow import map_slices

RATE, UP, DOWN = 16_000, 1, 2  # samples a second as stored; resampled by UP / DOWN
TAPS = 16  # of the filter on either side, in output samples
FRAME, HOP, MELS = 256, 128, 24
SHAPE = (32, MELS)  # frames and bands of a tensor
ON, OFF = 3.0, -3.0  # dB against the median energy at which a segment begins and ends
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with zero bytes up to a positive multiple of 64, and
    its length without them."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0), len(raw)


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit samples; they are the payload's bytes. Payloads of
    4 GiB and more don't fit the format and are an error."""
    pad = len(payload) % 2
    head = HEADER.pack(b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + bytes(pad)


def read_wav(media: bytes) -> tuple[memoryview, int]:
    """Samples and rate of an 8-bit mono file, found by walking its chunks."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, data = 12, None, None
    while at + 8 <= len(view) and data is None:
        name, size = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            data = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if rate is None or data is None or len(data) == 0:
        raise ValueError("incomplete WAV file")
    return data, rate


@lru_cache(maxsize=8)
def branches(up: int, down: int, taps: int) -> list[np.ndarray]:
    """The polyphase branches of a windowed-sinc low-pass filter."""
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.kaiser(len(n), 6.0) / max(up, down) * up
    return [h[p :: up * down] for p in range(up * down)]


def resample(x: np.ndarray, up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Rate times up / down. Output m is the sum over n of h[m down - n up]
    x[n]; only products that are needed are made: outputs of one residue modulo
    up use every up-th coefficient, inputs of one residue modulo down."""
    half = taps * max(up, down)
    out = np.zeros(-(-len(x) * up // down))
    branch = branches(up, down, taps)
    for residue in range(up):
        m = np.arange(residue, len(out), up)
        if not len(m):
            continue
        for r in range(down):  # inputs n = r modulo down
            # h index: m * down - n * up + half, with m = residue + up * i, n = r + down * j
            offset = residue * down - r * up + half
            lag = offset // (up * down)
            part = branch[offset - lag * up * down]
            xs = x[r::down]
            if not len(xs):
                continue
            full = np.convolve(xs, part)  # full[q] = sum_j xs[j] part[q - j]; q = i + lag
            q = np.arange(len(m)) + lag
            ok = (q >= 0) & (q < len(full))
            out[m[ok]] += full[q[ok]]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int) -> np.ndarray:
    """Triangular bands, evenly spaced in mels, over the bins of a frame."""

    def mel(f):
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


WINDOW = np.hanning(FRAME + 1)[:-1]


def frames_of(y: np.ndarray) -> np.ndarray:
    """Overlapped frames that cover the signal, zeros behind its end."""
    count = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    padded = np.zeros((count - 1) * HOP + FRAME)
    padded[: len(y)] = y
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def segments(energy: np.ndarray) -> np.ndarray:
    """Rows (first, end) of runs of frames: a run starts where the energy, in
    dB against its median, reaches ON and lasts until it falls below OFF."""
    level = energy - np.median(energy)
    mark = np.where(level >= ON, 1, np.where(level < OFF, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


BLOCK = 4096  # frames that are transformed at a time


def features(samples: memoryview, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tensors [n, *SHAPE] of log-mels in 1/64 natural-log units (16-bit), the
    spans of time of each, the segments' spans, and frame energies in dB."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    y = resample(x, UP, DOWN)
    rate = rate * UP // DOWN
    framed, bank = frames_of(y), mel_bank(rate)
    mels, energy = [], []
    for at in range(0, len(framed), BLOCK):
        power = np.abs(np.fft.rfft(framed[at : at + BLOCK] * WINDOW, axis=1)) ** 2
        mels.append(np.log(power @ bank + 1e-6))
        energy.append(10 * np.log10(power.mean(axis=1) + 1e-9))
    mel, level = np.concatenate(mels), np.concatenate(energy)
    n = -(-len(mel) // SHAPE[0])
    tensor = np.zeros((n * SHAPE[0], MELS), np.int16)
    tensor[: len(mel)] = np.rint(mel * 64)
    first = np.arange(n) * SHAPE[0]
    end = np.minimum(first + SHAPE[0], len(mel))
    seconds = lambda a, b: np.stack([a * HOP / rate, np.minimum(((b - 1) * HOP + FRAME) / rate, len(y) / rate)], axis=1)
    runs = segments(level)
    return tensor.reshape(n, *SHAPE), seconds(first, end), seconds(runs[:, 0], runs[:, 1]), level


def digest(tensor: np.ndarray, spans: np.ndarray, runs: np.ndarray) -> str:
    """The numbers of tensors and segments and a checksum of the tensors, their
    spans and the segments' spans (in thousandths), as text."""
    crc = zlib.crc32(tensor.astype("<i2").tobytes())
    for x in (spans, runs):
        crc = zlib.crc32(np.rint(x * 1000).astype("<i4").tobytes(), crc)
    return f"{len(tensor)}x{SHAPE[0]}x{MELS}:{len(runs)}:{crc:08x}"


SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])
TENSOR = pa.fixed_shape_tensor(pa.int16(), SHAPE)
PLAIN = "id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
TENSORS = "tensors array<array<smallint>>, tensor_spans array<struct<start:double,end:double>>, segments array<struct<start:double,end:double>>"


def span_list(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros((0, 2))
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def fixed_shape(parts: list[np.ndarray]) -> pa.FixedShapeTensorArray:
    """All tensors of a batch as one Arrow array of fixed shape."""
    flat = np.concatenate([p.reshape(-1) for p in parts]) if parts else np.zeros(0, np.int16)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), SHAPE[0] * SHAPE[1]))


def stored_tensors(tensors: pa.FixedShapeTensorArray, ends: np.ndarray) -> pa.Array:
    """Each row's tensors in the storage that Spark has a type for, lists of
    flattened tensors; ``as_tensors`` restores the array."""
    size = SHAPE[0] * SHAPE[1]
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(tensors) * size + 1, size), pa.int32()), tensors.storage.flatten())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """A column of flattened tensors as an Arrow array of fixed shape."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if len(column) and len(flat) != len(column) * SHAPE[0] * SHAPE[1]:
        raise ValueError("a tensor has another shape")
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat.cast(pa.int16()), SHAPE[0] * SHAPE[1]))


def _step(with_media: bool):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, medias, parts, spans, runs = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            payload, n = payload_of(text)
            media = write_wav(payload)
            samples, rate = read_wav(media)
            tensor, span, run, _ = features(samples, rate)
            back = bytes(samples)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest()))
            medias.append(media if with_media else None)
            parts.append(tensor)
            spans.append(span)
            runs.append(run)
        tensors, ends = fixed_shape(parts), np.cumsum([0, *map(len, parts)])
        held = tensors.to_numpy_ndarray()
        marks = [digest(held[a:b], s, r) for a, b, s, r in zip(ends[:-1].tolist(), ends[1:].tolist(), spans, runs, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
        arrays += [pa.array(marks, pa.string()), stored_tensors(tensors, ends), span_list(spans), span_list(runs)]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "tensor_spans", "segments"]
        if with_media:
            arrays.append(pa.array(medias, pa.binary()))
            names.append("media")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return step


def media_columns(docs: DataFrame, with_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, tensors, tensor_spans, segments[,
    media]), one per row of ``docs``.

    Checksums are those of the samples read back; ``feature`` sums up the
    tensors and spans of the same row. Spark has no type for tensors: what it
    holds is the storage of the Arrow arrays. Each text's features are
    computed alone, so equal texts have equal values. A null text is empty:
    its payload is 64 zero bytes. Repeated rows and null ids are kept; other
    columns aren't read.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = PLAIN.format(kind=df.schema["id"].dataType.simpleString()) + TENSORS + ", media binary" * with_media
    return map_slices(df, "text", schema, partial(_step, with_media)).withColumnRenamed("id", id_col)
