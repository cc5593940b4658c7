import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import audio
from tracelake.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (3, 2), (2, 3), (1, 1)])
def test_resample_equals_the_definition(up, down):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(91)
    taps = 4
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.kaiser(len(n), 6.0) / max(up, down) * up
    want = [
        sum(h[m * down - k * up + half] * x[k] for k in range(len(x)) if 0 <= m * down - k * up + half < len(h))
        for m in range(-(-len(x) * up // down))
    ]
    assert np.allclose(audio.resample(x, up, down, taps), want)


def test_resample_keeps_a_tone():
    t = np.arange(4000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 440 * t), 1, 2)
    want = np.sin(2 * np.pi * 440 * np.arange(2000) / 8000)
    assert np.abs(y - want)[100:-100].max() < 0.01


def test_segments_by_hysteresis():
    level = np.array([0, 0, 4, 1, -2, -4, 0, 2, 0, 5, 0, 0, 0, 0, 0.0])
    state, want = False, []
    for v in level - np.median(level):
        state = True if v >= audio.ON else False if v < audio.OFF else state
        want.append(state)
    got = np.zeros(len(level), bool)
    for a, b in audio.segments(level):
        got[a:b] = True
    assert got.tolist() == want


def test_tone_lights_its_band():
    t = np.arange(16000) / 16000
    samples = np.rint(128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    tensor, spans, _, _ = audio.features(memoryview(samples), 16000)
    bank = audio.mel_bank(8000)
    band = int(bank[np.argmin(np.abs(np.linspace(0, 4000, 129) - 1000))].argmax())
    assert int(tensor[0][4].argmax()) == band
    assert spans[0][0] == 0 and spans[-1][1] == 1.0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_round_trip(n):
    payload, size = audio.payload_of("a" * n)
    assert size == n and len(payload) == max(64, -(-n // 64) * 64)
    back, rate = audio.read_wav(audio.write_wav(payload))
    assert bytes(back) == payload and rate == audio.RATE


def plain_features(samples):
    """Log-mels, spans and segments by their definitions, a number at a time."""
    x = [(b - 128) / 128 for b in samples]
    half = audio.TAPS * 2
    h = [np.sinc(n / 2) * np.i0(6.0 * math.sqrt(1 - (n / half) ** 2)) / np.i0(6.0) / 2 for n in range(-half, half + 1)]
    y = [sum(h[2 * m - k + half] * x[k] for k in range(max(0, 2 * m - half), min(len(x), 2 * m + half + 1))) for m in range(-(-len(x) // 2))]
    rate = audio.RATE // 2
    count = 1 + max(0, math.ceil((len(y) - 256) / 128))

    def mel(f):
        return 2595 * math.log10(1 + f / 700)

    edges = [700 * (10 ** (mel(rate / 2) * i / 25 / 2595) - 1) for i in range(26)]
    waves = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    mels, level = [], []
    for f in range(count):
        frame = [(y[f * 128 + i] if f * 128 + i < len(y) else 0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 256)) for i in range(256)]
        power = [abs(v) ** 2 for v in waves @ np.array(frame)]
        row = []
        for b in range(24):
            low, top, high = edges[b : b + 3]
            share = [max(0, min((k * rate / 256 - low) / (top - low), (high - k * rate / 256) / (high - top))) for k in range(129)]
            row.append(math.log(sum(s * p for s, p in zip(share, power, strict=True)) + 1e-6) * 64)
        mels.append(row)
        level.append(10 * math.log10(sum(power) / 129 + 1e-9))
    middle, on, runs = sorted(level), False, []
    middle = (middle[(count - 1) // 2] + middle[count // 2]) / 2
    for f, v in enumerate([*level, -1e9]):
        now = f < count and (v - middle >= audio.ON or (on and v - middle >= audio.OFF))
        if now and not on:
            runs.append([f, f])
        if not now and on:
            runs[-1][1] = f
        on = now

    def seconds(a, b):
        return a * 128 / rate, min(((b - 1) * 128 + 256) / rate, len(y) / rate)

    return mels, [seconds(a, min(a + 32, count)) for a in range(0, count, 32)], [seconds(a, b) for a, b in runs]


def test_features_equal_a_plain_implementation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").orderBy("doc_id").limit(12)
    rows = audio.media_columns(docs).collect()
    assert len(rows) == 12
    for r in rows:
        samples, _ = audio.read_wav(r["media"])
        mels, spans, runs = plain_features(samples)
        held = audio.as_tensors(pa.array(r["tensors"], pa.list_(pa.int16()))).to_numpy_ndarray()
        found = held.reshape(-1, audio.MELS)
        assert len(held) == -(-len(mels) // 32) and not found[len(mels) :].any()
        assert np.abs(found[: len(mels)] - np.array(mels)).max() <= 0.5 + 1e-6
        assert np.allclose([tuple(s) for s in r["tensor_spans"]], spans) and np.allclose(np.reshape([tuple(s) for s in r["segments"]], (-1, 2)), np.reshape(runs, (-1, 2)))
        crc = zlib.crc32(held.tobytes())
        for x in (spans, runs):
            crc = zlib.crc32(np.rint(np.reshape(x, (-1, 2)) * 1000).astype("<i4").tobytes(), crc)
        assert r["feature"] == f"{len(held)}x32x24:{len(runs)}:{crc:08x}"


def test_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_audio_media"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    by_text = {}
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(audio.write_wav(payload)).hexdigest()
        assert by_text.setdefault(d["text"], r["feature"]) == r["feature"]
    assert len(rows) == len(docs)


def test_edge_rows_and_tensors(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (2, "", b"x"), (None, "é" * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    out = sorted(audio.media_columns(df).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["n_bytes"], r["payload_bytes"]) for r in out] == [(80_000, 80_000), (0, 64), (0, 64), (0, 64)]
    for r in out:
        back, rate = audio.read_wav(r["media"])
        assert len(back) == r["payload_bytes"]
        tensor, spans, runs, _ = audio.features(back, rate)
        held = audio.as_tensors(pa.array(r["tensors"], pa.list_(pa.int16())))
        assert (held.to_numpy_ndarray() == tensor).all()
        assert [tuple(s) for s in r["tensor_spans"]] == [tuple(s) for s in spans]
        assert len(r["segments"]) == len(runs)
    assert audio.media_columns(df.limit(0)).count() == 0
