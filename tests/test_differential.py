import random

import pytest

from tests import waves
from tracelake.errors import ParseError
from tracelake.model import CHANGES, SIGNALS, Recording, Window
from tracelake.operators import compare, extract, find, timeline, toggle, trace
from tracelake.sources import vcd
from tracelake.streaming.toggles import streaming_toggles


def random_recording(spark, seed):
    r = random.Random(seed)
    codes = ["!", "#", "%"]
    signals = [(i, f"s{i}", r.choice(codes), r.choice([1, 4, 9]), "wire", []) for i in range(5)]
    time, changes = 0, []
    for seq in range(120):
        if r.random() < 0.5:
            time += r.choice([0, 1, 1, 5, 40])
            changes.append((seq, time, None, "time", None))
            continue
        kind = r.choice(["int", "int", "text"])
        disp = str(r.randint(0, 5)) if kind == "int" else r.choice(["x", "z", "1x0", "1", "0"])
        changes.append((seq, time, r.choice(codes), kind, disp))
    rows = [(s, t, c, k, d, d and d.lower(), format(int(d), "x") if k == "int" else None, None) for s, t, c, k, d in changes]
    return signals, changes, Recording(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(rows, CHANGES), None)


@pytest.mark.parametrize("seed", range(4))
def test_operators_equal_a_direct_interpreter(spark, monkeypatch, seed):
    # small buckets, so that everything crosses them
    monkeypatch.setattr(timeline, "BUCKET_ROWS", 3)
    monkeypatch.setattr(timeline.count_switches, "__defaults__", (11,))
    signals, changes, rec = random_recording(spark, seed)
    names = [s[1] for s in signals]
    for lo, hi in ((None, None), (10, 60)):
        window = Window(lo, hi)
        got = {r["signal"]: r["toggles"] for r in toggle.toggles(rec.signals, rec.changes, names, window).collect()}
        assert got == waves.count_toggles(changes, signals, names, (lo, hi))
        assert [tuple(r) for r in extract.extract_aligned(rec.signals, rec.changes, names, window).collect()] == waves.aligned(changes, signals, names, (lo, hi))
    other_signals, other_changes, other = random_recording(spark, seed + 100)
    for ignore, limit in ((False, None), (True, 2)):
        found = compare.compare(rec, other, ignore_unknown=ignore, max_mismatches=limit).mismatches.orderBy("signal", "time").collect()
        assert [tuple(r) for r in found] == waves.differences((changes, signals), (other_changes, other_signals), names, (None, None), ignore, limit)


def test_long_spans_fill_buckets_evenly(spark, monkeypatch):
    """Ticks of femtoseconds: buckets follow the rows, not the unit."""
    monkeypatch.setattr(timeline, "BUCKET_ROWS", 16)
    step = 10**12
    rows = [(t * step, str(t) if t % 3 == 0 else None) for t in range(500)]
    df = spark.createDataFrame(rows, "time long, v string")
    out = timeline.carry_forward(df, [], "time", ["v"])
    assert [(r["time"], r["v"]) for r in out.orderBy("time").collect()] == [(t * step, str(t - t % 3)) for t in range(500)]
    before = timeline.carry_forward(df, [], "time", ["v"], include_current=False).orderBy("time").collect()
    assert [r["v"] for r in before] == [None, *[str(t - t % 3) for t in range(499)]]


def test_sources_are_read_once(spark, tmp_path):
    """What is carried forward is stored, so a file is parsed once a side."""
    (tmp_path / "a.vcd").write_text(waves.A)
    rec = vcd.read_vcd(spark, str(tmp_path / "a.vcd"))
    for df in (extract.extract_aligned(rec.signals, rec.changes, ["tb.clk"]), compare.compare(rec, rec).mismatches, trace_of(spark, tmp_path)):
        assert "vcd" not in df._jdf.queryExecution().executedPlan().toString().lower().replace(str(tmp_path).lower(), "")


def trace_of(spark, tmp_path):
    (tmp_path / "t.vcd").write_text(waves.TRACE)
    return trace.trace(vcd.read_vcd(spark, str(tmp_path / "t.vcd")), waves.TRACE_NAMES)


def body(r, n):
    time, out = 0, []
    codes = ["!", "b", "r1", "#", "0", "$x", "s", "z!"]
    for _ in range(n):
        kind, code = r.randrange(9), r.choice(codes)
        if kind < 2:
            time += r.choice([0, 1, 9])
            out.append(f"#{time}")
        elif kind < 5:
            out.append(r.choice("01xzXZ") + code)
        elif kind < 7:
            out.append(r.choice("bB") + "".join(r.choices("01" if r.random() < 0.7 else "01xzXZ", k=r.choice([0, 1, 8, 33, 64, 65, 128, 129]))) + " " + code)
        elif kind == 7:
            out.append(r.choice([f"r{r.uniform(-5, 5)} {code}", f"sText{n} {code}", "r1e3\n" + code]))
        else:
            out.append(r.choice(["$dumpvars", "$end", "$comment #5 b1 ! $end" if r.random() < 0.3 else "$dumpoff"]))
    return "\n".join(out).encode() + b"\n"


@pytest.mark.parametrize("seed", range(40))
def test_arrays_read_what_tokens_read(seed):
    r = random.Random(seed)
    data = body(r, r.choice([0, 1, 5, 60, 400]))
    for ids, low, high in ((None, None, None), ({"!", "b", "#"}, 3, None), (None, 2, 20), (set(), None, 9)):
        want = [t for t in vcd.tokens(data, 7, 0) if (low is None or t[1] >= low) and (high is None or t[1] <= high) and (ids is None or t[2] in ids)]
        for step in (1 << 20, 50):
            got = [tuple(x.values()) for b in vcd.parsed(data, 7, ids, low, high, step) for x in b.to_pylist()]
            assert sorted(got) == sorted(want)


@pytest.mark.parametrize("bad", [b"#5\n#4\n", b"1\n", b"b01\n", b"#x\n", b"q!\n", b"rzz !\n", b"b012 !\n", b"#1\n$what\n"])
def test_arrays_fail_where_tokens_fail(bad):
    with pytest.raises(ParseError):
        list(vcd.parsed(bad, 0, None, None, None))
    with pytest.raises(ParseError):
        list(vcd.parsed(b"#1\n1!\n" + bad, 0, None, None, None, 1))
    assert list(vcd.parsed(b"#99\n1!\n" + bad, 0, None, None, 3)) == []


WORDS = ["$comment", "$comment", "$end", "$end", "#5 1%", "b", "b01", "r", "s$end", "note", "$dumpvars", "0!", "1b", "#", "#x"]


def commented(r, n):
    """Bodies with comments over lines, values that await their identifier
    over lines, and what looks like either."""
    time, out = 0, []
    for _ in range(n):
        kind = r.randrange(8)
        if kind < 3:
            time += r.choice([0, 1, 9])
            out.append(f"#{time}")
        elif kind < 5:
            out.append(r.choice(["1!", "0b", "xr", "b0101 b", "b1 $comment", "b1 $end", "bx1\n#3", "r0.5\ns", "sabc b"]))
        else:
            inner = [r.choice(WORDS[:1] + WORDS[4:]) for _ in range(r.randrange(4))]
            out.append("\n".join(["$comment", *inner, "$end"]))
    return "\n".join(out).encode()


def read_cut(data, chunk, step, high, tmp_path):
    path = tmp_path / "cut.vcd"
    head_text = b"$var wire 1 ! a $end\n$enddefinitions $end\n"
    path.write_bytes(head_text + data)
    head = vcd.read_header(str(path))
    starts = range(head.body, max(head.size, head.body + 1), chunk)
    found = [vcd.outline_at(str(path), at, min(at + chunk, head.size), at == head.body) for at in starts]
    reader = vcd.VcdReader({"path": str(path), "cuts": vcd.json.dumps([[c.start, c.end, c.time, c.most] for c in vcd.chained(head, found)])})
    reader.high = high
    out = []
    for part in reader.partitions():
        if reader.high is not None and part.cut.most > reader.high:
            continue
        text = (head_text + data)[part.cut.start : part.cut.end]
        for b in vcd.parsed(text, part.cut.start - head.body, None, None, high, step, part.cut.time):
            out += [tuple(x.values()) for x in b.to_pylist()]
    assert sum(len(list(reader.read(p))) >= 0 for p in reader.partitions()) == len(reader.partitions())
    return out


def whole(data, high):
    out = []
    for row in vcd.tokens(data, 0, 0):
        if high is not None and row[1] > high:
            break
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_cuts_change_nothing(tmp_path, seed):
    r = random.Random(seed)
    data = commented(r, r.choice([1, 6, 40, 150]))
    if seed % 4 == 1:  # loose words: errors, too
        data += b"\n" + "\n".join(r.choice(WORDS) for _ in range(8)).encode()
    if seed % 4 == 2:  # a time that goes back
        data += b"\n#2\n1!\n" + commented(r, 5)
    for high in (None, 20):
        try:
            want = whole(data, high)
        except ParseError:
            want = None
        for chunk, step in ((7, 1 << 20), (29, 10), (64, 1), (500, 33)):
            if want is None:
                with pytest.raises(ParseError):
                    read_cut(data, chunk, step, high, tmp_path)
            else:
                assert sorted(read_cut(data, chunk, step, high, tmp_path)) == sorted(want)


def test_comments_over_lines_and_cuts(spark, tmp_path):
    path = tmp_path / "c.vcd"
    path.write_text("$var wire 1 ! a $end\n$var wire 1 % b $end\n$enddefinitions $end\n#1\n1!\n$comment\nnote\n#5\n1%\n$end\n#9\n0!\n")
    want = vcd.read_vcd(spark, str(path), splittable=False).changes.orderBy("seq").collect()
    assert [(r["time"], r["id_code"]) for r in want] == [(1, None), (1, "!"), (9, None), (9, "!")]
    for size in (1, 5, 12, 40):
        assert vcd.read_vcd(spark, str(path), chunk_bytes=size).changes.orderBy("seq").collect() == want
    assert [t[:3] for t in vcd.raw_tokens(str(path))] == [tuple(r)[:3] for r in want]


def test_backward_times_fail_however_cut(spark, tmp_path):
    path = tmp_path / "b.vcd"
    path.write_text("$var wire 1 ! a $end\n$enddefinitions $end\n#10\n1!\n#20\n0!\n#5\n1!\n#6\n0!\n")
    for size in (1, 8, 12, 1000):
        changes = vcd.read_vcd(spark, str(path), chunk_bytes=size).changes
        with pytest.raises(Exception, match="time goes back from 20 to 5"):
            changes.collect()
        assert changes.where("time <= 15").count() == 2  # behind the window's end nothing is read


def test_nth_by_buckets(spark):
    rows = spark.createDataFrame([(s, s * 10) for s in range(3, 90, 4)], "seq long, time long")
    for n in (1, 2, 7, 22, 23):
        want = [tuple(r) for r in find.nth(rows, "seq", n).collect()]
        assert [tuple(r) for r in find.nth(rows, "seq", n, top=0, width=16).collect()] == want


def test_streaming_toggles_equal_batch(spark, tmp_path):
    signals, changes, _ = random_recording(spark, 3)
    rows = [(c, s, d) for s, _, c, k, d in changes if k != "time"]
    schema = "signal string, seq long, value string"
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    query = (
        streaming_toggles(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda df, i: found.extend(df.collect()))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {r["signal"]: r["toggles"] for r in found}
    want, last = {}, {}
    for c, _, d in rows:
        want[c] = want.get(c, 0) + (c in last and last[c] not in ("", d))
        last[c] = d
    assert got == want
