import json
import random

import pytest

from tests import waves
from tracelake import api, cli, render, session
from tracelake.errors import DuplicateSignal, InvalidOccurrence, MissingEndDefinitions, MissingSignal, MissingSignals, ParseError
from tracelake.functions import parse_target
from tracelake.model import VERSION, Window
from tracelake.operators import compare, select
from tracelake.operators.trace import DEFAULT_PATHS, load_paths, trace
from tracelake.sources.vcd import decode_vector, float_display, load_signal_list, parse_header, read_header, read_vcd, sanitize_scopes, tokens, write_vcd

ALL = ["tb.clk", "tb.rst_n", "tb.cnt[7:0]", "tb.temp", "tb.u.clk_i"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vcd")
    out = {}
    for name in ("A", "B", "C", "TRACE"):
        out[name] = str(root / f"{name}.vcd")
        with open(out[name], "w") as f:
            f.write(getattr(waves, name))
    return out


def test_list(files):
    assert api.list_signals(files["A"]) == ALL
    assert api.list_signals(files["A"], "clk") == ["tb.clk", "tb.u.clk_i"]
    assert api.list_signals(files["A"], "nope") == []


def test_meta(files):
    assert api.metadata(files["A"]) == {"signal_count": 5, "timescale": "1 ns", "start_time": 0, "end_time": 20}


def test_extract_long(files):
    got = [(r["signal"], r["time"], r["value"]) for r in api.extract(files["A"], ["tb.u.clk_i", "tb.clk"], 0, 5)]
    assert got == [("tb.u.clk_i", 0, "0"), ("tb.clk", 0, "0"), ("tb.u.clk_i", 5, "1"), ("tb.clk", 5, "1")]
    assert api.extract(files["A"], ["tb.clk"], 999) == []
    assert api.extract(files["A"], []) == []
    with pytest.raises(MissingSignals, match="tb.nope, zz"):
        api.extract(files["A"], ["tb.nope", "tb.clk", "zz"])


def test_extract_grids(files):
    rows = lambda **k: [tuple(r.values()) for r in api.extract(files["A"], ALL[:4], **k)]
    assert rows(layout="aligned") == [(0, "0", "0", "0x00", "0.5"), (5, "1", "0", "0x05", "0.5"), (10, "0", "1", "1x0", "0.5"), (15, "1", "1", "0xff", "1")]
    assert rows(layout="sparse") == [(0, "0", "0", "0", "0.5"), (5, "1", "", "5", ""), (10, "0", "1", "1x0", ""), (15, "1", "", "255", "1")]
    late = api.extract(files["A"], ["tb.clk", "tb.temp"], start=6, layout="aligned")
    assert [tuple(r.values()) for r in late] == [(10, "0", ""), (15, "1", "1")]


def test_toggles(files):
    assert api.toggles(files["A"], ALL) == dict(zip(ALL, (3, 2, 4, 1, 3), strict=True))
    assert api.toggles(files["A"], ALL, 6, 15) == dict(zip(ALL, (1, 0, 1, 0, 1), strict=True))
    with pytest.raises(MissingSignals):
        api.toggles(files["A"], ["tb.nope"])


def test_find(files):
    find = lambda *a, **k: api.find(files["A"], *a, **k)
    assert find("tb.clk", "1", 2)["time"] == 15
    assert find("tb.clk", "1", 3) == {"found": False, "signal": "tb.clk", "time": None, "value": None}
    assert find("tb.rst_n", "1", 2)["time"] == 10
    assert (find("tb.cnt[7:0]", "0xff")["time"], find("tb.cnt[7:0]", "0xFF", fmt="sized")["value"], find("tb.cnt[7:0]", "255")["value"]) == (15, "0xff", "255")
    assert find("tb.temp", "1")["time"] == 15
    assert (find("tb.cnt[7:0]", "x")["time"], find("tb.cnt[7:0]", "1x0")["time"]) == (0, 10)
    with pytest.raises(InvalidOccurrence):
        find("tb.clk", "1", 0)
    with pytest.raises(MissingSignal):
        find("tb.nope", "1")


def test_compare(files):
    r = api.compare(files["A"], files["B"])
    assert r["common_signals"] == ["tb.clk", "tb.cnt[7:0]", "tb.rst_n", "tb.temp"]
    assert (r["signals_only_in_file1"], r["signals_only_in_file2"]) == (["tb.u.clk_i"], ["tb.u.extra"])
    assert r["mismatches"] == [{"signal": "tb.clk", "time": 15, "value1": "1", "value2": "0", "is_unknown": False}]
    assert (r["total_mismatches"], r["signals_with_mismatches"], r["passed"]) == (1, 1, False)
    late = api.compare(files["A"], files["B"], start=12)
    assert [tuple(m.values()) for m in late["mismatches"]] == [("tb.clk", 15, "1", "x", True)]
    assert api.compare(files["A"], files["B"], start=12, ignore_unknown=True)["passed"]
    assert api.compare(files["A"], files["A"])["passed"]
    found = lambda **k: [tuple(m.values()) for m in api.compare(files["A"], files["C"], **k)["mismatches"]]
    x, y, z = ("tb.cnt[7:0]", 0, "0", "z", True), ("tb.cnt[7:0]", 10, "1x0", "4", False), ("tb.temp", 0, "0.5", "0.25", False)
    assert found() == [x, y, z]
    assert found(ignore_unknown=True) == [y, z]
    assert found(max_mismatches=1) == found(max_mismatches=0) == [x, z]
    assert found(signals=["tb.temp", "unheard.of"]) == [z]


def test_compare_json(spark, files):
    first, second = read_vcd(spark, files["A"]), read_vcd(spark, files["B"])
    found = json.loads(compare.summary_json(compare.compare(first, second)).first()["json"])
    assert found == {
        "common_signal_count": 4,
        "total_mismatches": 1,
        "signals_with_mismatches": 1,
        "passed": False,
        "mismatches_by_signal": {"tb.clk": 1},
        "signals_only_in_file1": ["tb.u.clk_i"],
        "signals_only_in_file2": ["tb.u.extra"],
    }


def test_trace(spark, files, tmp_path):
    lines = [r["line"] for r in trace(read_vcd(spark, files["TRACE"]), waves.TRACE_NAMES).collect()]
    pc = "PC : 0x00000100 I : 0x00400113 "
    assert lines == [pc, "x01 <= 0x00000004", pc, "x01 <= 0x0000000X"]
    paths, out = tmp_path / "paths.json", tmp_path / "trace.txt"
    paths.write_text(json.dumps(waves.TRACE_NAMES | {"other": 1}))
    assert load_paths(str(paths)) == waves.TRACE_NAMES and load_paths() == DEFAULT_PATHS
    assert cli.main(["trace", files["TRACE"], "--output", str(out), "--signal-path", str(paths)]) == 0
    assert out.read_text() == "\n".join(lines) + "\n"
    assert cli.main(["trace", files["TRACE"], "--output", str(out)]) == 1


def test_chunks_change_nothing(spark, files):
    whole = read_vcd(spark, files["A"], splittable=False).changes.orderBy("seq").collect()
    for size in (1, 7, 30):
        assert read_vcd(spark, files["A"], chunk_bytes=size).changes.orderBy("seq").collect() == whole


def test_filters_reach_the_reader(spark, files):
    changes = read_vcd(spark, files["A"]).changes
    assert changes.where("id_code in ('!') and time >= 5 and time <= 10").count() == 2


KINDS = """$timescale 10 ps $end
$var wire 1 ! a $end
$var real 64 $ r $end
$var reg 8 # v $end
$var string 1 % s $end
$enddefinitions $end
1!
$dumpvars
x!
b0 #
r-0 $
sA_b1 %
$end
#3
z!
bx01z #
bX #
s10 %
rnan $
#7
r1e21 $
b1010 #
b11111111000000001111111100000000111111110000000011111111000000001 #
$dumpoff
x!
$end
"""


def test_write_and_read(spark, files, tmp_path):
    (tmp_path / "kinds.vcd").write_text(KINDS + f"b{'1' * 129} #\n")
    cols = ["time", "id_code", "kind", "disp", "norm", "hex", "bits64"]
    for source in (files["A"], str(tmp_path / "kinds.vcd")):
        rec = read_vcd(spark, source)
        for note in (None, "part\n#0 1! b1\n#99999"):
            path = str(tmp_path / "again.vcd")
            write_vcd(rec, path, note)
            values = lambda r: [tuple(x) for x in r.changes.where("kind <> 'time'").orderBy("seq").select(cols).collect()]
            for size in (None, 9):
                back = read_vcd(spark, path, chunk_bytes=size)
                assert values(rec) == values(back)
            assert back.signals.select("name", "id_code", "size", "var_type").collect() == rec.signals.select("name", "id_code", "size", "var_type").collect()
            assert back.timescale == rec.timescale


def test_small_cases():
    assert [parse_target(x) for x in ("42", "0xff", "0xFF", " z ", "+007", "0x")] == ["42", "255", "255", "z", "7", "0x"]
    assert decode_vector("1" * 128) == ("int", "340282366920938463463374607431768211455", "340282366920938463463374607431768211455", "f" * 32)
    assert decode_vector("1" * 129)[:2] == ("text", "1" * 129)
    assert decode_vector("")[:2] == ("int", "0")
    assert [float_display(x) for x in (1.0, 1e20, 0.1, float("inf"), float("nan"), -0.0)] == ["1", "100000000000000000000", "0.1", "inf", "NaN", "-0"]
    assert 10 in Window(10, 100) and 100 in Window(10, 100) and 9 not in Window(10, 100) and 101 not in Window(10, 100) and 5 in Window()
    lines = ["$scope module gen[0] $end\n", "$scope module a.b $end\n", "  $scope module 0x $end junk\n", "$scope module \\k $end\n", "$var x\n"]
    assert sanitize_scopes("".join(lines)) == "$scope module \\gen[0] $end\n$scope module a.b $end\n  $scope module \\0x $end\n$scope module \\k $end\n$var x\n"


def test_errors(tmp_path):
    path = tmp_path / "bad.vcd"
    path.write_text("$scope module t $end\n")
    with pytest.raises(MissingEndDefinitions):
        read_header(str(path))
    path.write_text("$var wire 1 ! dup $end\n$var wire 1 # dup $end\n$enddefinitions $end\n")
    with pytest.raises(DuplicateSignal):
        read_header(str(path))
    for body in (b"#x", b"1", b"b01", b"rzz !", b"#5\n#4\n", b"#99999999999999999999", b"q!"):
        with pytest.raises(ParseError):
            list(tokens(body, 0, 0))
    assert list(tokens(b"$comment\n#9 1! $end\n1!", 0, 0))[0][:3] == (20, 0, "!")
    with pytest.raises(ParseError):
        parse_header("$upscope $end")


def test_empty_body_and_signal_files(spark, tmp_path):
    path = tmp_path / "empty.vcd"
    path.write_text("$var wire 1 ! a $end\n$enddefinitions $end\n")
    assert api.metadata(str(path)) == {"signal_count": 1, "timescale": None, "start_time": 0, "end_time": 0}
    assert api.toggles(str(path), ["a"]) == {"a": 0}
    names = tmp_path / "names.txt"
    names.write_text("# c\nsignal_one\n\n   \nsignal_two # inline\n# c\nsignal_three\n")
    assert load_signal_list(str(names)) == ["signal_one", "signal_two", "signal_three"]


def test_many_signals(spark, tmp_path):
    path = tmp_path / "big.vcd"
    with open(path, "w") as f:
        f.write("$timescale 1 ps $end\n$scope module chip_wrapper $end\n$var wire 1 ! TRSTN $end\n$scope module U_CHIP $end\n$var wire 1 ! TRSTN $end\n")
        f.writelines(f"$var wire 32 s{i} sig{i} [31:0] $end\n" for i in range(100_001))
        f.write("$upscope $end\n$upscope $end\n$enddefinitions $end\n#0\n0!\n")
        f.writelines(f"#{t}\nb{t:b} s{t}\n{t % 2}!\n" for t in range(1, 1001))
    meta = api.metadata(str(path))
    assert (meta["signal_count"], meta["start_time"], meta["end_time"], meta["timescale"]) == (100_003, 0, 1000, "1 ps")
    assert api.toggles(str(path), ["chip_wrapper.TRSTN", "chip_wrapper.U_CHIP.TRSTN"]) == {"chip_wrapper.TRSTN": 1000, "chip_wrapper.U_CHIP.TRSTN": 1000}
    assert api.extract(str(path), ["chip_wrapper.U_CHIP.sig9[31:0]"], layout="aligned") == [{"time": 9, "chip_wrapper.U_CHIP.sig9[31:0]": "0x00000009"}]


def test_command_line(files, capsys):
    def out(*args):
        assert cli.main(list(args)) == 0
        return capsys.readouterr().out

    assert out("list", files["A"], "--filter", "clk") == "tb.clk\ntb.u.clk_i\n"
    assert out("--pretty", "meta", files["A"]) == "Field      | Value\n-----------+------\nsignals    | 5    \ntimescale  | 1 ns \nstart_time | 0    \nend_time   | 20   \n"
    assert out("extract", files["A"], "--signal", "tb.clk, tb.temp", "--start", "6") == "time\ttb.clk\ttb.temp\n10\t0\t\n15\t1\t1\n"
    assert out("toggle", files["A"], "--signal", "tb.clk", "--signal", "tb.temp", "--pretty").splitlines()[2:] == ["tb.clk  | 3      ", "tb.temp | 1      "]
    assert out("find", files["A"], "--signal", "tb.cnt[7:0]", "--value", "255", "--occurence", "1") == "time\ttb.cnt[7:0]\n15\t0xff\n"
    assert out("compare", files["A"], files["B"], "--output", "compact") == "❌ FAIL: 1/4 signals have mismatches (1 total)\n"
    assert out("compare", files["A"], files["A"], "--output", "compact") == "✅ PASS: All 5 signals match\n"
    found = json.loads(out("compare", files["A"], files["B"], "--output", "json"))
    assert (found["common_signal_count"], found["mismatches_by_signal"]) == (4, {"tb.clk": 1})
    report = out("compare", files["A"], files["C"], "--output", "other")
    assert "  Time #0: Ref='0' | Actual='z' (one or both unknown)\n" in report and "Matched signals: 3 / 5" in report
    assert "equivalent" in out("compare", files["A"], files["A"])
    for bad in (["extract", files["A"]], ["find", files["A"], "--signal", "a,b", "--value", "1"], ["find", files["A"], "--signal", "tb.clk", "--value", "7"], ["meta", "/nope"]):
        assert cli.main(bad) == 1


def test_reports(files):
    result = api.compare(files["A"], files["C"])
    same = api.compare(files["A"], files["A"])
    assert render.compare_summary(same) == "✅ PASS - All 5 common signals match"
    assert render.compare_summary(result) == "❌ FAIL - 2/5 signals have mismatches (3 total mismatches)"
    lines = render.compare_report(result).split("\n")
    assert lines[:8] == [render.RULE, "VCD Comparison Results", render.RULE, "", f"Reference: {files['A']}", f"Actual:    {files['C']}", "", "Common signals: 5"]
    assert lines[-6:] == ["❌ FAILURES FOUND", "", "Total mismatches: 3", "Signals with mismatches: 2 / 5", "", ""]
    many = [{"signal": "b", "time": t, "value1": "0", "value2": "1", "is_unknown": False} for t in range(13)]
    many += [{"signal": "a", "time": 5, "value1": "x", "value2": "1", "is_unknown": True}]
    report = render.compare_report(result | {"mismatches": many, "signals_only_in_file1": ["p"], "total_mismatches": 14})
    assert report.index("Signal: a") < report.index("Signal: b")
    assert report.count("❌ MISMATCH\n") == render.SHOWN and "  ... and 3 more\n  ❌ 13 mismatches\n\n" in report
    assert "Signals only in reference:\n  - p\n\nCommon signals" in report and "Signals only in actual" not in report
    assert render.compare_report(same | {"common_signals": []}).endswith("Common signals: 0\n\n⚠️  No common signals to compare!\n")


def test_command_line_options(files, capsys):
    with pytest.raises(SystemExit) as left:
        cli.main(["--version"])
    assert left.value.code == 0 and capsys.readouterr().out == f"tracelake {VERSION}\n"
    with pytest.raises(SystemExit):
        cli.main(["--log-level", "loud", "list", files["A"]])
    assert cli.main(["--log-level", "trace", "list", files["A"]]) == 0
    assert cli.main(["trace", files["TRACE"], "--log-level", "loud", "--output", "/nowhere/x"]) == 1
    assert cli.main(["compare", files["A"], files["A"], "--output", "summary"]) == 0
    assert "PASS - All 5 common" in capsys.readouterr().out


def test_repeated_names_in_tables(spark, files):
    rec = read_vcd(spark, files["A"])
    twice = rec.signals.unionByName(rec.signals.where("name = 'tb.clk'"))
    with pytest.raises(DuplicateSignal, match="tb.clk"):
        select.recording(twice, rec.changes)
    with pytest.raises(DuplicateSignal, match="tb.clk"):
        select.resolve(twice, ["tb.temp", "tb.clk"])
    assert select.recording(rec.signals, rec.changes).signals is rec.signals


def test_wide_values_as_columns(spark):
    from pyspark.sql import functions as F

    from tracelake.functions import decode_bits, parse_target_column
    from tracelake.functions.values import low64_hex

    rng = random.Random(0)
    bits = ["", "0", "1", "1" * 64, "1" + "0" * 64, "1" * 128, "1" * 129, "0" * 129, "1x" * 40, "Z", "1" + "0" * 127, "0" * 70 + "1"]
    bits += ["".join(rng.choices("01", k=rng.randint(1, 128))) for _ in range(60)]
    rows = spark.createDataFrame([(b,) for b in bits], "b string").select("b", *decode_bits(F.col("b"))).collect()
    assert [tuple(r)[1:] for r in rows] == [decode_vector(b) for b in bits]
    literals = ["0x" + "f" * 32, "0x1" + "0" * 32, "0x" + "0" * 40 + "ff", str(2**128 - 1), str(2**128), "+" + "0" * 50 + str(2**100), "0x+1F", " 0xAbC\t", "0x", "x", " Z ", "00", str(2**64), "12a"]
    literals += [hex(rng.getrandbits(rng.randint(1, 128))) for _ in range(40)]
    found = spark.createDataFrame([(x,) for x in literals], "x string").select(parse_target_column(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in found] == [parse_target(x) for x in literals]
    texts = ["18446744073709551615", "18446744073709551616", "9999999999999999999", "+007", "0xFFFFFFFFFFFFFFFF", "x"]
    low = spark.createDataFrame([(x,) for x in texts], "x string").select(low64_hex(F.lit("text"), F.col("x"), F.lit(None).cast("string")).alias("h"))
    assert [r["h"] for r in low.collect()] == ["f" * 16, None, "8ac7230489e7ffff", "7", "f" * 16, None]


def test_a_cluster_must_name_its_shared_folder(spark, tmp_path):
    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        def __init__(self, named):
            self.sparkContext, self.conf = Context(), {"spark.checkpoint.dir": named} if named else {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(None))
    assert session.shared_dir(Session("hdfs://there")) == "hdfs://there"
    kept = session.stored(spark.range(5), "five")
    assert kept.count() == 5 and all("tracelake-five" in f for f in kept.inputFiles())
