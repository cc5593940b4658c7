"""Recordings of the fixtures, and a direct interpreter of their queries."""

HEAD = """$timescale 1 ns $end
$scope module tb $end
$var wire 1 ! clk $end
$var wire 1 " rst_n $end
$var reg 8 # cnt [7:0] $end
$var real 64 $ temp $end
$scope module u $end
{u}
$upscope $end
$upscope $end
$enddefinitions $end
"""
BODY = """$dumpvars
0!
x"
bx #
r0.5 $
$end
#0
0"
b0 #
#5
1!
b101 #
#10
0!
1"
1"
b1x0 #
#15
1!
b11111111 #
r1.0 $
#20
"""
A = HEAD.format(u="$var wire 1 ! clk_i $end") + BODY
B = HEAD.format(u="$var wire 1 % extra $end") + BODY.replace("#15\n1!\n", "#15\n")
C = A.replace("b0 #", "bz #").replace("b1x0 #", "b100 #").replace("r0.5", "r0.25")
TRACE_NAMES = {
    "clk": "t.clk",
    "rst_n": "t.rst",
    "inst_retired": "t.ret",
    "instruction": "t.ins[31:0]",
    "pc": "t.pc[21:0]",
    "rf_we_qual": "t.wq",
    "rf_we_lsu": "t.wl",
    "rd_addr": "t.ra[4:0]",
    "rd_wdata": "t.wd[31:0]",
    "rd_wdata_lsu": "t.wdl[31:0]",
}
TRACE = (
    "$scope module t $end\n"
    + "".join(f"$var wire 1 {'abcdefghij'[i]} {n[2:].replace('[', ' [')} $end\n" for i, n in enumerate(TRACE_NAMES.values()))
    + "$upscope $end\n$enddefinitions $end\n"
    + "#0\n0a\n1b\n1c\nb10000000000000100010011 d\nb100000000 e\n1f\n0g\nb1 h\nb100 i\n#5\n1a\n#10\n0a\n#15\n1a\nb1x i\n"
)


def rows_of(changes, signals, names, window):
    """Changes (seq, time, id, kind, disp) as (seq, order, name, time, ...)."""
    ids = {s[1]: s[2] for s in signals}
    lo, hi = window
    out = []
    for seq, time, code, kind, disp in changes:
        if kind != "time" and (lo is None or time >= lo) and (hi is None or time <= hi):
            out += [(seq, i, n, time, kind, disp) for i, n in enumerate(names) if ids[n] == code]
    return out


def shown(kind, disp, size):
    return "0x" + format(int(disp), "x").zfill(-(-size // 4)) if kind == "int" and size > 1 else disp


def count_toggles(changes, signals, names, window):
    sizes, last, out = {s[1]: s[3] for s in signals}, {}, dict.fromkeys(names, 0)
    for _, _, n, _, kind, disp in rows_of(changes, signals, names, window):
        v = shown(kind, disp, sizes[n])
        out[n] += last.get(n, "") not in ("", v)
        last[n] = v
    return out


def aligned(changes, signals, names, window):
    sizes, state, out = {s[1]: s[3] for s in signals}, dict.fromkeys(names, ""), {}
    for _, _, n, time, kind, disp in rows_of(changes, signals, names, window):
        state[n] = shown(kind, disp, sizes[n])
        out[time] = [state[m] for m in names]
    return [(t, *v) for t, v in out.items()]


def differences(first, second, names, window, ignore, limit):
    """first, second: (changes, signals)."""

    def at_times(changes, signals, name):
        out = {}
        for _, _, _, time, kind, disp in rows_of(changes, signals, [name], window):
            out[time] = (kind, disp)
        return out

    found = []
    for n in sorted(names):
        a, b = at_times(*first, n), at_times(*second, n)
        x = y = ("text", "x")
        hits = 0
        for t in sorted(a.keys() | b.keys()):
            x, y = a.get(t, x), b.get(t, y)
            vague = any(k == "text" and d.lower() in ("x", "z") for k, d in (x, y))
            if x[1].lower() == y[1].lower() or (ignore and vague):
                continue
            found.append((n, t, x[1], y[1], vague))
            hits += 1
            if limit is not None and hits >= limit:
                break
    return found
