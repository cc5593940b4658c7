"""Architectural trace of a RISC-V core, sampled at rising clock edges."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.values import low64_hex, padded, trace_data, truth
from tracelake.model import Recording, Window
from tracelake.operators.select import events
from tracelake.operators.timeline import carry_forward
from tracelake.session import stored

# The roles of a trace and the signals they have by default.
CPU = "tb.U_CHIP.U_TOP_VCORE.U_TOP_CORE.U_TOP_CPU"
DEFAULT_PATHS = {
    "clk": f"{CPU}.clk_cpu",
    "rst_n": f"{CPU}.U_CPU.rst_cpu_n",
    "inst_retired": f"{CPU}.U_CPU.inst_retired",
    "instruction": f"{CPU}.U_CPU.instruction_r[31:0]",
    "pc": f"{CPU}.U_CPU.pc_exe_r[21:0]",
    "rf_we_qual": f"{CPU}.U_CPU.U_RF.rf_write_enable_qual",
    "rf_we_lsu": f"{CPU}.U_CPU.U_RF.rf_write_enable_lsu",
    "rd_addr": f"{CPU}.U_CPU.U_RF.rd_addr[4:0]",
    "rd_wdata": f"{CPU}.U_CPU.U_RF.rd_wdata[31:0]",
    "rd_wdata_lsu": f"{CPU}.U_CPU.U_RF.rd_wdata_lsu[31:0]",
}
STATE = [r for r in DEFAULT_PATHS if r != "clk"]


def load_paths(source: str | dict | None = None) -> dict[str, str]:
    """The default signals, overridden by the non-null entries of a JSON
    object, given itself or by the path of its file."""
    given = source or {}
    if isinstance(given, str):
        with open(given, encoding="utf-8") as f:
            given = json.load(f)
    return DEFAULT_PATHS | {k: given[k] for k in DEFAULT_PATHS if given.get(k) is not None}


def groups(role_events: DataFrame) -> DataFrame:
    """A row per time from events (time, seq, role, kind, disp, hex): for each
    role the last value at that time, and whether any clock event there is a
    one. All columns are aggregates, combined before the shuffle."""
    value = F.struct("kind", "disp", "hex")

    def last(role: str) -> Column:
        hit = F.col("role") == role
        return F.max_by(F.when(hit, value), F.when(hit, F.col("seq"))).alias(role)

    one = F.max(F.when(F.col("role") == "clk", F.coalesce(truth(F.col("kind"), F.col("disp")), F.lit(False)))).alias("_one")
    return role_events.groupBy("time").agg(*[last(r) for r in DEFAULT_PATHS], one)


def samples(grouped: DataFrame) -> DataFrame:
    """Rows (time, sample, roles..) at which the core is observed: every rising
    edge but the first, with the state before it; then, if there was any edge,
    the final state. An edge needs a clock of exactly 0 before the group."""
    roles = list(DEFAULT_PATHS)
    grouped = stored(grouped, "groups")
    before = carry_forward(grouped, [], "time", roles, include_current=False, kept=True)
    rising = F.coalesce(~truth(F.col("clk.kind"), F.col("clk.disp")), F.lit(False)) & F.coalesce("_one", F.lit(False))
    edges = before.where(rising).select("time", *STATE)
    first = edges.agg(F.min("time").alias("_armed"))
    after = edges.join(F.broadcast(first), F.col("time") > F.col("_armed")).select("time", F.lit(0).alias("sample"), *STATE)
    final = grouped.agg(
        F.max("time").alias("time"),
        *[F.max_by(r, F.when(F.col(r).isNotNull(), F.col("time"))).alias(r) for r in STATE],
    )
    armed = final.join(first.where("_armed is not null"), F.lit(True)).select("time", F.lit(1).alias("sample"), *STATE)
    return after.unionByName(armed)


def render(observed: DataFrame) -> DataFrame:
    """Rows (time, sample, pos, line) of the trace text."""

    def on(role: str) -> Column:
        return F.coalesce(truth(F.col(role)["kind"], F.col(role)["disp"]), F.lit(False))

    def low(role: str) -> Column:
        return low64_hex(F.col(role)["kind"], F.col(role)["disp"], F.col(role)["hex"])

    def write(role: str) -> Column:
        data = trace_data(F.col(role)["kind"], F.col(role)["disp"], F.col(role)["hex"])
        number = F.conv(low("rd_addr"), 16, 10)
        return F.concat(F.lit("x"), padded(number, 2), F.lit(" <= "), data)

    pc = F.concat(F.lit("PC : 0x"), padded(low("pc"), 8), F.lit(" I : 0x"), padded(low("instruction"), 8), F.lit(" "))
    lines = F.array(
        F.when(on("inst_retired"), pc),
        F.when(on("rf_we_qual"), write("rd_wdata")).when(on("rf_we_lsu"), write("rd_wdata_lsu")),
    )
    text = F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("pos", "line")
    return observed.where(on("rst_n")).select("time", "sample", text)


def trace(rec: Recording, paths: dict[str, str] | None = None) -> DataFrame:
    """The trace of a recording in order."""
    paths = paths or DEFAULT_PATHS
    found = events(rec.signals, rec.changes, list(dict.fromkeys(paths.values())), Window())
    roles = F.explode(F.array(*[F.when(F.col("signal") == s, F.lit(r)) for r, s in paths.items()])).alias("role")
    role_events = found.select("time", "seq", "kind", "disp", "hex", roles).where("role is not null")
    return render(samples(groups(role_events))).orderBy("time", "sample", "pos")
