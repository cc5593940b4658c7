"""Command line: list, meta, extract, toggle, find, compare and trace."""

from __future__ import annotations

import argparse
import logging
import sys

from tracelake import api, render
from tracelake.errors import WaveError
from tracelake.model import VERSION
from tracelake.operators.trace import load_paths, trace
from tracelake.session import active
from tracelake.sources.vcd import load_signal_list, read_vcd

LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": logging.DEBUG}


#: Forms of a comparison's report; any other name gives the detailed one.
REPORTS = {"json": render.compare_json, "compact": render.compare_compact, "summary": lambda result: render.compare_summary(result) + "\n"}


def split_names(entries: list[str]) -> list[str]:
    """Names of repeated, comma-separated arguments; blanks don't count."""
    stripped = map(str.strip, ",".join(entries).split(","))
    return [name for name in stripped if name]


def names_of(entries: list[str], path: str | None) -> list[str]:
    """The arguments' names, then a file's; repeats stay."""
    names = split_names(entries)
    names += load_signal_list(path) if path else []
    if not names:
        raise WaveError("no signal given: name some by --signal or --signals-file")
    return names


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--pretty", action="store_true", default=argparse.SUPPRESS, help="aligned tables")
    top = argparse.ArgumentParser(prog="tracelake", description="Waveform analytics", parents=[common])
    top.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    top.add_argument("--log-level", default="info", choices=list(LEVELS))
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text, parents=[common])

    def window(p: argparse.ArgumentParser) -> None:
        p.add_argument("--start", type=int)
        p.add_argument("--end", type=int)

    p = command("list", "declared signals")
    p.add_argument("vcd")
    p.add_argument("--filter")
    p = command("meta", "metadata")
    p.add_argument("vcd")
    for name in ("extract", "toggle"):
        p = command(name, "values over time" if name == "extract" else "transition counts")
        p.add_argument("vcd")
        p.add_argument("--signal", action="append", default=[])
        p.add_argument("--signals-file")
        window(p)
        if name == "extract":
            p.add_argument("--layout", choices=["aligned", "sparse"], default="aligned")
            p.add_argument("--format", choices=["plain", "sized"])
    p = command("find", "n-th change to a value")
    p.add_argument("vcd")
    p.add_argument("--signal", required=True)
    p.add_argument("--value", required=True)
    p.add_argument("--occurrence", "--occurence", type=int, default=1)
    p.add_argument("--format", choices=["plain", "sized"], default="sized")
    window(p)
    p = command("compare", "differences of two files")
    p.add_argument("reference")
    p.add_argument("actual")
    p.add_argument("--max-mismatches", type=int)
    p.add_argument("--signals-only", default="")
    p.add_argument("--ignore-unknown", action="store_true")
    p.add_argument("--output", default="default")
    window(p)
    p = command("trace", "architectural trace")
    p.add_argument("vcd")
    p.add_argument("--output", default="trace.txt")
    p.add_argument("--signal-path")
    p.add_argument("--log-level", default=argparse.SUPPRESS, help="an unknown level counts as info")
    return top


def run(args: argparse.Namespace) -> str:
    pretty = getattr(args, "pretty", False)

    def shown(headers: list[str], rows: list) -> str:
        return render.table(headers, rows) if pretty else render.tsv(headers, rows)

    if args.command == "list":
        names = api.list_signals(args.vcd, args.filter)
        return render.table(["Name"], [[n] for n in names]) if pretty else "".join(f"{n}\n" for n in names)
    if args.command == "meta":
        m = api.metadata(args.vcd)
        rows = [
            ("signals", m["signal_count"]),
            ("timescale", m["timescale"] or "n/a"),
            ("start_time", m["start_time"]),
            ("end_time", m["end_time"]),
        ]
        return render.table(["Field", "Value"], rows) if pretty else "".join(f"{k}\t{v}\n" for k, v in rows)
    if args.command == "extract":
        names = names_of(args.signal, args.signals_file)
        found = api.extract(args.vcd, names, args.start, args.end, args.layout, args.format)
        return shown(["time", *names], [[r["time"], *[r[n] for n in names]] for r in found])
    if args.command == "toggle":
        names = names_of(args.signal, args.signals_file)
        counts = api.toggles(args.vcd, names, args.start, args.end)
        return shown(["signal", "toggles"], [[n, counts.get(n, 0)] for n in names])
    if args.command == "find":
        if len(split_names([args.signal])) != 1:
            raise WaveError("find takes one signal")
        hit = api.find(args.vcd, args.signal, args.value, args.occurrence, args.start, args.end, args.format)
        if not hit["found"]:
            raise WaveError("the value does not occur so often in the window")
        return shown(["time", args.signal], [[hit["time"], hit["value"]]])
    if args.command == "compare":
        options = {k: getattr(args, k) for k in ("max_mismatches", "ignore_unknown", "start", "end")}
        result = api.compare(args.reference, args.actual, signals=split_names([args.signals_only]), **options)
        return REPORTS.get(args.output, render.compare_report)(result)
    rec = read_vcd(active(), args.vcd)
    with open(args.output, "w", encoding="utf-8") as f:
        f.writelines(r["line"] + "\n" for r in trace(rec, load_paths(args.signal_path)).toLocalIterator())
    return ""


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=LEVELS.get(args.log_level, logging.INFO))
    try:
        sys.stdout.write(run(args))
    except (WaveError, OSError) as e:
        sys.stderr.write(f"Error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
