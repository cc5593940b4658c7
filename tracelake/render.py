"""Text output of ordered, collected rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

# The wording of the reports below, which scripts read.
RULE = "=" * 42
#: Mismatches that the detailed report shows for a signal; the count is whole.
SHOWN = 10


def tsv(headers: Sequence[str], rows: Iterable[Sequence]) -> str:
    return "".join("\t".join(map(str, r)) + "\n" for r in [headers, *rows])


def table(headers: Sequence[str], rows: Sequence[Sequence]) -> str:
    cells = [[str(c) for c in r] for r in rows]
    widths = [max(map(len, column)) for column in zip(headers, *cells, strict=True)] if headers else []
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) for r in [list(headers), *cells]]
    lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join(lines) + "\n"


def by_signal(result: dict) -> dict[str, list[dict]]:
    """Mismatches of each signal, in one pass."""
    out: dict[str, list[dict]] = {}
    for m in result["mismatches"]:
        out.setdefault(m["signal"], []).append(m)
    return out


def compare_json(result: dict) -> str:
    kept = {k: v for k, v in result.items() if k not in ("mismatches", "common_signals")}
    counts = {s: len(own) for s, own in by_signal(result).items()}
    kept |= {"common_signal_count": len(result["common_signals"]), "mismatches_by_signal": counts}
    return json.dumps(kept, indent=2) + "\n"


def compare_compact(result: dict) -> str:
    n = len(result["common_signals"])
    if result["passed"]:
        return f"✅ PASS: All {n} signals match\n"
    bad, total = result["signals_with_mismatches"], result["total_mismatches"]
    return f"❌ FAIL: {bad}/{n} signals have mismatches ({total} total)\n"


def compare_summary(result: dict) -> str:
    """The verdict in a sentence."""
    n = len(result["common_signals"])
    if result["passed"]:
        return f"✅ PASS - All {n} common signals match"
    return f"❌ FAIL - {result['signals_with_mismatches']}/{n} signals have mismatches ({result['total_mismatches']} total mismatches)"


def section(title: str, *lines: str) -> str:
    return "\n".join([RULE, title, RULE, "", *lines]) + "\n"


def listed(result: dict, key: str, side: str) -> str:
    names = result[key]
    return "\n".join([f"Signals only in {side}:", *(f"  - {s}" for s in names), "", ""]) if names else ""


def signal_part(signal: str, own: list[dict]) -> str:
    shown = [
        f"  Time #{m['time']}: Ref='{m['value1']}' | Actual='{m['value2']}' {'(one or both unknown)' if m['is_unknown'] else '❌ MISMATCH'}"
        for m in own[:SHOWN]
    ]
    more = [f"  ... and {len(own) - SHOWN} more"] if len(own) > SHOWN else []
    return "\n".join([f"Signal: {signal}", *shown, *more, f"  ❌ {len(own)} mismatches", "", ""])


def compare_report(result: dict) -> str:
    n, found = len(result["common_signals"]), by_signal(result)
    head = section("VCD Comparison Results", f"Reference: {result['file1']}", f"Actual:    {result['file2']}", "")
    head += listed(result, "signals_only_in_file1", "reference") + listed(result, "signals_only_in_file2", "actual")
    head += f"Common signals: {n}\n\n"
    if not n:
        return head + "⚠️  No common signals to compare!\n"
    if not found:
        verdict = ("✅ SUCCESS: All signal values match!", "", "The two VCD files are equivalent.")
        return head + section("Signal Value Comparison", f"All common signals match ({n} total).", "") + section("Summary", *verdict, "")
    values = section("Signal Value Comparison") + "".join(signal_part(s, found[s]) for s in sorted(found))
    values += f"Matched signals: {n - len(found)} / {n}\n\n"
    totals = (f"Total mismatches: {result['total_mismatches']}", f"Signals with mismatches: {len(found)} / {n}")
    return head + values + section("Summary", "❌ FAILURES FOUND", "", *totals, "")
