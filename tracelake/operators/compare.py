"""Comparison of two recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import is_unknown, values_match
from tracelake.model import Comparison, Recording, Window
from tracelake.operators.select import in_window
from tracelake.operators.timeline import carry_forward

VALUE = "struct<kind:string,disp:string,norm:string,bits64:bigint>"


def signal_sets(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names in both, only in the first, only in the second. Names alone
    decide; size and type don't."""
    common = first.select("name").join(second.select("name"), "name", "left_semi").orderBy("name")
    only = [a.join(b.select("name"), "name", "left_anti").select("ord", "name").orderBy("ord") for a, b in ((first, second), (second, first))]
    return common, only[0], only[1]


def timeline(rec: Recording, common: DataFrame, window: Window, side: str) -> DataFrame:
    """The last value of each compared signal at each time it changed."""
    names = rec.signals.join(common, "name", "left_semi").select(F.col("name").alias("signal"), "id_code")
    hits = in_window(rec.changes.where(F.col("kind") != "time"), window)
    last = hits.groupBy("id_code", "time").agg(F.max_by(F.struct("kind", "disp", "norm", "bits64"), "seq").alias(side))
    return last.join(names, "id_code").select("signal", "time", side)


def mismatches(
    first: Recording,
    second: Recording,
    common: DataFrame,
    window: Window = Window(),
    ignore_unknown: bool = False,
    max_mismatches: int | None = None,
) -> DataFrame:
    """Rows (signal, time, value1, value2, is_unknown) for each time, at which
    either side changed, where the values differ. Both sides are x before
    their first change in the window. A limit holds per signal; 0 acts as 1."""
    a, b = timeline(first, common, window, "a"), timeline(second, common, window, "b")
    both = carry_forward(a.join(b, ["signal", "time"], "full"), ["signal"], "time", ["a", "b"])
    start = F.expr(f"cast(struct('text', 'x', 'x', cast(null as bigint)) as {VALUE})")
    both = both.withColumns({c: F.coalesce(F.col(c), start) for c in ("a", "b")})
    out = both.where(~values_match("a", "b", ignore_unknown)).select(
        "signal",
        "time",
        F.col("a.disp").alias("value1"),
        F.col("b.disp").alias("value2"),
        (is_unknown(F.col("a.kind"), F.col("a.disp")) | is_unknown(F.col("b.kind"), F.col("b.disp"))).alias("is_unknown"),
    )
    if max_mismatches is not None:
        rank = F.row_number().over(W.partitionBy("signal").orderBy("time"))
        out = out.withColumn("_rank", rank).where(F.col("_rank") <= max(max_mismatches, 1)).drop("_rank")
    return out


def summarise(found: DataFrame, common: DataFrame) -> DataFrame:
    """One row of totals, after any limit."""
    totals = found.agg(
        F.count("*").alias("total_mismatches"), F.count_distinct("signal").alias("signals_with_mismatches")
    )
    return totals.join(common.agg(F.count("*").alias("common_signal_count")), F.lit(True)).select(
        "common_signal_count", "total_mismatches", "signals_with_mismatches", (F.col("total_mismatches") == 0).alias("passed")
    )


def by_signal(found: DataFrame) -> DataFrame:
    return found.groupBy("signal").agg(F.count("*").alias("mismatches"))


def compare(
    first: Recording,
    second: Recording,
    signals_only: Sequence[str] = (),
    ignore_unknown: bool = False,
    max_mismatches: int | None = None,
    window: Window = Window(),
) -> Comparison:
    """``signals_only`` restricts what is compared, not the list of common
    signals; names that aren't common are ignored."""
    common, only1, only2 = signal_sets(first.signals, second.signals)
    compared = common.where(F.col("name").isin(list(signals_only))) if signals_only else common
    found = mismatches(first, second, compared, window, ignore_unknown, max_mismatches)
    options = {"signals_only": list(signals_only), "ignore_unknown": ignore_unknown, "max_mismatches": max_mismatches}
    return Comparison(common, only1, only2, found, summarise(found, common), options)


def summary_json(result: Comparison) -> DataFrame:
    """One row with the JSON report: totals, one-sided signals, and a count
    per signal that has mismatches."""
    counts = by_signal(result.mismatches).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "mismatches")))).alias("mismatches_by_signal")
    )
    sides = [
        df.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias(name))
        for df, name in ((result.only_first, "signals_only_in_file1"), (result.only_second, "signals_only_in_file2"))
    ]
    row = result.summary.join(counts, F.lit(True)).join(sides[0], F.lit(True)).join(sides[1], F.lit(True))
    return row.select(F.to_json(F.struct(*[F.col(c) for c in row.columns])).alias("json"))
