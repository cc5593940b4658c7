"""Header queries, filters and the resolution of requested names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.errors import DuplicateSignal, MissingSignals
from tracelake.model import Recording, Window

#: Requested names are few: a request this long or shorter is joined as a
#: broadcast, a longer one as Catalyst sees fit.
BROADCAST_TARGETS = 10_000
#: Up to so many names their identifier codes become a literal list.
LITERAL_TARGETS = 1_000

REQUEST = T.StructType([T.StructField("req_ord", T.LongType()), T.StructField("name", T.StringType())])
CODE = T.StructType([T.StructField("id_code", T.StringType()), T.StructField("size", T.IntegerType())])
TARGET = T.StructType([T.StructField("req_ord", T.LongType()), T.StructField("signal", T.StringType()), *CODE.fields])


def list_signals(signals: DataFrame, name_filter: str | None = None) -> DataFrame:
    """Names in order of declaration, those that hold ``name_filter``."""
    kept = signals if name_filter is None else signals.where(F.col("name").contains(name_filter))
    return kept.select("ord", "name").orderBy("ord")


def duplicate_names(signals: DataFrame) -> DataFrame:
    return signals.groupBy("name").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n > 1")


def require_unique(signals: DataFrame) -> None:
    """Every query fails on signals that declare a name twice."""
    found = duplicate_names(signals).orderBy("ord").limit(1).collect()
    if found:
        raise DuplicateSignal(found[0]["name"])


def recording(signals: DataFrame, changes: DataFrame, timescale: tuple[int, str] | None = None) -> Recording:
    """A recording of tables that don't come from a file, whose header would
    have been checked: a name declared twice is an error."""
    require_unique(signals)
    return Recording(signals, changes, timescale)


def flat_names(lines: DataFrame) -> DataFrame:
    """Rows (.., pos, name): the names of comma-separated arguments (column
    ``value``) in order; blanks don't count, repeats stay."""
    parts = F.filter(F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    return lines.select("*", F.posexplode(parts).alias("pos", "name")).drop("value")


def local(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows that the plan itself holds: joining them starts no job."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names), schema)


def requested(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Rows (req_ord, name) of a request, repeats kept."""
    return local(spark, list(enumerate(names)), REQUEST)


def missing_names(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(signals.select("name"), "name", "left_anti").select("req_ord", "name")


@dataclass(frozen=True)
class Targets:
    """A resolved request: rows (req_ord, signal, id_code, size), its distinct
    (id_code, size), and the codes themselves if they are few."""

    rows: DataFrame
    codes: DataFrame
    ids: list[str] | None


def resolve(signals: DataFrame, names: Sequence[str]) -> Targets:
    """The request's signals, or an error that lists every missing name in
    order of the request."""
    spark = signals.sparkSession
    if len(names) <= LITERAL_TARGETS:
        found = signals.where(F.col("name").isin(list(names))).select("name", "id_code", "size").collect()
        known = {r["name"]: (r["id_code"], r["size"]) for r in found}
        if len(known) < len(found):
            names_found = [r["name"] for r in found]
            raise DuplicateSignal(next(n for n in names if names_found.count(n) > 1))
        missing = [n for n in names if n not in known]
        if missing:
            raise MissingSignals(missing)
        rows = local(spark, [(i, n, *known[n]) for i, n in enumerate(names)], TARGET)
        codes = sorted({known[n] for n in names})
        return Targets(F.broadcast(rows), F.broadcast(local(spark, codes, CODE)), sorted({c for c, _ in codes}))
    wanted = requested(spark, names)
    missing = [r["name"] for r in missing_names(signals, wanted).orderBy("req_ord").collect()]
    if missing:
        raise MissingSignals(missing)
    require_unique(signals)
    rows = wanted.join(signals.select("name", "id_code", "size"), "name").withColumnRenamed("name", "signal")
    small = F.broadcast if len(names) <= BROADCAST_TARGETS else lambda df: df
    return Targets(small(rows), small(rows.select("id_code", "size").distinct()), None)


def in_window(changes: DataFrame, window: Window) -> DataFrame:
    """Inclusive ends. Recordings have non-decreasing time, so a plain filter
    equals stopping at the first time mark past the end; it reaches the scan."""
    if window.start is not None:
        changes = changes.where(F.col("time") >= window.start)
    if window.end is not None:
        changes = changes.where(F.col("time") <= window.end)
    return changes


def changes_of(targets: Targets, changes: DataFrame, window: Window) -> DataFrame:
    """Changes in the window of the targets' identifier codes, unjoined. A
    literal list of codes reaches the scan, which a join doesn't."""
    hits = in_window(changes.where(F.col("kind") != "time"), window)
    if targets.ids is not None:
        return hits.where(F.col("id_code").isin(targets.ids))
    return hits.join(targets.codes.select("id_code").distinct(), "id_code", "left_semi")


def events(signals: DataFrame, changes: DataFrame, names: Sequence[str], window: Window) -> DataFrame:
    """The requested signals' changes in the window. Names that share an
    identifier code each get a copy, repeated names too."""
    targets = resolve(signals, names)
    return changes_of(targets, changes, window).join(targets.rows, "id_code")
