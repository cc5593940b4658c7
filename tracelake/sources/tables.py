"""Ordinary tables viewed as recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.model import SIGNALS, Recording


def value_columns(number: Column, unknown: Column) -> list[Column]:
    """kind, disp, norm, hex and bits64 of a small integer, or of x."""
    text = F.when(unknown, F.lit("x")).otherwise(number.cast("string"))
    return [
        F.when(unknown, "text").otherwise("int").alias("kind"),
        text.alias("disp"),
        text.alias("norm"),
        F.when(~unknown, F.lower(F.hex(number.cast("long")))).alias("hex"),
        F.lit(None).cast("long").alias("bits64"),
    ]


def event_signals(spark: SparkSession, users: int = 20) -> DataFrame:
    """Two names, tb.uN and tb.alias.uN, for each identifier code uN."""
    n = F.col("id") % users
    plain = F.col("id") < users
    return spark.range(2 * users).select(
        F.col("id").alias("ord"),
        F.concat(F.when(plain, "tb.u").otherwise("tb.alias.u"), n.cast("string")).alias("name"),
        F.concat(F.lit("u"), n.cast("string")).alias("id_code"),
        F.lit(4).alias("size"),
        F.lit("wire").alias("var_type"),
        F.when(plain, F.array(F.lit("tb"))).otherwise(F.array(F.lit("tb"), F.lit("alias"))).alias("scope"),
    )


def event_recording(spark: SparkSession, sf_dir: str, tick_us: int = 3_600_000_000, users: int = 20) -> Recording:
    """``events`` as 4-bit signals, one per user modulo ``users``; an error
    event is an unknown value. A tick is an hour by default."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    changes = ev.select(
        F.col("event_id").alias("seq"),
        F.floor(micros / F.lit(tick_us)).cast("long").alias("time"),
        F.concat(F.lit("u"), (F.col("user_id") % users).cast("string")).alias("id_code"),
        *value_columns(F.floor("value").cast("long") % 16, F.col("event_type") == "error"),
    )
    return Recording(event_signals(spark, users), changes, (1, "s"))


def event_kinds(spark: SparkSession, sf_dir: str) -> Recording:
    """``events`` as five signals, by user: a scalar (0, 1, x or z), an integer
    vector, a vector with an unknown digit, a real, and a string."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, n = F.col("user_id") % 5, F.floor(F.col("value") * 100).cast("long")
    text = n.cast("string")
    disp = (
        F.when(user == 0, F.substring(F.lit("01xz"), (n % 4 + 1).cast("int"), F.lit(1)))
        .when(user == 1, text)
        .when(user == 2, F.concat(F.bin(n), F.lit("x")))
        .when(user == 3, F.concat(text, F.lit(".25")))
        .otherwise(F.concat(F.lit("S_"), "event_type", F.lit("#1")))
    )
    changes = ev.select(
        F.col("event_id").alias("seq"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long").alias("time"),
        F.concat(F.lit("k"), user.cast("string")).alias("id_code"),
        F.when(user == 1, "int").when(user == 3, "real").otherwise("text").alias("kind"),
        disp.alias("disp"),
        F.lower(disp).alias("norm"),
        F.when(user == 1, F.lower(F.hex(n))).alias("hex"),
        F.lit(None).cast("long").alias("bits64"),
    )
    kinds = [("wire", 1), ("reg", 32), ("reg", 33), ("real", 64), ("string", 1)]
    signals = spark.createDataFrame([(i, f"tb.k{i}", f"k{i}", size, kind, ["tb"]) for i, (kind, size) in enumerate(kinds)], SIGNALS)
    return Recording(signals, changes, (1, "s"))


def perturbed(rec: Recording) -> Recording:
    """A second recording to compare with: some changes lost, some z, one name
    lost and one added."""
    z = F.col("seq") % 97 == 0
    changes = rec.changes.where(F.col("seq") % 101 != 0).withColumns(
        {
            "kind": F.when(z, "text").otherwise(F.col("kind")),
            "disp": F.when(z, "z").otherwise(F.col("disp")),
            "norm": F.when(z, "z").otherwise(F.col("norm")),
            "hex": F.when(~z, F.col("hex")),
        }
    )
    renamed = F.when(F.col("name") == "tb.u7", "tb.extra").otherwise(F.col("name"))
    return Recording(rec.signals.withColumn("name", renamed), changes, rec.timescale)


#: Roles of a trace in the order in which users of ``events`` take them.
ROLES = ["clk", "rst_n", "inst_retired", "instruction", "pc", "rf_we_qual", "rf_we_lsu", "rd_addr", "rd_wdata", "rd_wdata_lsu"]
SCALARS = ["clk", "rst_n", "inst_retired", "rf_we_qual", "rf_we_lsu"]


def event_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as events (time, seq, role, kind, disp, hex) of a core: the
    role by user, minute ticks, scalars 0 and 1, vectors of 12 bits, unknown
    bits on errors."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("user_id") % 10).cast("int"))
    whole = F.floor(F.col("value") * 100).cast("long")
    error = F.col("event_type") == "error"
    df = ev.select(
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(600_000_000)).cast("long").alias("time"),
        F.col("event_id").alias("seq"),
        role.alias("role"),
        whole.alias("n"),
        error.alias("e"),
    )
    scalar = F.col("role").isin(SCALARS)
    number = F.when(scalar, F.col("n") % 2).otherwise(F.col("n") % 4096)
    unknown = F.when(scalar, F.lit("x")).otherwise(F.lit("1x0"))
    return df.select(
        "time",
        "seq",
        "role",
        F.when(F.col("e") | scalar, "text").otherwise("int").alias("kind"),
        F.when(F.col("e"), unknown).otherwise(number.cast("string")).alias("disp"),
        F.when(~F.col("e") & ~scalar, F.lower(F.hex(number))).alias("hex"),
    )
