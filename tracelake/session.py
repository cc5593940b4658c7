"""Sessions and shared folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def active() -> SparkSession:
    """The active session, or a local one for command-line use."""
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    return (
        SparkSession.builder.appName("tracelake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.
    Where it is installed on the workers, this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where
    none is named, a local session takes a temporary one; on a cluster that is
    an error, since each executor would write to its own disk."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_scratch: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the
    driver ends."""
    if not _scratch:
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/tracelake-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from files in the shared folder, so that what follows may
    read them several times while the source is read once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
