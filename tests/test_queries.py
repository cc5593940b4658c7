from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.harness import same
from tracelake.functions import hex_with_x
from tracelake.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_hex_with_x_of_other_widths_equals_its_sql(spark, tmp_path):
    """Values of 1 to 64 binary digits, below zero and null."""
    values = [0.0, 0.01, 327.67, 655.35, 655.36, 655.37, 1310.72, 123456.78, 4.5e9, 1e16, -0.01, -655.36, None]
    rows = [(i, v, e) for i, (v, e) in enumerate((v, e) for v in values for e in ("click", "error", None))]
    for table in Path("/root/testdata/sf0.001").iterdir():
        if table.name != "events.parquet":
            (tmp_path / table.name).symlink_to(table)
    seq, value, kind = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": seq, "value": value, "event_type": kind}), tmp_path / "events.parquet")
    same(QUERIES["hex_with_x"](spark, str(tmp_path)), ORACLES["hex_with_x"], str(tmp_path))


def test_hex_with_x_itself_keeps_all_digits(spark):
    bits = spark.createDataFrame([("1" + "0" * 16,), ("1x" + "0" * 15,), ("1" * 33,), ("10",)], "b string")
    assert [r[0] for r in bits.select(hex_with_x(F.col("b"), 16)).collect()] == ["0x10000", "0x1X000", "0x1FFFFFFFF", "0x0002"]
