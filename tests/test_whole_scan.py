"""The scan of the store counts every row and adds up every finite value."""

from decimal import Decimal

import __spark_entry__ as entry
from conftest import READING, ts


def test_scan_leaves_nothing_out(spark, tmp_path):
    t = ts("2024-01-01")
    rows = [(i, t, t, "btc", "m", v, "s", "final", 0, "") for i, v in enumerate([5e12, 0.5, float("nan"), None, float("inf")])]
    spark.createDataFrame(rows, READING).write.parquet(str(tmp_path / "onchain.parquet"))
    (r,) = entry.queries()["SRC01_scan"](spark, str(tmp_path)).collect()
    assert (r.n, r.n_usable, r.total) == (5, 2, Decimal("5000000000000.5"))
