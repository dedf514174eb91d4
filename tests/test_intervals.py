"""merge_intervals on what the test tables lack: nulls, parts of days and many equal rows."""

from collections import Counter
from datetime import datetime as dt

import duckdb
import pytest

import __spark_entry__ as driver

ODD = [
    (1, 2.5, dt(1999, 1, 1)), (1, 1.0, dt(1999, 1, 4)), (1, 1.5, dt(1999, 1, 8)), (1, 1.0, dt(1999, 1, 10)),
    (2, None, dt(1999, 1, 5)), (2, 3.0, dt(1999, 1, 1)), (2, 3.0, None),
    (3, 0.4, dt(1999, 2, 1)), (3, 0.6, dt(1999, 2, 2)),
    (None, 1.0, dt(1999, 1, 1)), (4, 1.0, None),
]


@pytest.mark.parametrize("copies", [1, 50])
def test_merge_intervals(spark, tmp_path, copies):
    spark.createDataFrame(ODD, "l_suppkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    # equal rows in any order have one union only once they are one row
    con.execute(f"CREATE VIEW lineitem AS SELECT DISTINCT l_suppkey, l_quantity, l_shipdate FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = Counter(con.execute(driver.oracle_sql()["merge_intervals"]).fetchall())
    if copies > 1:
        rows = [r for r in ODD if r[1] and r[2]] * copies
        spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_shipdate timestamp_ntz").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        expected = Counter({r: n for r, n in expected.items() if r[2]})
    assert Counter(map(tuple, driver.queries()["merge_intervals"](spark, str(tmp_path)).collect())) == expected
