"""Every query with SQL gives the rows that DuckDB gives; the others can be collected and keep a property each."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    found = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    expected = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == expected


def known(v):
    return v is not None and not math.isnan(v)


#: What holds of all rows of a query without SQL.
HOLDS = {
    "block_means": lambda rows: all(r.v >= 1 and 0 < r.fxk <= 1 for r in rows) and len(rows) % 1000 == 0,
    "correlation_curves": lambda rows: all(not known(r.b) or (r.b >= 0 and r.c >= 0) for r in rows) and any(known(r.b) for r in rows),
    "disaggregate": lambda rows: len(rows) % 24 == 0 and sum(known(r.ntr) for r in rows) > len(rows) / 2,
    "f_p_value": lambda rows: all(r.p is None or 0 <= r.p <= 1 for r in rows) and any(known(r.p) for r in rows),
    "fit_acf": lambda rows: all(r.scale >= 0.05 and r.shape >= 0.05 and r.mae >= 0 for r in rows),
    "fit_acf_burr": lambda rows: all(r.rmse >= 0 and r.n > 0 and (r.pearson is None or abs(r.pearson) <= 1 + 1e-9) for r in rows),
    "fit_marginals": lambda rows: all(r.value > 0 for r in rows if r.param in ("scale", "record_length")) and all(0 <= r.value <= 1 for r in rows if r.param.endswith("pval")),
    "homogeneity": lambda rows: all(r.sites > 1 and r.v >= 0 and r.mean_v > 0 and r.std_v > 0 and math.isclose(r.h, (r.v - r.mean_v) / r.std_v) for r in rows),
    "hourly_totals": lambda rows: all(math.isclose(r.twl, r.msl + r.tides + r.ntr, abs_tol=1e-6) for r in rows) and len(rows) % 24 == 0,
    "window_fit_acf": lambda rows: all(r.scale >= 0.05 and r.shape >= 0.05 and r.mae >= 0 for r in rows),
    "window_marginals": lambda rows: all(0 < r.value <= 31 * 5 for r in rows if r.param == "record_length") and all(r.value > 0 for r in rows if r.param == "scale"),
}


@pytest.mark.parametrize("name", sorted(n for n in set(driver.queries()) - set(driver.oracle_sql()) if n != "pipeline" and not n.startswith("op")))
def test_runs(spark, name):
    rows = driver.queries()[name](spark, SF).collect()
    assert rows and HOLDS[name](rows)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_pchip_hourly_covers_the_whole_table(spark, duck):
    got = driver.queries()["pchip_hourly"](spark, SF).agg({"time": "max"}).first()[0]
    assert str(got)[:7] == duck.execute("SELECT strftime(max(o_orderdate), '%Y-%m') FROM orders").fetchone()[0]
