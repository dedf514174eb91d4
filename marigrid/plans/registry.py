"""Named queries over the star-schema test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def daily(self) -> DataFrame:
        """Multi-year daily series: (time, value, status, priority, x, y) of orders on a grid of nations."""
        at = self.customer.select("c_custkey", (F.col("c_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("c_nationkey") / 5).cast("double").alias("y"))
        rows = self.orders.select("o_custkey", F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
        return rows.join(at, F.col("o_custkey") == F.col("c_custkey")).select("time", "value", "status", "priority", "x", "y")

    def hourly(self, kind: str, name: str) -> DataFrame:
        """(stn, time, name): hourly means of one kind of event at ten stations."""
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return self.events.filter(F.col("event_type") == kind).groupBy((F.col("user_id") % 10).alias("stn"), hour.alias("time")).agg(F.avg("value").alias(name))

    @property
    def stations(self) -> DataFrame:
        """(stn, lon, lat) of suppliers, none on a cell's edge."""
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("stn"), ((k * 37) % 500 / 100 - 0.4987).alias("lon"), ((k * 53) % 500 / 100 - 0.4987).alias("lat"), F.col("s_acctbal").alias("value"))

    @property
    def grid(self) -> DataFrame:
        return self.nation.select((F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))


#: Common table expressions that mirror ``Tables``.
CTE = {
    "daily": "daily AS (SELECT o_orderdate AS time, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority, CAST(c_nationkey % 5 AS DOUBLE) AS x, CAST(floor(c_nationkey / 5) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey)",
    "view": "view_h AS (SELECT user_id % 10 AS stn, date_trunc('hour', ts) AS time, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)",
    "click": "click_h AS (SELECT user_id % 10 AS stn, date_trunc('hour', ts) AS time, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL)",
    "error": "error_h AS (SELECT user_id % 10 AS stn, date_trunc('hour', ts) AS time, avg(value) AS v FROM events WHERE event_type = 'error' GROUP BY ALL)",
    "stations": "stations AS (SELECT s_suppkey AS stn, (s_suppkey * 37) % 500 / 100 - 0.4987 AS lon, (s_suppkey * 53) % 500 / 100 - 0.4987 AS lat, s_acctbal AS value FROM supplier)",
    "grid": "grid AS (SELECT CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) AS DOUBLE) AS y FROM nation)",
}


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers a function of ``Tables`` as a query; ``sql`` may use the named common table expressions."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            text = sql.strip()
            if ctes:
                head = ",\n".join(CTE[c] for c in ctes)
                text = f"WITH {head},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {head}\n{text}"
            SQL[name] = text
        return f

    return register


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Columns to some places, as both engines differ in the last digits of sums."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
