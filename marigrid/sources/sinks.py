"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: K3: rows of a file at most; Parquet's own row groups go by bytes.
ROWS = 5_000_000


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """K1."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_series(df: DataFrame, path: str, keys: Sequence[str], time: str = "time", mode: str = "errorifexists", rows: int = ROWS) -> None:
    """K2, K3: zstd Parquet by year, sorted by cell and time so that statistics prune boxes and times.

    Rows are dealt by year and a hash of the cell; AQE splits years that are large.
    """
    year = df.withColumn("year", F.year(time))
    spread = year.hint("rebalance", "year", *keys).sortWithinPartitions("year", *keys, time)
    spread.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy("year").parquet(path)


def write_lookup(df: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists") -> None:
    """K5, K6: a cache table in order of its keys; lookups are joins."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").parquet(path)


def dense_points(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of points that have a value at any time."""
    some = df.groupBy(*keys).agg(F.max(F.coalesce(*values).isNotNull()).alias("__any")).filter("__any").drop("__any")
    return df.join(some, list(keys), "left_semi")


def described(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """K9: columns with a comment in their metadata."""
    return df.select(*(F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns))


def write_lines(lines: DataFrame, path: str, order: Sequence[str], line: str = "line", mode: str = "errorifexists") -> None:
    """One text file of lines in their order, for files that a program reads whole; of a bounded number of lines."""
    lines.coalesce(1).sortWithinPartitions(*order).select(line).write.mode(mode).text(path)
