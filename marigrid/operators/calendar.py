"""Calendar days, windows' centers and time spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marigrid.params import Window


def template_days(spark: SparkSession) -> DataFrame:
    """the 366 calendar days (month, day, center_day as MMdd) of a leap year."""
    days = spark.sql("SELECT explode(sequence(DATE'1980-01-01', DATE'1980-12-31')) AS d")
    return days.select(F.month("d").alias("month"), F.day("d").alias("day"), F.date_format("d", "MMdd").alias("center_day"))


def centers(spark: SparkSession, window: Window, hour: int = 0) -> DataFrame:
    """(center_day, center) for every calendar day and year; Feb 29 is Mar 1 in other years."""
    years = spark.range(window.first, window.last + 1).select(F.col("id").cast("int").alias("year"))
    at = F.expr(f"coalesce(try_make_timestamp_ntz(year, month, day, {hour}, 0, 0), make_timestamp_ntz(year, 3, 1, {hour}, 0, 0))")
    return template_days(spark).crossJoin(years).select("center_day", at.alias("center"))


def spine(first: Column, last: Column, step: str) -> Column:
    """All instants from ``first`` to ``last`` as rows."""
    return F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}")))
