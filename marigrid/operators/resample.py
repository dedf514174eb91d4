"""Coarser and finer time steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marigrid.operators.calendar import spine
from marigrid.operators.windows import with_row_index

#: Rows of a block of a series laid end to end.
BLOCK = 1 << 16


def to_step(df: DataFrame, keys: Sequence[str], values: Sequence[str], step: str = "day", time: str = "time", shift: str | None = None) -> DataFrame:
    """A1, A2, A3: means by day or month; steps where a value is missing altogether go. ``shift`` moves the stamps."""
    at = F.date_trunc(step, F.col(time)).cast("timestamp_ntz")
    if shift:
        at = at + F.expr(f"INTERVAL {shift}")
    return df.groupBy(*keys, at.alias("time")).agg(*(F.avg(v).alias(v) for v in values)).dropna(subset=list(values))


def fill_gaps(df: DataFrame, keys: Sequence[str], step: str = "1 HOUR", time: str = "time") -> DataFrame:
    """Every instant from a series' first to its last, with nulls where there was no row."""
    whole = df.groupBy(*keys).agg(F.min(time).alias("__a"), F.max(time).alias("__b")).select(*keys, spine(F.col("__a"), F.col("__b"), step).alias(time))
    return whole.join(df, [*keys, time], "left")


def interpolate_linear(df: DataFrame, keys: Sequence[str], value: str, step: str = "1 HOUR", time: str = "time") -> DataFrame:
    """Values at every step between the known ones, on straight lines."""
    full = fill_gaps(df.select(*keys, time, value).withColumn("__known", F.col(time)), keys, step, time)
    w = Window.partitionBy(*keys).orderBy(time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    t0, v0 = F.last("__known", True).over(before), F.last(value, True).over(before)
    t1, v1 = F.first("__known", True).over(after), F.first(value, True).over(after)
    line = v0 + (v1 - v0) * (seconds(F.col(time)) - seconds(t0)) / (seconds(t1) - seconds(t0))
    return full.select(*keys, time, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(line).alias(value))


def low_and_high(df: DataFrame, keys: Sequence[str], value: str, rows: int, time: str = "time", by_group: bool = True) -> DataFrame:
    """``low``, the trailing mean of ``rows`` rows, and ``high``, the rest; each series starts anew.

    The stored rule rolls over the series laid end to end in order of keys and time. Without ``by_group`` it does so:
    rows are numbered in that order by counts of the first key, blocks of ``BLOCK`` numbers roll side by side, and the
    last rows of a block go to the next one too, so that no task has the whole order.
    """

    def split(rows_of: DataFrame, w: WindowSpec) -> DataFrame:
        low = F.when(F.count(value).over(w) == rows, F.avg(value).over(w))
        return rows_of.withColumn("low", low).withColumn("high", F.col(value) - F.col("low"))

    if by_group:
        return split(df, Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - rows, 0))
    size = max(BLOCK, rows)
    numbered = with_row_index(df, keys[0], [*keys[1:], time], "__at").withColumn("__own", F.floor(F.col("__at") / size))
    both = F.when(F.col("__at") % size > size - rows, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))
    haloed = split(numbered.withColumn("__block", F.explode(both)), Window.partitionBy("__block").orderBy("__at").rowsBetween(1 - rows, 0))
    return haloed.filter("__block = __own").drop("__at", "__own", "__block")
