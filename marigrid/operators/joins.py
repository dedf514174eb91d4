"""Lookup, nearest, spatial and alignment joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.scalar import bucket, key4, month_day


def left_chain(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """The first frame with the others joined on, all on the same keys (one shuffle each)."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), frames)


def outer_align(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows of any frame."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), frames)


def lookup_by_month_day(df: DataFrame, params: DataFrame, time: str = "time", key: str = "month_day") -> DataFrame:
    """Rows with their calendar day's parameters (366 rows for a cell); days without any go."""
    return df.join(params, month_day(F.col(time)) == F.col(key)).drop(key)


def lookup_by_day_of_year(df: DataFrame, params: DataFrame, keys: Sequence[str] = (), time: str = "time", key: str = "dayofyear") -> DataFrame:
    """By the day's number in its own year, so that dates after February differ in leap years."""
    return df.withColumn(key, F.dayofyear(time)).join(params, [*keys, key])


def lookup_exact(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on floats to four places; a miss gives nulls."""
    right = table.withColumns({f"__k{i}": key4(F.col(k)) for i, k in enumerate(keys)}).drop(*keys)
    left = df.withColumns({f"__l{i}": key4(F.col(k)) for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, (F.col(f"__l{i}") == F.col(f"__k{i}") for i in range(len(keys))))
    return left.join(right, on, "left").drop(*(f"__{c}{i}" for i in range(len(keys)) for c in "kl"))


def lookup_packed(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, scale: float = 1000.0, stored: bool = True) -> DataFrame:
    """``df`` with the ``value`` of the table's row whose three keys are equal once scaled and rounded (ties to even); a miss gives null.

    The stored rule packs the keys into one number, a * 10^9 + b * 10^6 + c, so keys of a thousand steps and more or
    below zero can stand for each other; without ``stored`` all three must be equal. Of rows with equal keys the least
    value counts. Null keys miss.
    """
    a, b, c = (F.bround(F.col(k) * scale, 0).cast("long") for k in keys)
    parts = {"__packed": a * 1_000_000_000 + b * 1_000_000 + c} if stored else {"__a": a, "__b": b, "__c": c}
    right = table.withColumns(parts).groupBy(*parts).agg(F.min(value).alias(value))
    return df.withColumns(parts).join(right, list(parts), "left").drop(*parts)


def nearest(queries: DataFrame, table: DataFrame, keys: Sequence[str], at: str, value: str, carry: Sequence[str] = (), buckets: int = 32) -> DataFrame:
    """Queries with ``nearest``, the closest ``value`` of the table with the same keys; ties go to the lower.

    ``carry`` names columns of the table that come with the value (of rows with one value the greatest), so that nothing
    has to be joined on a float again. Order has two levels: quantiles of each key's values (a sketch) cut them into
    ``buckets``, which sort in tasks of their own, and each bucket's least and greatest values pass on to the buckets
    beside it, also over empty ones. So few keys still use many tasks, and the work doesn't grow with the product of the
    sides. Keys that the table lacks give nulls.
    """
    extra = [c for c in queries.columns if c not in (*keys, at)]
    point = F.struct("__at", *carry)
    points = table.groupBy(*keys, F.col(value).cast("double").alias("__at")).agg(*(F.max(c).alias(c) for c in carry), F.lit(0).alias("__kind")).dropna(subset=["__at"])
    edges = points.groupBy(*keys).agg(F.percentile_approx("__at", [i / buckets for i in range(1, buckets)], 1000).alias("__edges"))
    rows = queries.select(*keys, F.col(at).cast("double").alias("__at"), F.struct(F.col(at).alias("__own"), *extra).alias("__q"), F.lit(1).alias("__kind"))
    both = rows.unionByName(points.select(*keys, "__at", point.alias("__p"), "__kind"), allowMissingColumns=True)
    both = both.join(edges, list(keys), "left").withColumn("__bucket", bucket(F.col("__edges"), F.col("__at"))).drop("__edges")
    # a row for each key and bucket
    reach = both.groupBy(*keys, "__bucket").agg(F.min("__p").alias("__least"), F.max("__p").alias("__most"))
    order = Window.partitionBy(*keys).orderBy("__bucket")
    reach = reach.select(*keys, "__bucket", F.last("__most", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.last("__least", True).over(Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    both = both.join(reach, [*keys, "__bucket"])
    w, back = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__kind"), Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__at"), F.desc("__kind"))
    upto = lambda v: F.last("__p", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"__low": F.coalesce(upto(w), "__before"), "__high": F.coalesce(upto(back), "__after")}).filter("__kind = 1")
    low, high = F.col("__low.__at"), F.col("__high.__at")
    pick = F.when(high.isNull() | (F.col("__at") - low <= high - F.col("__at")), F.col("__low")).otherwise(F.col("__high"))
    found = found.withColumn("__pick", pick)
    return found.select(*keys, F.col("__q.__own").alias(at), *(F.col(f"__q.{c}").alias(c) for c in extra), F.col("__pick.__at").alias("nearest"), *(F.col(f"__pick.{c}").alias(c) for c in carry))


def binned(points: DataFrame, x: str, y: str, boxes: DataFrame, width: float, inside: Column) -> DataFrame:
    """A range join as an equi-join: boxes (xl, xu, yl, yu) enter every bin of ``width`` that they touch, points one."""
    at = lambda c: F.floor(c / width)
    spread = boxes.withColumn("__bx", F.explode(F.sequence(at(F.col("xl")), at(F.col("xu"))))).withColumn("__by", F.explode(F.sequence(at(F.col("yl")), at(F.col("yu")))))
    own = points.withColumn("__px", at(F.col(x))).withColumn("__py", at(F.col(y)))
    return own.join(spread, (F.col("__px") == F.col("__bx")) & (F.col("__py") == F.col("__by")) & inside).drop("__px", "__py", "__bx", "__by")


def points_in_cells(points: DataFrame, cells: DataFrame, width: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points with the cell they lie within; those on an edge are in none."""
    inside = (F.col(x) > F.col("xl")) & (F.col(x) < F.col("xu")) & (F.col(y) > F.col("yl")) & (F.col(y) < F.col("yu"))
    return binned(points, x, y, cells, width, inside)


def cells_near_points(cells: DataFrame, points: DataFrame, half: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Cells (x, y) with a point within ``half`` on both axes, edges included."""
    boxes = cells.select(F.col("x"), F.col("y"), (F.col("x") - half).alias("xl"), (F.col("x") + half).alias("xu"), (F.col("y") - half).alias("yl"), (F.col("y") + half).alias("yu"))
    inside = F.col(x).between(F.col("xl"), F.col("xu")) & F.col(y).between(F.col("yl"), F.col("yu"))
    found = binned(points.select(x, y), x, y, boxes, 2 * half, inside).select("x", "y").distinct()
    return cells.join(found, ["x", "y"], "left_semi")


def match_extents(a: DataFrame, b: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows of ``a`` within the extent of ``b`` on every axis."""
    edge = b.agg(*(f(c).alias(f"__{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))))
    inside = reduce(lambda p, q: p & q, (F.col(c).between(F.col(f"__lo_{c}"), F.col(f"__hi_{c}")) for c in axes))
    return a.join(F.broadcast(edge), inside).select(*a.columns)  # one row
