"""Cells of regular grids and moves between grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.scalar import in_box, key4
from marigrid.operators.joins import binned, points_in_cells
from marigrid.params import BBox


def axis_bounds(axis: DataFrame, name: str) -> DataFrame:
    """(name, lo, hi): edges halfway to the neighbours; the outer ones mirror the inner ones. One row for each coordinate."""
    w = Window.orderBy(name)
    a = axis.select(name).distinct().withColumn("__p", F.lag(name).over(w)).withColumn("__n", F.lead(name).over(w))
    lo = F.coalesce((F.col(name) + F.col("__p")) / 2, F.col(name) - (F.col("__n") - F.col(name)) / 2)
    hi = F.coalesce((F.col(name) + F.col("__n")) / 2, F.col(name) + (F.col(name) - F.col("__p")) / 2)
    return a.select(name, lo.alias("lo"), hi.alias("hi"))


def cells(grid: DataFrame) -> DataFrame:
    """(x, y, xl, xu, yl, yu) of a grid's points."""
    bx = axis_bounds(grid, "x").select("x", F.col("lo").alias("xl"), F.col("hi").alias("xu"))
    by = axis_bounds(grid, "y").select("y", F.col("lo").alias("yl"), F.col("hi").alias("yu"))
    return grid.select("x", "y").distinct().join(bx, "x").join(by, "y")


def spacing(axis: DataFrame, name: str) -> DataFrame:
    """The step of an axis: the median of its distinct differences."""
    w = Window.orderBy(name)
    steps = axis.select(name).distinct().select((F.col(name) - F.lag(name).over(w)).alias("d")).dropna().distinct()
    return steps.agg(F.median("d").alias("spacing"))


def window_cells(grid: DataFrame, n_grids: float) -> DataFrame:
    """2.7: (x, y, near_x, near_y): for each cell those within the box around it, edges included.

    The box's side is ``n_grids`` times the larger of the axes' spacings (which only the distinct coordinates give); cells meet in
    bins of that side, not all with all. An axis of one coordinate has no spacing; a grid of one cell is its own window.
    """
    points = grid.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    dx, dy = (spacing(points, axis).first()[0] for axis in "xy")
    side = n_grids * max(dx or 0.0, dy or 0.0)
    half = side / 2
    boxes = points.select("x", "y", (F.col("x") - half).alias("xl"), (F.col("x") + half).alias("xu"), (F.col("y") - half).alias("yl"), (F.col("y") + half).alias("yu"))
    inside = F.col("near_x").between(F.col("xl"), F.col("xu")) & F.col("near_y").between(F.col("yl"), F.col("yu"))
    near = points.select(F.col("x").alias("near_x"), F.col("y").alias("near_y"))
    return binned(near, "near_x", "near_y", boxes, side or 1.0, inside).select("x", "y", "near_x", "near_y")


def to_cells(points: DataFrame, grid_cells: DataFrame, width: float, value: str, time: str = "time", x: str = "lon", y: str = "lat") -> DataFrame:
    """Mean of the points within each cell at each time."""
    return points_in_cells(points, grid_cells, width, x, y).groupBy("x", "y", time).agg(F.avg(value).alias(value))


def overlap_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(sx, sy, x, y, weight): shared area of source and target cells, with sines of latitude.

    The axes are joined one by one (few hundred rows each), so no pair of cells is looked at that doesn't overlap.
    """
    sin = lambda c: F.sin(F.radians(c))

    def axis(lo: str, hi: str, s: str, t: str, f) -> DataFrame:
        a = source.select(F.col(s).alias(f"s{s}"), F.col(lo).alias("a0"), F.col(hi).alias("a1")).distinct()
        b = target.select(F.col(t), F.col(lo).alias("b0"), F.col(hi).alias("b1")).distinct()
        low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
        return a.join(b, (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).select(f"s{s}", t, (f(high) - f(low)).alias(f"w{s}"))

    wx, wy = axis("xl", "xu", "x", "x", lambda c: c), axis("yl", "yu", "y", "y", sin)
    return wx.crossJoin(wy).select("sx", "sy", "x", "y", (F.col("wx") * F.col("wy")).alias("weight"))


def regrid(values: DataFrame, weights: DataFrame, value: str, time: str = "time") -> DataFrame:
    """G1: area-weighted means on the target grid; missing sources lower the weights' sum instead of the mean."""
    known = values.select(F.col("x").alias("sx"), F.col("y").alias("sy"), time, value).dropna(subset=[value])
    return known.join(weights, ["sx", "sy"]).groupBy("x", "y", time).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias(value))


def outside_mask(df: DataFrame, mask: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows of cells that the mask (land, say) doesn't hold; coordinates meet at four places."""
    held = mask.select(*(key4(F.col(k)).alias(f"__m{i}") for i, k in enumerate(keys))).distinct()
    on = reduce(lambda a, b: a & b, (key4(F.col(k)) == F.col(f"__m{i}") for i, k in enumerate(keys)))
    return df.join(held, on, "left_anti")


def central_location(ocean: DataFrame, whole: DataFrame, x: float, y: float, box: BBox) -> DataFrame:
    """One row (ok): the point is within the grid's range and the box around it has cells of ``ocean``."""
    within = F.lit(x).between(F.min("x"), F.max("x")) & F.lit(y).between(F.min("y"), F.max("y"))
    some = ocean.agg(F.coalesce(F.bool_or(in_box(F.col("x"), F.col("y"), box)), F.lit(False)).alias("__some"))
    return whole.agg(F.coalesce(within, F.lit(False)).alias("__in")).crossJoin(F.broadcast(some)).select((F.col("__in") & F.col("__some")).alias("ok"))  # one row each


def complete_cells(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """K8: rows of cells that lack no value at any time."""
    whole = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in values))
    return df.join(df.groupBy(*keys).agg(F.bool_and(whole).alias("__all")).filter("__all").drop("__all"), list(keys), "left_semi")


def snapped(df: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """K8: a coordinate moved to the nearest one of an axis, ties to the lesser. The axis (some hundred values) goes along as one array."""
    one = axis.agg(F.collect_set(name).alias("__axis"))
    near: Column = F.array_min(F.transform("__axis", lambda v: F.struct(F.abs(v - F.col(name)).alias("d"), v.alias("v"))))["v"]
    return df.crossJoin(F.broadcast(one)).withColumn(name, F.when(F.col(name).isNotNull(), near)).drop("__axis")
