"""Column expressions; all of them stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marigrid.params import BBox


def quotient(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, so that one degenerate group costs its own value and not the job."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of two columns over the rows that have both; null where either doesn't vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return quotient(F.covar_pop(a, b), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def bucket(edges: Column, at: Column) -> Column:
    """The number of edges under a value: equal values share a bucket; without edges it is 0."""
    return F.coalesce(F.size(F.filter(edges, lambda e: e < at)), F.lit(0))


def wrap_longitude(x: Column) -> Column:
    """Degrees from -180 (included) to 180 (excluded)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def in_box(x: Column, y: Column, box: BBox) -> Column:
    """Both edges are in."""
    return x.between(box.xmin, box.xmax) & y.between(box.ymin, box.ymax)


def in_dates(time: Column, first: str, last: str) -> Column:
    """Whole days, both included."""
    return (time >= F.to_timestamp_ntz(F.lit(first))) & (time < F.to_timestamp_ntz(F.lit(last)) + F.expr("INTERVAL 1 DAY"))


def finite(x: Column) -> Column:
    """Null unless a number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def month_day(time: Column) -> Column:
    """the calendar day as MMdd."""
    return F.date_format(time, "MMdd")


def stress(u: Column) -> Column:
    """pseudo wind stress, signed square."""
    return u * F.abs(u)


def key4(x: Column) -> Column:
    """A float as a join key: four places, ties to even."""
    return F.bround(x, 4).cast("decimal(18,4)")


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """P19."""
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def standardised(x: Column, mean: Column, std: Column) -> Column:
    """F3; null where nothing varies."""
    return quotient(x - mean, std)


def extrapolated(x: Column, low: Column, high: Column, either: bool = False) -> Column:
    """the stored rule asks for both sides at once; ``either`` is the useful one."""
    return (x < low) | (x > high) if either else (x < low) & (x > high)


def close(a: Column, b: Column, within: float = 1e-7) -> Column:
    """F12."""
    return F.abs(a - b) < within


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """F8: piecewise linear through the points of two arrays (xs increasing), constant beyond the ends."""
    n = F.size(xs)
    at = lambda a, i: F.get(a, i)
    below = F.size(F.filter(xs, lambda v: v <= x))
    i = F.least(F.greatest(below - 1, F.lit(0)), n - 2)
    x0, x1, y0, y1 = at(xs, i), at(xs, i + 1), at(ys, i), at(ys, i + 1)
    return F.when(x <= at(xs, F.lit(0)), at(ys, F.lit(0))).when(x >= at(xs, n - 1), at(ys, n - 1)).otherwise(y0 + quotient((y1 - y0) * (x - x0), x1 - x0))


def identifier(value: Column, names: Sequence[str]) -> Column:
    """A dotted id as a struct."""
    parts = F.split(value, r"\.")
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def short_name(value: Column, removed: Sequence[str], most: int = 80) -> Column:
    """lower case without the given words and blanks, cut to ``most`` characters."""
    out = F.lower(value)
    for word in removed:
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.substring(F.replace(out, F.lit(" "), F.lit("")), 1, most)


def weibull_acf(lag: Column, scale: Column, shape: Column) -> Column:
    """R17; null for scale 0, as the other curves are where they aren't defined."""
    return F.exp(-F.pow(quotient(lag, scale), shape))


def pareto_acf(lag: Column, scale: Column, shape: Column) -> Column:
    """R17."""
    return F.pow(1 + quotient(shape * lag, scale), quotient(F.lit(-1.0), shape))


def burr_acf(lag: Column, scale: Column, shape1: Column, shape2: Column, plain: bool = False) -> Column:
    """Burr XII. The stored exponent is -shape2 / shape1; the ``plain`` one is -1 / (shape1 * shape2)."""
    return F.pow(1 + shape2 * F.pow(quotient(lag, scale), shape1), quotient(F.lit(-1.0), shape1 * shape2) if plain else quotient(-shape2, shape1))


def fgn_acf(lag: Column, hurst: Column, plain: bool = False) -> Column:
    """Fractional Gaussian noise. The stored rule halves the last of the three terms, the ``plain`` one their sum."""
    before, at, after = F.pow(F.abs(lag - 1), 2 * hurst), F.pow(F.abs(lag), 2 * hurst), F.pow(F.abs(lag + 1), 2 * hurst)
    return 0.5 * (before - 2 * at + after) if plain else before - 2 * at + after / 2


def transformation_curve(rho: Column, b: Column, c: Column) -> Column:
    """Gaussian correlation that gives a target correlation; null for b 0 or c 1."""
    return quotient(F.pow(1 + b * rho, 1 - c) - 1, F.pow(1 + b, 1 - c) - 1)
