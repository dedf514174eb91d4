"""Monotone and cubic interpolation of series between time steps, in column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.scalar import quotient


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp")).cast("double")


def _segments(df: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """Known rows (t, y) with the two steps (h) and slopes (d) on either side, their number i and the series' count n."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(*keys, time, F.col(value).cast("double").alias("__y")).dropna().withColumns({"__t": _seconds(F.col(time)), "__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    rows = rows.withColumns({"__h": F.lead("__t").over(w) - F.col("__t"), "__u": F.lead("__t").over(w), "__z": F.lead("__y").over(w)})
    rows = rows.withColumn("__d", quotient(F.col("__z") - F.col("__y"), F.col("__h")))
    shifted = {f"__{c}{name}": (F.lag(f"__{c}", k) if k > 0 else F.lead(f"__{c}", -k)).over(w) for c in "hd" for name, k in (("p", 1), ("pp", 2), ("x", -1))}
    return rows.withColumns(shifted)


def _hermite(x: Column, t: Column, h: Column, y: Column, z: Column, s: Column, r: Column) -> Column:
    """The cubic from (t, y) with slope s to (t + h, z) with slope r, at x."""
    p = quotient(x - t, h)
    q = 1 - p
    return y * (1 + 2 * p) * q * q + s * h * p * q * q + z * p * p * (3 - 2 * p) + r * h * p * p * (p - 1)


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    e = quotient((2 * h0 + h1) * d0 - h0 * d1, h0 + h1)
    return F.when(e * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(e) > 3 * F.abs(d0)), 3 * d0).otherwise(e)


def pchip(df: DataFrame, keys: Sequence[str], value: str, step_seconds: int = 3600, time: str = "time", cube: Sequence[str] = (), tolerance: float = 1e-2) -> DataFrame:
    """(keys, time, value) at every step from a cube's first to its last stamp, by monotone cubics.

    Slopes are weighted harmonic means of the steps' slopes on either side, zero at turns. A series' end pieces go on
    beyond its own known range. If any value of a cube (rows of the same ``cube`` keys, which are some of ``keys``; all rows
    without them) then leaves the cube's known range by more than ``tolerance``, the whole cube is on straight lines
    between known values instead, and null beyond them. A series with one known value has nulls; one with none isn't
    in the result.
    """
    span = df.groupBy(*cube).agg(F.min(_seconds(F.col(time))).alias("__a"), F.max(_seconds(F.col(time))).alias("__b"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    beside = lambda a, b: a.join(b, list(cube)) if cube else a.crossJoin(F.broadcast(b))  # noqa: E731  one row without cube keys
    c = lambda name: F.col(f"__{name}")
    rows = _segments(df, keys, value, time)
    w1, w2 = 2 * c("h") + c("hp"), c("h") + 2 * c("hp")
    inner = F.when(c("dp") * c("d") <= 0, 0.0).otherwise(quotient(w1 + w2, quotient(w1, c("dp")) + quotient(w2, c("d"))))
    slope = F.when(c("n") == 2, F.coalesce(c("d"), c("dp"))).when(c("i") == 1, _end_slope(c("h"), c("hx"), c("d"), c("dx"))).when(c("i") == c("n"), _end_slope(c("hp"), c("hpp"), c("dp"), c("dpp"))).otherwise(inner)
    rows = rows.withColumn("__s", slope).withColumn("__r", F.lead("__s").over(Window.partitionBy(*keys).orderBy(time)))
    rows = beside(rows.filter((c("i") < c("n")) | (c("n") == 1)), span)
    number = lambda x: F.ceil(quotient(x - c("a"), F.lit(step_seconds)))
    first = F.when(c("i") == 1, F.lit(0)).otherwise(number(c("t")))
    last = F.when(c("i") >= c("n") - 1, F.floor((c("b") - c("a")) / step_seconds)).otherwise(number(c("u")) - 1)
    rows = rows.withColumns({"__k0": first.cast("long"), "__k1": last.cast("long")}).filter("__k1 >= __k0").withColumn("__k", F.explode(F.sequence("__k0", "__k1")))
    rows = rows.withColumn("__x", c("a") + c("k") * step_seconds)
    smooth = _hermite(c("x"), c("t"), c("h"), c("y"), c("z"), c("s"), c("r"))
    line = F.when((c("x") >= c("t")) & (c("x") <= c("u")), c("y") + (c("z") - c("y")) * quotient(c("x") - c("t"), c("h")))
    rows = rows.select(*keys, *(f"__{n}" for n in ("x", "lo", "hi")), smooth.alias("__smooth"), line.alias("__line"))
    off = rows.groupBy(*cube).agg(F.coalesce(F.bool_or((c("smooth") < c("lo") - tolerance) | (c("smooth") > c("hi") + tolerance)), F.lit(False)).alias("__off"))
    out = beside(rows, off)
    return out.select(*keys, F.timestamp_seconds(c("x").cast("long")).cast("timestamp_ntz").alias(time), F.when(c("off"), c("line")).otherwise(c("smooth")).alias(value))


def cubic(df: DataFrame, keys: Sequence[str], value: str, step_seconds: int = 86_400, time: str = "time") -> DataFrame:
    """(keys, time, value) at every step from a series' first stamp up to its last, which is left out, by the not-a-knot cubic spline.

    The slopes solve a tridiagonal system whose rows come from window functions; a fold over the series' array of rows
    (as many as it has known steps) eliminates them and another one puts them in. Three points give their parabola, two a
    line, and one none. Nulls count as missing.
    """
    c = lambda name: F.col(f"__{name}")
    rows = _segments(df, keys, value, time)
    first, last = c("i") == 1, c("i") == c("n")
    h0, h1, d0, d1 = c("h"), c("hx"), c("d"), c("dx")  # at the first row
    g0, g1, e0, e1 = c("hp"), c("hpp"), c("dp"), c("dpp")  # at the last one
    small = c("n") < 4
    bend = quotient(F.when(first, d1 - d0).when(last, e0 - e1).otherwise(c("d") - c("dp")), F.when(first, h0 + h1).when(last, g0 + g1).otherwise(c("h") + c("hp")))
    few = F.when(c("n") == 2, F.coalesce(c("d"), c("dp"))).when(c("n") == 3, F.when(first, d0 - h0 * bend).when(last, e0 + g0 * bend).otherwise(c("dp") + c("hp") * bend))
    rows = rows.withColumns({
        "__low": F.when(first | small, 0.0).when(last, g0 + g1).otherwise(c("h")),
        "__mid": F.when(small, 1.0).when(first, h1).when(last, g1).otherwise(2 * (c("h") + c("hp"))),
        "__up": F.when(last | small, 0.0).when(first, h0 + h1).otherwise(c("hp")),
        "__rhs": F.when(small, F.coalesce(few, F.lit(0.0))).when(first, quotient((h0 + 2 * (h0 + h1)) * h1 * d0 + h0 * h0 * d1, h0 + h1)).when(last, quotient(g0 * g0 * e1 + (2 * (g0 + g1) + g0) * g1 * e0, g0 + g1)).otherwise(3 * (c("h") * c("dp") + c("hp") * c("d"))),
    })
    system = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__t", "__y", "__low", "__mid", "__up", "__rhs"))).alias("__rows"))
    start = F.struct(F.array().cast("array<struct<c:double,d:double>>").alias("all"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))

    def down(held: Column, r: Column) -> Column:
        m = r["__mid"] - r["__low"] * held["c"]
        up, rhs = quotient(r["__up"], m), quotient(r["__rhs"] - r["__low"] * held["d"], m)
        return F.struct(F.array_append(held["all"], F.struct(up.alias("c"), rhs.alias("d"))).alias("all"), up.alias("c"), rhs.alias("d"))

    def back(held: Column, r: Column) -> Column:
        s = r["d"] - r["c"] * held["s"]
        return F.struct(F.array_append(held["all"], s).alias("all"), s.alias("s"))

    system = system.withColumn("__down", F.aggregate("__rows", start, down, lambda v: F.reverse(v["all"])))
    system = system.withColumn("__slopes", F.aggregate("__down", F.struct(F.array().cast("array<double>").alias("all"), F.lit(0.0).alias("s")), back, lambda v: F.reverse(v["all"])))
    at = lambda a, i, f=None: F.get(F.col(a), i)[f] if f else F.get(F.col(a), i)
    i = F.col("__i")
    pieces = system.withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("__rows") - 2))).filter("size(__rows) > 1").select(
        *keys, at("__rows", F.lit(0), "__t").alias("__a"), at("__rows", i, "__t").alias("__t"), at("__rows", i + 1, "__t").alias("__u"), at("__rows", i, "__y").alias("__y"), at("__rows", i + 1, "__y").alias("__z"), at("__slopes", i).alias("__s"), at("__slopes", i + 1).alias("__r"),
    )
    number = lambda x: F.ceil((x - c("a")) / step_seconds).cast("long")
    pieces = pieces.withColumns({"__k0": number(c("t")), "__k1": number(c("u")) - 1}).filter("__k1 >= __k0").withColumn("__k", F.explode(F.sequence("__k0", "__k1")))
    x = c("a") + c("k") * step_seconds
    return pieces.select(*keys, F.timestamp_seconds(x.cast("long")).cast("timestamp_ntz").alias(time), _hermite(x, c("t"), c("u") - c("t"), c("y"), c("z"), c("s"), c("r")).alias(value))
