"""Empirical autocorrelation of series with gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.scalar import correlation, quotient
from marigrid.operators.calendar import centers
from marigrid.operators.resample import fill_gaps
from marigrid.operators.windows import lag_pairs, sessions, until_negative
from marigrid.params import Window as Recurring


def empirical_acf(df: DataFrame, keys: Sequence[str], value: str, lags: int = 48, gap_hours: float = 48, time: str = "time", step: str = "1 HOUR", drop_edges: bool = True, gaps_count: bool = False) -> DataFrame:
    """(keys, lag, acf) up to the first negative value; lags whose pairs don't vary are null.

    Series are parted at gaps over ``gap_hours``; the pairs of all segments are correlated together. The stored
    rule leaves out each series' first row and the last row before a gap (``drop_edges``), and counts rows
    rather than steps as lags; ``gaps_count`` puts missing steps in.
    """
    rows = sessions(df.dropna(subset=[value]), keys, gap_hours, time)
    if drop_edges:
        w = Window.partitionBy(*keys).orderBy(time)
        rows = rows.withColumn("__first", F.row_number().over(w)).withColumn("__next", F.lead("segment").over(w))
        rows = rows.filter((F.col("__first") > 1) & (F.col("__next").isNull() | (F.col("__next") == F.col("segment")))).drop("__first", "__next")
    if gaps_count:
        rows = fill_gaps(rows.select(*keys, "segment", time, value), [*keys, "segment"], step, time)
    pairs = lag_pairs(rows, [*keys, "segment"], time, value, lags)
    return until_negative(pairs.groupBy(*keys, "lag").agg(correlation("a", "b").alias("acf"), F.count(F.lit(1)).alias("pairs")), keys, "lag", "acf")


def window_acf(
    df: DataFrame, window: Recurring, keys: Sequence[str], series: Sequence[str], value: str, lags: int = 48, gap_hours: float = 48, time: str = "time", match: str = "instant", hour: int = 0
) -> DataFrame:
    """2.7 with R18: (keys, center_day, lag, acf, pairs) for each calendar day's annual window, up to the first negative value.

    ``series`` are the keys of one time series, ``keys`` those of them that results are told apart by: the pairs of
    all series of a key are correlated together. "instant" takes the rows at ``hour`` of whole days, "interval" all rows of
    the closed interval around a center. As in ``empirical_acf``, a window's series is parted at gaps, lags count rows,
    and the series' first row in the window and the last row before each gap are left out.

    Pairs are reduced to moments by their first and last day before windows are looked at, and moments are added up
    over the windows that hold both days. Which rows a window leaves out is known from its borders, one or two rows a
    series, window and year; only their pairs are looked up again and taken off (or put back, where a window ends on a
    row that a gap follows). Windows must be shorter than a year. Null values take no part.
    """
    if 2 * window.half >= 365:
        raise ValueError("windows of neighbouring years overlap")
    series = list(series)
    day = lambda c: F.floor((F.unix_timestamp(c.cast("timestamp")) - hour * 3600) / 86400)
    rows = df.dropna(subset=[value]).select(*series, F.col(time).cast("timestamp_ntz").alias("__t"), F.col(value).cast("double").alias("__v"))
    if match == "instant":
        rows = rows.filter(F.col("__t") == F.date_trunc("day", "__t").cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS"))
    about = float(rows.agg(F.avg("__v")).first()[0] or 0.0)
    seconds = F.unix_timestamp(F.col("__t").cast("timestamp"))
    w = Window.partitionBy(*series).orderBy("__t")
    rows = rows.withColumns({"__v": F.col("__v") - about, "__s": seconds, "__d0": day(F.col("__t")), "__d1": -F.floor(-(seconds - hour * 3600) / 86400)})
    step = F.lead("__s").over(w) - F.col("__s")
    rows = rows.withColumn("__end", step.isNull() | (step > gap_hours * 3600))
    rows = rows.withColumn("__part", F.coalesce(F.sum(F.col("__end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = F.struct("__s", "__v", "__part", "__end", "__d0", "__d1")
    rows = rows.withColumns({
        "__ahead": F.collect_list(near).over(w.rowsBetween(1, lags)), "__back": F.reverse(F.collect_list(near).over(w.rowsBetween(-lags, -1))),
        "__edge": F.coalesce(F.lag("__d0").over(w) != F.col("__d0"), F.lit(True)) | F.coalesce(F.lead("__d1").over(w) != F.col("__d1"), F.lit(True)),
    })

    def moments(pairs: DataFrame, by: Sequence[str], a: Column, b: Column, sign: Column = F.lit(1.0)) -> DataFrame:
        sums = {"__n": F.lit(1.0), "__a": a, "__b": b, "__aa": a * a, "__bb": b * b, "__ab": a * b}
        return pairs.groupBy(*by, "lag").agg(*(F.sum(sign * c).alias(n) for n, c in sums.items()))

    ahead = rows.select(*series, "__v", "__part", "__d0", F.posexplode("__ahead").alias("lag", "__p")).filter("__p.__part = __part AND NOT __p.__end")
    daily = moments(ahead.select(*series, "__v", "__d0", F.col("__p.__d1").alias("__d1"), F.col("__p.__v").alias("__u"), (F.col("lag") + 1).alias("lag")), [*series, "__d0", "__d1"], F.col("__v"), F.col("__u"))
    spans = centers(df.sparkSession, window).select("center_day", F.unix_date(F.to_date("center")).cast("long").alias("__at"))
    spans = spans.withColumns({"__lo": F.col("__at") - window.half, "__hi": F.col("__at") + window.half}).withColumn("__d0", F.explode(F.sequence("__lo", "__hi")))
    spans = F.broadcast(spans)  # 366 x years x days rows, whatever the data's size
    names = ["__n", "__a", "__b", "__aa", "__bb", "__ab"]
    whole = daily.join(spans, "__d0").filter("__d1 <= __hi").groupBy(*keys, "center_day", "lag").agg(*(F.sum(c).alias(c) for c in names))

    held = rows.groupBy(*series, "__d0", "__d1").agg(F.min("__s").alias("__first"), F.max("__s").alias("__last")).join(spans, "__d0").filter("__d1 <= __hi")
    borders = held.groupBy(*series, "center_day", "__at", "__lo", "__hi").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    years = Window.partitionBy(*series, "center_day")
    borders = borders.withColumns({"__opens": F.min("__first").over(years), "__closes": F.max("__last").over(years)})
    ends = F.array(F.when(F.col("__first") == F.col("__opens"), F.struct(F.col("__first").alias("__s"), F.lit(True).alias("__front"))), F.struct(F.col("__last").alias("__s"), F.lit(False).alias("__front")))
    asked = borders.select(*series, "center_day", "__lo", "__hi", "__opens", "__closes", F.inline(F.filter(ends, lambda e: e.isNotNull())))
    known = rows.filter("__edge").select(*series, "__s", "__v", "__part", "__end", "__ahead", "__back").join(asked, [*series, "__s"])
    beside = known.select(*series, "center_day", "__lo", "__hi", "__opens", "__closes", "__s", "__v", "__part", "__end", "__front", F.posexplode(F.when(F.col("__front"), F.col("__ahead")).otherwise(F.col("__back"))).alias("lag", "__p")).filter("__p.__part = __part")
    final = F.col("__s") == F.col("__closes")
    sign = F.when(F.col("__front") & ~F.col("__p.__end") & (F.col("__p.__d1") <= F.col("__hi")), -1.0)
    sign = sign.when(~F.col("__front") & (F.col("__p.__d0") >= F.col("__lo")) & (F.col("__p.__s") != F.col("__opens")), F.when(final & F.col("__end"), 1.0).when(~final & ~F.col("__end"), -1.0))
    mended = beside.withColumns({"__sign": sign, "lag": F.col("lag") + 1, "__x": F.when(F.col("__front"), F.col("__v")).otherwise(F.col("__p.__v")), "__y": F.when(F.col("__front"), F.col("__p.__v")).otherwise(F.col("__v"))}).filter("__sign IS NOT NULL")
    mended = moments(mended, [*keys, "center_day"], F.col("__x"), F.col("__y"), F.col("__sign"))
    sums = whole.unionByName(mended.select(*keys, "center_day", "lag", *names)).groupBy(*keys, "center_day", "lag").agg(*(F.sum(c).alias(c) for c in names))
    n, a, b = F.round("__n"), F.col("__a"), F.col("__b")
    # what is left of squares that cancel is no variation
    spread = lambda s, q: F.when((n > 1) & (n * q - s * s > 1e-11 * n * q), n * q - s * s)
    r = quotient(n * F.col("__ab") - a * b, F.sqrt(spread(a, F.col("__aa")) * spread(b, F.col("__bb"))))
    out = sums.select(*keys, "center_day", "lag", F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("acf"), n.cast("long").alias("pairs")).dropna(subset=["acf"])
    return until_negative(out, [*keys, "center_day"], "lag", "acf")
