"""Distributions, regressions and goodness of fit as grouped aggregates.

A value that a group doesn't define (a ratio over 0, too few rows, collinear regressors) is null; the group's
other values and all other groups stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.distributions import f_sf
from marigrid.functions.scalar import bucket, correlation, quotient

#: Probabilities of the quantile tables.
QUANTILES = [round(i / 100, 2) for i in range(1, 99)] + [0.999, 0.9999, 0.99999, 1.0]


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rank (ties to the least) over count plus one."""
    w = Window.partitionBy(*keys)
    return df.withColumn("ecdf", F.rank().over(w.orderBy(value)) / (F.count(value).over(w) + 1))


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] = tuple(QUANTILES)) -> DataFrame:
    """(keys, level, pct, q): exact quantiles with linear interpolation; ``level`` numbers the probabilities.

    Joins go by ``level``, never by the float. Partial aggregation keeps one count for each distinct value.
    """
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, probabilities))).alias("q"))
    pct = F.get(F.array(*map(F.lit, probabilities)), F.col("level"))
    return q.select(*keys, F.posexplode("q").alias("level", "q")).select(*keys, "level", pct.alias("pct"), "q")


def select_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] = tuple(QUANTILES), buckets: int = 64) -> DataFrame:
    """A11 where groups are large: the table of ``quantile_table`` by selection, so that no task holds a group's distinct values.

    A sketch of each group gives edges of ``buckets``; their counts say which buckets hold the ranks beside the wanted
    positions. Only rows of those buckets are shuffled, by group and bucket and as one count for each value, and put in
    order there (sorts spill). Exact, as the edges only decide where values are looked for. Nulls count nowhere; groups
    without values aren't in the result.
    """
    keys, held = list(keys), df.select(*keys, F.col(value).cast("double").alias("__v")).dropna(subset=["__v"])
    known = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 2000).alias("__edges"))
    beside = lambda a, b, on: a.join(b, on) if on else a.crossJoin(F.broadcast(b))  # noqa: E731  one row without keys
    rows = beside(held, known.drop("__n"), keys).select(*keys, bucket(F.col("__edges"), F.col("__v")).alias("__bucket"), "__v")
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bucket")) - F.col("__c"))
    # as many rows as probabilities for each group
    at = F.get(F.array(*map(F.lit, probabilities)), F.col("level")) * (F.col("__n") - 1)
    asked = known.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(len(probabilities) - 1))).alias("level")).withColumns({"__lo": F.floor(at), "__part": at - F.floor(at)})
    ranks = asked.select(*keys, F.explode(F.array("__lo", F.least(F.col("__lo") + 1, F.col("__n") - 1))).alias("__rank")).distinct()
    ranks = beside(ranks, counts, keys).filter("__rank >= __before AND __rank < __before + __c")
    wanted = ranks.groupBy(*keys, "__bucket", "__before").agg(F.collect_list("__rank").alias("__ranks"))
    values = rows.join(wanted.select(*keys, "__bucket"), [*keys, "__bucket"], "left_semi").groupBy(*keys, "__bucket", "__v").agg(F.count(F.lit(1)).alias("__c"))
    values = values.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__bucket").orderBy("__v"))).join(wanted, [*keys, "__bucket"])
    inside = F.filter("__ranks", lambda r: (r >= F.col("__before") + F.col("__upto") - F.col("__c")) & (r < F.col("__before") + F.col("__upto")))
    found = values.select(*keys, "__v", F.explode(inside).alias("__rank"))
    low = asked.join(found.select(*keys, F.col("__v").alias("__a"), F.col("__rank").alias("__lo")), [*keys, "__lo"])
    both = low.withColumn("__hi", F.least(F.col("__lo") + 1, F.col("__n") - 1)).join(found.select(*keys, F.col("__v").alias("__b"), F.col("__rank").alias("__hi")), [*keys, "__hi"])
    pct = F.get(F.array(*map(F.lit, probabilities)), F.col("level"))
    return both.select(*keys, "level", pct.alias("pct"), (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias("q"))


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """R2: slope m, intercept b, r2, deviation and range of x, n."""
    return df.dropna(subset=[x, y]).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("b"), F.regr_r2(y, x).alias("r2"),
        F.stddev_pop(x).alias("stdev"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.count(F.lit(1)).alias("n"),
    )


def f_statistic(r2: Column, n: Column) -> Column:
    """For one regressor; null for a perfect fit."""
    return quotient(r2, 1 - r2) * (n - 2)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    """The upper tail of the F distribution; null where the statistic or the degrees are."""

    @F.pandas_udf("double")
    def tail(f, d1, d2):
        known = (f.notna() & d1.notna() & d2.notna() & (d2 > 0)).to_numpy()
        out = np.full(len(f), np.nan)
        out[known] = f_sf(*(v.to_numpy()[known] for v in (f, d1, d2)))
        return pd.Series(out).where(known)

    return tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def ols3(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Slopes m_x of three standardised regressors, intercept b and r2, by the normal equations.

    The moments come from one grouped pass; 3 by 3 systems of correlations are solved in closed form.
    """
    rows = df.dropna(subset=[*xs, y]).groupBy(*keys).agg(
        *(correlation(p, q).alias(f"r_{i}{j}") for i, p in enumerate(xs) for j, q in enumerate(xs) if i < j),
        *(correlation(p, y).alias(f"r_{i}y") for i, p in enumerate(xs)),
        *(F.avg(p).alias(f"z_mean_{p}") for p in xs), *(F.stddev_pop(p).alias(f"z_std_{p}") for p in xs),
        *(F.min(p).alias(f"min_{p}") for p in xs), *(F.max(p).alias(f"max_{p}") for p in xs),
        F.avg(y).alias("b"), F.stddev_pop(y).alias("__sy"), F.count(F.lit(1)).alias("n"),
    )
    return solved3(rows, keys, xs)


def solved3(rows: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """The regression of ``ols3`` from correlations (r_01, r_02, r_12, r_0y, r_1y, r_2y) and moments.

    Regressors that are collinear (a determinant under 1e-12) or don't vary have null slopes and r2.
    """
    a, b, c = xs
    r01, r02, r12, y0, y1, y2 = (F.col(n) for n in ("r_01", "r_02", "r_12", "r_0y", "r_1y", "r_2y"))
    det = 1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12
    det = F.when(det > 1e-12, det)
    s0 = (y0 * (1 - r12 * r12) + y1 * (r02 * r12 - r01) + y2 * (r01 * r12 - r02)) / det
    s1 = (y0 * (r02 * r12 - r01) + y1 * (1 - r02 * r02) + y2 * (r01 * r02 - r12)) / det
    s2 = (y0 * (r01 * r12 - r02) + y1 * (r01 * r02 - r12) + y2 * (1 - r01 * r01)) / det
    sy = F.col("__sy")
    out = rows.withColumns({f"m_{a}": s0 * sy, f"m_{b}": s1 * sy, f"m_{c}": s2 * sy, "r2": s0 * y0 + s1 * y1 + s2 * y2})
    return out.select(*keys, f"m_{a}", f"m_{b}", f"m_{c}", "b", "r2", "n", *(f"{n}_{p}" for p in xs for n in ("z_mean", "z_std", "min", "max")))


def fit_metrics(df: DataFrame, keys: Sequence[str], sim: str, obs: str) -> DataFrame:
    """Agreement of two columns: errors, distances, correlations, efficiencies and n."""
    w = Window.partitionBy(*keys)
    s, o = F.col(sim), F.col(obs)
    # average ranks, as ties share them
    tied = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    rows = df.dropna(subset=[sim, obs]).withColumns({"__rs": tied(sim), "__ro": tied(obs), "__mo": F.avg(obs).over(w), "__ms": F.avg(sim).over(w)})
    m = F.col("__mo")
    cv = lambda c: quotient(F.stddev_pop(c), F.avg(c))
    r = correlation(sim, obs)
    square = F.sum((s - o) ** 2)
    around = F.abs(s - m) + F.abs(o - m)
    kge = lambda spread: 1 - F.sqrt((r - 1) ** 2 + (spread - 1) ** 2 + (quotient(F.avg(sim), F.avg(obs)) - 1) ** 2)
    # a sum with a term that isn't defined isn't either
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg((s - o) ** 2)).alias("rmse"), F.avg((s - o) ** 2).alias("mse"), F.avg(F.abs(s - o)).alias("mae"), F.sqrt(square).alias("ed"),
        F.sqrt(total((quotient(o, m) - quotient(s, F.col("__ms"))) ** 2)).alias("ned"), (r**2).alias("r2"), r.alias("pearson"), correlation("__rs", "__ro").alias("spearman"),
        (1 - quotient(square, F.sum((o - m) ** 2))).alias("nse"), (1 - quotient(F.sum(F.abs(s - o)), F.sum(F.abs(o - m)))).alias("nse_mod"),
        (1 - quotient(total(quotient(s - o, o) ** 2), total(quotient(o - m, m) ** 2))).alias("nse_rel"),
        kge(quotient(F.stddev_pop(sim), F.stddev_pop(obs))).alias("kge_2009"), kge(quotient(cv(sim), cv(obs))).alias("kge_2012"),
        (total((quotient(s, o) - 1) ** 2) / F.count(F.lit(1))).alias("relative_mse"), F.count(F.lit(1)).alias("n"),
    )


def l_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """L-moments l1 to l4 from rank-weighted sums; the k-th is null for fewer than k rows."""
    w = Window.partitionBy(*keys)
    rows = df.dropna(subset=[value]).withColumn("__i", F.row_number().over(w.orderBy(value)).cast("double")).withColumn("__n", F.count(F.lit(1)).over(w).cast("double"))
    i, n, v = F.col("__i"), F.col("__n"), F.col(value)
    b = rows.groupBy(*keys).agg(
        F.avg(v).alias("b0"), F.avg(quotient(i - 1, n - 1) * v).alias("b1"), F.avg(quotient((i - 1) * (i - 2), (n - 1) * (n - 2)) * v).alias("b2"),
        F.avg(quotient((i - 1) * (i - 2) * (i - 3), (n - 1) * (n - 2) * (n - 3)) * v).alias("b3"), F.count(F.lit(1)).alias("n"),
    )
    b0, b1, b2, b3 = (F.col(f"b{k}") for k in range(4))
    return b.select(*keys, b0.alias("l1"), (2 * b1 - b0).alias("l2"), (6 * b2 - 6 * b1 + b0).alias("l3"), (20 * b3 - 30 * b2 + 12 * b1 - b0).alias("l4"), "n")


def dispersion(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From sites' L-moments, their averages and ratios weighted by n, and V, the weighted spread of l2 / l1."""
    n = F.col("n")
    rows = moments.withColumns({"__t1": quotient(F.col("l2"), F.col("l1")), "__t3": quotient(F.col("l3"), F.col("l2")), "__t4": quotient(F.col("l4"), F.col("l2"))})
    mean = lambda c: F.sum(F.col(c) * n) / F.sum(n)
    means = rows.groupBy(*keys).agg(mean("l1").alias("l1"), mean("l2").alias("l2"), mean("__t1").alias("t1"), mean("__t3").alias("t3"), mean("__t4").alias("t4"), F.sum(n).alias("n"))
    around = rows.select(*keys, "__t1", F.col("n").alias("__n")).join(means.select(*keys, F.col("t1").alias("__m")), list(keys))
    spread = around.groupBy(*keys).agg((F.sum((F.col("__t1") - F.col("__m")) ** 2 * F.col("__n")) / F.sum("__n")).alias("v"))
    return means.join(spread, list(keys))


def summed(frames: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of many frames' values by their keys; a frame that lacks a key adds nothing."""
    rows = reduce(lambda a, b: a.unionByName(b), (f.select(*keys, *values) for f in frames))
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def whole_means(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Means over the rows that lack none of the values."""
    return df.dropna(subset=list(values)).groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def capped(df: DataFrame, keys: Sequence[str], value: str, level: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``value`` at most its greatest among rows whose level is in [low, high]."""
    top = F.max(F.when(F.col(level).between(low, high), F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("capped", F.least(F.col(value), top))


def has_all(df: DataFrame, keys: Sequence[str], member: str, wanted: Sequence[str]) -> DataFrame:
    """Keys whose rows hold all wanted members."""
    found = F.count_distinct(F.when(F.col(member).isin(list(wanted)), F.col(member)))
    return df.groupBy(*keys).agg(found.alias("__n")).filter(F.col("__n") == len(set(wanted))).drop("__n")


def divide(df: DataFrame, keys: Sequence[str], divisor: DataFrame) -> DataFrame:
    """Keys that occur with every row of the divisor."""
    on = divisor.columns
    need = divisor.distinct().agg(F.count(F.lit(1)).alias("__need"))
    have = df.join(divisor.distinct(), on, "left_semi").select(*keys, *on).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    return have.join(F.broadcast(need), F.col("__have") == F.col("__need")).select(*keys)  # need is one row
