"""The whole chain from observed hours and projected days to projected hours: windows, fits, shifts, caches, blocks and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.functions import distributions as dist
from marigrid.functions.scalar import month_day
from marigrid.operators import acf, disagg, resample
from marigrid.operators.joins import lookup_exact, nearest
from marigrid.params import Disaggregation, Window
from marigrid.plans import water


def hourly_parameters(hourly: DataFrame, projected: DataFrame, keys: Sequence[str], value: str, family: str, seen: Window, ahead: Window, match: str = "interval") -> DataFrame:
    """R15 in windows, R25: (keys, center_day, a column for each parameter of the family) of the hours that are projected.

    Hours and their daily means are fitted in the windows of ``seen``, projected days in those of ``ahead``; the hours'
    parameters are then shifted as the days' are. Calendar days that lack any of the three fits are missing.
    """
    on = [*keys, "center_day", "param"]
    days = resample.to_step(hourly, keys, [value])
    fits = {
        "hourly_obs": disagg.window_marginals(hourly, seen, keys, value, family, match=match),
        "daily_obs": disagg.window_marginals(days, seen, keys, value, family),
        "daily_cmip": disagg.window_marginals(projected, ahead, keys, value, family),
    }
    named = [f.filter(F.col("param").isin(list(dist.PARAMETERS[family]))).withColumnRenamed("value", name) for name, f in fits.items()]
    shifted = water.shifted_parameters(named[0].join(named[1], on).join(named[2], on), family)
    # floats of four places: keys of the caches
    return shifted.groupBy(*keys, "center_day").pivot("param", list(dist.PARAMETERS[family])).agg(F.first("hourly_cmip"))


def hourly_correlation(hourly: DataFrame, keys: Sequence[str], value: str, seen: Window, spec: Disaggregation, match: str = "interval") -> DataFrame:
    """R18, R19 in windows: (keys, center_day, acs_scale, acs_shape) of Weibull curves."""
    known = acf.window_acf(hourly, seen, keys, keys, value, spec.lags, spec.lags, match=match)
    return disagg.fit_acf(known, [*keys, "center_day"]).select(*keys, "center_day", F.col("scale").alias("acs_scale"), F.col("shape").alias("acs_shape"))


def with_blocks(days: DataFrame, family: str, spec: Disaggregation = Disaggregation(), rest: Sequence[str] = ()) -> DataFrame:
    """Days with xk and the family's parameters, with b, c and v from caches of the distinct parameters.

    Caches are joined by parameters to four places; the block count comes with the nearest simulated mean. Days whose
    parameters have no curve keep null b, c and v. ``rest`` names columns of ``days`` that stay.
    """
    names = list(dist.PARAMETERS[family])
    tuples = days.select(*names).dropna().distinct()
    curves = disagg.correlation_curves(tuples, family).drop("rho_x")
    blocks = disagg.block_means(tuples, family, spec).select(*names, "xk", "v")
    near = nearest(days.select(*rest, *names, "xk"), blocks, names, "xk", "xk", ["v"]).drop("nearest")
    return lookup_exact(near, curves, names)


def hourly_totals(hourly: DataFrame, projected: DataFrame, tides: DataFrame, levels: DataFrame, keys: Sequence[str], seen: Window, ahead: Window, family: str = "skewnorm", spec: Disaggregation = Disaggregation(), match: str = "interval") -> DataFrame:
    """Chain C: (keys, time, msl, tides, ntr, twl) for every hour that has all three parts.

    ``hourly`` and ``projected`` hold (keys, time, ntr) by hour and by day, ``tides`` (keys, time, tides) by hour, ``levels``
    (keys, time, msl) by day. Every day's parameters are those of its calendar day. Days without parameters have
    no hours in the result.
    """
    marginals = hourly_parameters(hourly, projected, keys, "ntr", family, seen, ahead, match)
    curves = hourly_correlation(hourly, keys, "ntr", seen, spec, match)
    fitted = marginals.join(curves, [*keys, "center_day"])
    days = projected.select(*keys, "time", F.col("ntr").alias("xk"), month_day(F.col("time")).alias("center_day")).join(fitted, [*keys, "center_day"])
    rest = [*keys, "time", "acs_scale", "acs_shape"]
    hours = disagg.disaggregate(with_blocks(days, family, spec, rest), keys, family, spec).dropna(subset=["ntr"]).filter(~F.isnan("ntr"))
    at = levels.select(*keys, F.explode(F.sequence(F.col("time"), F.col("time") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("time"), "msl")
    return water.total_level(tides, hours, at, [*keys, "time"]).select(*keys, "time", "msl", "tides", "ntr", "twl")
