"""Chains of operators: residuals, bias correction, mean sea level, totals, attribution and catalogues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marigrid.functions.distributions import LIMITS
from marigrid.functions.scalar import clip, extrapolated, in_dates, interpolate, quotient, standardised, stress
from marigrid.operators.joins import left_chain, lookup_by_day_of_year
from marigrid.operators.windows import detrended, rolling_mean
from marigrid.params import Compat


def residual(levels: DataFrame, tides: DataFrame, mean_level: DataFrame, keys: Sequence[str] = ("time", "stn")) -> DataFrame:
    """ntr = twl - tides - msl; rows that lack any go."""
    return left_chain([levels, tides, mean_level], keys).withColumn("ntr", F.col("twl") - F.col("tides") - F.col("msl")).dropna(subset=["ntr"])


def day_of_year_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str], half: int = 15, time: str = "time", neighbours: int = 0, cell: Sequence[str] = ("x", "y")) -> DataFrame:
    """Count, mean and population deviation by day of year over all rows within ``half`` rows, pooled over the years.

    Row sums and squares roll along each series, about the values' rough centers (one aggregate for all); sums by day then
    divide, so no window is ever laid out. With ``neighbours``, a cell's window also holds the cells up to so many steps
    of the grid away in either direction (W2): sums by cell and day are added up, not rows. Cells outside the grid
    count as missing.
    """
    rough = df.agg(*(F.avg(v).alias(v) for v in values)).first()
    about = {v: F.lit(float(rough[v] or 0.0)) for v in values}
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-half, half)
    rows = df.withColumn("dayofyear", F.dayofyear(time))
    for v in values:
        off = F.col(v) - about[v]
        rows = rows.withColumns({f"__n_{v}": F.count(v).over(w), f"__s_{v}": F.sum(off).over(w), f"__q_{v}": F.sum(off * off).over(w)})
    names = [f"__{k}_{v}" for v in values for k in "nsq"]
    sums = rows.groupBy(*keys, "dayofyear").agg(*(F.sum(c).alias(c) for c in names))
    if neighbours:
        steps = df.sparkSession.range(-neighbours, neighbours + 1).withColumnRenamed("id", "__step")
        for axis in cell:
            # the grid's axes are small: positions of their distinct values
            axes = df.select(axis).distinct().withColumn("__at", F.row_number().over(Window.orderBy(axis)))
            near = axes.crossJoin(steps).select(F.col(axis).alias("__from"), (F.col("__at") + F.col("__step")).alias("__at")).join(axes.withColumnRenamed(axis, "__to"), "__at").select("__from", "__to")
            others = [k for k in keys if k != axis]
            sums = sums.join(F.broadcast(near), F.col(axis) == F.col("__from")).groupBy(*others, F.col("__to").alias(axis), "dayofyear").agg(*(F.sum(c).alias(c) for c in names))
    stats: list[Column] = []
    for v in values:
        n, s, q = (F.col(f"__{k}_{v}") for k in "nsq")
        stats += [n.alias(f"{v}_n"), (s / n + about[v]).alias(f"{v}_mean"), F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0))).alias(f"{v}_std")]
    return sums.select(*keys, "dayofyear", *stats)


def bias_corrected(df: DataFrame, hist: DataFrame, obs: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "time") -> DataFrame:
    """(v - (mean_hist - mean_obs)) / (std_hist / std_obs) by day of year; null where either deviation is 0."""
    both = hist.select(*keys, "dayofyear", *(F.col(f"{v}_{s}").alias(f"__h_{v}_{s}") for v in values for s in ("mean", "std"))).join(
        obs.select(*keys, "dayofyear", *(F.col(f"{v}_{s}").alias(f"__o_{v}_{s}") for v in values for s in ("mean", "std"))), [*keys, "dayofyear"]
    )
    out = lookup_by_day_of_year(df, both, keys, time)
    fixed = {v: quotient(F.col(v) - (F.col(f"__h_{v}_mean") - F.col(f"__o_{v}_mean")), quotient(F.col(f"__h_{v}_std"), F.col(f"__o_{v}_std"))) for v in values}
    return out.withColumns({f"{v}_corrected": c for v, c in fixed.items()}).select(*df.columns, *(f"{v}_corrected" for v in values))


def high_frequency(df: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """``ntr_hf`` and ``extrap_hf`` from winds and pressure (raw and ``_corrected``) and the day's regression.

    The stored rule takes one raw wind in tauu, and the slope of tauu for tauv; the flags give the plain readings.
    """
    u, v = F.col("uas_corrected"), F.col("vas_corrected")
    tauu = stress(u) if compat.tauu_corrected else F.signum(u) * u * F.col("uas")
    z = {"tauu": tauu, "tauv": stress(v), "slp": F.col("psl_corrected")}
    out = df.withColumns({n: c for n, c in z.items()})
    stan = {n: standardised(F.col(n), F.col(f"z_mean_{n}"), F.col(f"z_std_{n}")) for n in z}
    slope = {"tauu": "m_tauu", "tauv": "m_tauv" if compat.tauv_own_slope else "m_tauu", "slp": "m_slp"}
    total = reduce(lambda a, b: a + b, (F.col(slope[n]) * stan[n] for n in z)) + F.col("b")
    outside = reduce(lambda a, b: a | b, (extrapolated(F.col(n), F.col(f"min_{n}"), F.col(f"max_{n}"), compat.extrapolated_either_side) for n in z))
    return out.withColumns({"ntr_hf": total, "extrap_hf": outside})


def low_frequency(df: DataFrame) -> DataFrame:
    """``ntr_lf`` from the climate index and the day's slope and intercept."""
    return df.withColumn("ntr_lf", F.col("m_lf") * F.col("nino34") + F.col("b_lf"))


def regional_index(df: DataFrame, value: str, observed_std: float, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Spatial mean by month, detrended, centred, five-row mean, rescaled to the observed deviation."""
    month = F.date_trunc("month", F.col(time)).cast("timestamp_ntz")
    means = df.groupBy(*keys, month.alias("time")).agg(F.avg(value).alias("v"))
    flat = detrended(means, keys, "time", "v")
    whole = Window.partitionBy(*keys)
    centred = flat.withColumn("c", F.col("detrended") - F.avg("detrended").over(whole))
    smooth = centred.withColumn("s", rolling_mean("c", keys, "time", 4)).dropna(subset=["s"])
    return smooth.select(*keys, "time", quotient(F.col("s") * observed_std, F.stddev_pop("s").over(whole)).alias("index"))


def datum_mean(df: DataFrame, keys: Sequence[str], value: str, first: str = "1983-01-01", last: str = "2001-12-30", time: str = "time") -> DataFrame:
    """A5: mean over the datum epoch."""
    return df.filter(in_dates(F.col(time), first, last)).groupBy(*keys).agg(F.avg(value).alias("datum"))


def mean_level(cube: DataFrame, thermal_ice: DataFrame) -> DataFrame:
    """From (x, y, time, zos, zostoga) and yearly (year, te, im): ice_melt, zostoga_plus_ice_melt and msl.

    All series are shifted by their least value m before their ratio is taken; a year whose te is m has no ratio (null).
    m is one row.
    """
    low = cube.agg(F.min("zostoga").alias("a")).crossJoin(thermal_ice.agg(F.min("te").alias("b"), F.min("im").alias("c"))).select(F.least("a", "b", "c").alias("m"))
    ratio = thermal_ice.crossJoin(F.broadcast(low)).select("year", "m", quotient(F.col("im") - F.col("m"), F.col("te") - F.col("m")).alias("r"))
    z = F.col("zostoga") - F.col("m")
    rows = cube.withColumn("year", F.year("time")).join(ratio, "year").withColumn("ice_melt", z * F.col("r") + F.col("m")).withColumn("zostoga", z)
    rows = rows.withColumn("zostoga_plus_ice_melt", F.col("zostoga") + F.col("ice_melt") + F.col("m"))
    return rows.withColumn("msl", F.col("zostoga_plus_ice_melt") + F.col("zos")).select("x", "y", "time", "zos", "zostoga", "ice_melt", "zostoga_plus_ice_melt", "msl")


def total_level(tides: DataFrame, ntr: DataFrame, msl: DataFrame, keys: Sequence[str] = ("x", "y", "time")) -> DataFrame:
    """twl = msl + tides + ntr where all three are."""
    return tides.join(ntr, list(keys)).join(msl, list(keys)).withColumn("twl", F.col("msl") + F.col("tides") + F.col("ntr"))


def shifted_parameters(df: DataFrame, family: str) -> DataFrame:
    """``hourly_cmip`` from hourly_obs, daily_obs and daily_cmip: loc by difference, scale by ratio, shapes in a transformed scale."""
    param = F.col("param")

    def limited(c: Column) -> Column:
        out = c
        for (fam, name), (low, high) in LIMITS.items():
            if fam == family:
                out = F.when(param == name, clip(c, low, high)).otherwise(out)
        return out

    rows = df.withColumns({c: limited(F.col(c)) for c in ("hourly_obs", "daily_obs", "daily_cmip")})
    oh, od, cd = (F.col(c) for c in ("hourly_obs", "daily_obs", "daily_cmip"))
    shift = F.when(param == "loc", oh + cd - od).when(param == "scale", quotient(oh * cd, od)).when(param == "a", F.sinh(F.asinh(oh) + F.asinh(cd) - F.asinh(od))).when(param == "df", F.exp(F.ln(oh) + F.ln(cd) - F.ln(od)))
    return rows.withColumn("hourly_cmip", shift).withColumn("hourly_cmip", F.bround(limited(F.col("hourly_cmip")), 4))


def probability_ratio(natural: DataFrame, actual: DataFrame, keys: Sequence[str], worlds: Sequence[str] = ()) -> DataFrame:
    """(worlds, keys, level, pct, q, p1, ratio, far): the actual chance of the natural quantiles, in each of the actual worlds.

    Both are quantile tables; the actual one becomes two arrays of one row a key, read by interpolation.
    """
    table = actual.groupBy(*worlds, *keys).agg(F.array_sort(F.collect_list(F.struct("q", "pct"))).alias("t"))  # 102 points
    p1 = interpolate(F.col("q"), F.col("t.q"), F.col("t.pct"))
    rows = natural.join(table, list(keys)).withColumn("p1", p1)
    return rows.select(*worlds, *keys, "level", "pct", "q", "p1", quotient(F.col("p1"), F.col("pct")).alias("ratio"), (1 - quotient(F.col("pct"), F.col("p1"))).alias("far"))


def percent_change(table: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change of each quantile against the base, by level; null where the base is 0."""
    return table.join(base.select(*keys, "level", F.col("q").alias("base_q")), [*keys, "level"]).withColumn("change", quotient(100 * (F.col("q") - F.col("base_q")), F.col("base_q")))


def baseline_kept(df: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value", year: str = "year") -> DataFrame:
    """The median of the baseline's years, ``first`` to ``last``, for every year from ``last`` on.

    A series that begins with ``last`` or later has no baseline and is 0 throughout. One that has years before but
    none within the baseline is null from ``last`` on.
    """
    inside = F.when(F.col(year).between(first, last), F.col(value))
    base = df.groupBy(*keys).agg(F.percentile(inside, F.lit(0.5)).alias("__m"), F.min(year).alias("__first"))
    kept = F.when(F.col("__first") >= last, F.lit(0.0)).when(F.col(year) >= last, F.col("__m")).otherwise(F.col(value))
    return df.join(base, list(keys)).withColumn(value, kept).drop("__m", "__first")


def scenario_period(df: DataFrame, start: int, split: int = 2015, time: str = "time", exp: str = "exp") -> DataFrame:
    """Histories from ``start`` on; scenarios as long after ``split`` as ``start`` is before it."""
    last = F.make_timestamp_ntz(F.lit(2 * split - start), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return df.filter(F.when(F.col(exp).startswith("hist"), F.year(time) >= start).otherwise(F.col(time) <= last))


#: R35, fixed values: columns of an emission file in their order, names that differ from the database's, and factors of units.
SPECIES = "FossilCO2 OtherCO2 CH4 N2O SOx CO NMVOC NOx BC OC NH3 CF4 C2F6 C6F14 HFC23 HFC32 HFC43-10 HFC125 HFC134a HFC143a HFC227ea HFC245fa SF6".split()
RENAMED = {"CO2": "OtherCO2", "CO2|MAGICC Fossil and Industrial": "FossilCO2", "HFC4310mee": "HFC43-10", "Sulfur": "SOx", "VOC": "NMVOC"}
UNITS = {"FossilCO2": 12 / 44000, "N2O": 28 / (28 + 16) / 1000, "SOx": 32 / 64, "NOx": 14 / 30, "NH3": 14 / 17}


def emission_table(df: DataFrame, years: Sequence[str]) -> DataFrame:
    """(year, a column for each species) from rows (stage, variable, a column for each year) of one scenario.

    Clean rows only; total carbon dioxide becomes the part that isn't fossil; species without rows are null.
    """
    long = df.filter("stage = 'clean'").unpivot(["variable"], list(years), "year", "value")
    short = F.regexp_replace("variable", r"^Emissions\|", "")
    names = F.create_map(*(F.lit(n) for pair in RENAMED.items() for n in pair))
    rows = long.select(F.col("year").cast("int").alias("year"), F.coalesce(F.try_element_at(names, short), short).alias("species"), "value").filter(F.col("species").isin(SPECIES))
    wide = rows.groupBy("year").pivot("species", SPECIES).agg(F.avg("value"))
    other = (F.col("OtherCO2") - F.col("FossilCO2")) / 1000
    return wide.select("year", *(other.alias(s) if s == "OtherCO2" else (F.col(f"`{s}`") * UNITS.get(s, 1.0)).alias(s) for s in SPECIES))


#: R35, fixed values: what stands in the file's first lines and the units below the species' names.
SCENARIO_LINES = [" 11", None, " Description line 1", " Description line 2", "", " WORLD"]
UNIT_NAMES = "GtC GtC MtCH4 MtN2O-N MtS MtCO Mt MtN Mt Mt MtN kt kt kt kt kt kt kt kt kt kt kt kt".split()


def emission_lines(table: DataFrame, label: str) -> DataFrame:
    """(part, year, line) of a scenario's file in fixed width; its lines stand in the order of part and year.

    ``table`` is that of ``emission_table``. Years take 11 characters, species a blank and at least 10 with 4 decimals, halves away from zero; a
    missing value is "nan". Part 0 is the number of years, 1 to 8 the lines above the rows, 9 the rows, 10 the two empty
    lines below. Without rows the number is 0. Only rows are formatted in tasks; nothing is sorted here.
    """
    wide = lambda names: "".join(f"{n:>11}" for n in names)
    fixed = [f" {label}" if one is None else one for one in SCENARIO_LINES]
    above = [*fixed, wide(["YEARS", *SPECIES]), wide(["Yrs", *UNIT_NAMES])]
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    number = lambda c: F.concat(F.lit(" "), F.when(known(c), F.format_string("%10.4f", F.round(c, 4))).otherwise(f"{'nan':>10}"))
    rows = table.select(F.lit(9).alias("part"), "year", F.concat(F.format_string("%11d", "year"), *(number(F.col(f"`{s}`")) for s in SPECIES)).alias("line"))
    count = table.agg(F.count_distinct("year").alias("n")).select(F.lit(0).alias("part"), F.lit(None).cast("int").alias("year"), F.concat(F.lit(" "), F.col("n").cast("string")).alias("line"))
    rest = table.sparkSession.createDataFrame([*((i, None, one) for i, one in enumerate(above, 1)), (10, None, ""), (10, None, "")], "part int, year int, line string")
    return rows.unionByName(count).unionByName(rest)
