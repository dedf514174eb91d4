"""Queries: aggregates, windows, grids, statistics and the domain's chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marigrid.functions import scalar
from marigrid.functions.scalar import burr_acf, fgn_acf, pareto_acf, stress, transformation_curve, weibull_acf
from marigrid.operators import acf, disagg, grid, interpolate, resample, stats, windows
from marigrid.operators.homogeneity import homogeneity as homogeneity_of
from marigrid.operators.joins import lookup_by_month_day
from marigrid.params import Compat, Window
from marigrid.plans import chain, water
from marigrid.plans.registry import Tables, query, rounded

YEARS = Window(1996, 2000, 30)


@query("daily_resample", "SELECT user_id AS stn, date_trunc('day', ts) AS time, round(avg(value), 6) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def daily_resample(t: Tables) -> DataFrame:
    """A1, A2."""
    rows = t.events.filter("event_type = 'view'").select(F.col("user_id").alias("stn"), F.col("ts").alias("time"), "value")
    return rounded(resample.to_step(rows, ["stn"], ["value"]), 6, "value")


@query("monthly_resample", "SELECT x, y, date_trunc('month', time) + INTERVAL 15 DAY AS time, round(avg(value), 7) AS value FROM daily GROUP BY ALL", "daily")
def monthly_resample(t: Tables) -> DataFrame:
    """A3."""
    return rounded(resample.to_step(t.daily, ["x", "y"], ["value"], "month", shift="15 DAYS"), 7, "value")


@query("spatial_mean", "SELECT time, round(avg(value), 4) AS value FROM (SELECT date_trunc('month', time) AS time, x, y, avg(value) AS value FROM daily GROUP BY ALL) GROUP BY 1", "daily")
def spatial_mean(t: Tables) -> DataFrame:
    """A4: cells count alike."""
    cells = resample.to_step(t.daily, ["x", "y"], ["value"], "month")
    return cells.groupBy("time").agg(F.round(F.avg("value"), 4).alias("value"))


@query("datum_mean", "SELECT x, y, round(avg(value), 4) AS datum FROM daily WHERE time >= TIMESTAMP '1995-06-01' AND time < TIMESTAMP '1999-12-31' GROUP BY ALL", "daily")
def datum_mean(t: Tables) -> DataFrame:
    """A5, P6."""
    return rounded(water.datum_mean(t.daily, ["x", "y"], "value", "1995-06-01", "1999-12-30"), 4, "datum")


@query("sum_by_time", "SELECT l_shipdate AS time, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def sum_by_time(t: Tables) -> DataFrame:
    """A8."""
    return t.lineitem.groupBy(F.col("l_shipdate").alias("time")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("baseline_median", "WITH s AS (SELECT priority, year(time) + CASE WHEN priority = '5-LOW' THEN 10 ELSE 0 END AS year, avg(value) AS value FROM daily GROUP BY ALL), m AS (SELECT priority, min(year) AS y0, quantile_cont(value, 0.5) FILTER (year BETWEEN 1997 AND 1999) AS m FROM s GROUP BY 1) SELECT priority, year, round(CASE WHEN y0 >= 1999 THEN 0 WHEN year >= 1999 THEN m ELSE value END, 4) AS value FROM s JOIN m USING (priority)", "daily")
def baseline_median(t: Tables) -> DataFrame:
    """A9. One priority's years are moved past the baseline, to show the branch without one."""
    year = F.year("time").cast("long") + F.when(F.col("priority") == "5-LOW", 10).otherwise(0)
    s = t.daily.groupBy("priority", year.alias("year")).agg(F.avg("value").alias("value"))
    return rounded(water.baseline_kept(s, ["priority"], 1997, 1999), 4, "value").select("priority", "year", "value")


@query("standardize", "SELECT l_suppkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def standardize(t: Tables) -> DataFrame:
    """A10, A12."""
    v = "l_extendedprice"
    return t.lineitem.groupBy("l_suppkey").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"))


@query("missing_counts", "SELECT x, y, sum(CASE WHEN value < 100000 THEN 1 ELSE 0 END)::BIGINT AS missing, count(*) AS n, count(DISTINCT time) AS times FROM daily GROUP BY ALL", "daily")
def missing_counts(t: Tables) -> DataFrame:
    """A13, A14, A19."""
    gone = t.daily.withColumn("value", F.when(F.col("value") >= 100000, F.col("value")))
    return gone.groupBy("x", "y").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"), F.count_distinct("time").alias("times"))


@query("model_mean", "SELECT x, y, round(avg(m), 4) AS value FROM (SELECT priority, x, y, CASE WHEN count(*) > 20 THEN avg(value) END AS m FROM daily GROUP BY ALL) GROUP BY ALL", "daily")
def model_mean(t: Tables) -> DataFrame:
    """Models without a value are left out."""
    models = t.daily.groupBy("priority", "x", "y").agg(F.when(F.count(F.lit(1)) > 20, F.avg("value")).alias("m"))
    return models.groupBy("x", "y").agg(F.round(F.avg("m"), 4).alias("value"))


QUANTILES = "SELECT status, x, y, unnest(range(102)) AS level, unnest(quantile_cont(value, [i / 100.0 FOR i IN range(1, 99)] || [0.999, 0.9999, 0.99999, 1.0])) AS q FROM daily GROUP BY status, x, y"


@query("quantile_table", f"SELECT status, x, y, level, round(q, 7) AS q FROM ({QUANTILES})", "daily")
def quantile_table(t: Tables) -> DataFrame:
    """A11."""
    return rounded(stats.quantile_table(t.daily, ["status", "x", "y"], "value").select("status", "x", "y", F.col("level").cast("long").alias("level"), "q"), 7, "q")


@query("quantile_select", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [i / 100.0 FOR i IN range(1, 99)] || [0.999, 0.9999, 0.99999, 1.0]) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, unnest(range(102)) AS level, round(unnest(q), 6) AS q FROM q")
def quantile_select(t: Tables) -> DataFrame:
    """A11 of few large groups, by selection."""
    out = stats.select_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return rounded(out.select("l_returnflag", F.col("level").cast("long").alias("level"), "q"), 6, "q")


@query(
    "probability_ratio",
    f"""
WITH q AS (SELECT *, ([i / 100.0 FOR i IN range(1, 99)] || [0.999, 0.9999, 0.99999, 1.0])[level + 1]::DOUBLE AS pct FROM ({QUANTILES})),
o AS (SELECT status, x, y, q, pct, lead(q) OVER w AS q1, lead(pct) OVER w AS pct1, first_value(q) OVER (PARTITION BY status, x, y ORDER BY level) AS low, last_value(q) OVER (PARTITION BY status, x, y ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS high
      FROM q WHERE status <> 'F' WINDOW w AS (PARTITION BY status, x, y ORDER BY level)),
b AS (SELECT o.status, n.x, n.y, n.level, n.pct, CASE WHEN n.q <= max(o.low) THEN 0.01 WHEN n.q >= max(o.high) THEN 1.0 ELSE max(o.pct + (o.pct1 - o.pct) * (n.q - o.q) / (o.q1 - o.q)) FILTER (o.q <= n.q AND o.q1 > n.q) END AS p1
      FROM q n JOIN o ON n.x = o.x AND n.y = o.y WHERE n.status = 'F' GROUP BY o.status, n.x, n.y, n.level, n.pct, n.q)
SELECT status, x, y, level, round(p1 / pct, 5) AS ratio, round(1 - pct / p1, 5) + 0.0 AS far FROM b
""",
    "daily",
)
def probability_ratio(t: Tables) -> DataFrame:
    """The other statuses against F."""
    q = stats.quantile_table(t.daily, ["status", "x", "y"], "value")
    out = water.probability_ratio(q.filter("status = 'F'").drop("status"), q.filter("status <> 'F'"), ["x", "y"], ["status"])
    out = rounded(out.select("status", "x", "y", F.col("level").cast("long").alias("level"), "ratio", "far"), 5, "ratio", "far")
    return out.withColumn("far", F.col("far") + 0.0)


@query("percent_change", f"WITH q AS ({QUANTILES}) SELECT o.status, o.x, o.y, o.level, round(100 * (o.q - f.q) / f.q, 5) AS change FROM q o JOIN q f ON o.x = f.x AND o.y = f.y AND o.level = f.level WHERE o.status <> 'F' AND f.status = 'F'", "daily")
def percent_change(t: Tables) -> DataFrame:
    """The other statuses against F."""
    q = stats.quantile_table(t.daily, ["status", "x", "y"], "value")
    out = water.percent_change(q.filter("status <> 'F'"), q.filter("status = 'F'"), ["x", "y"])
    return rounded(out.select("status", "x", "y", F.col("level").cast("long").alias("level"), "change"), 5, "change")


ROLL = "SELECT user_id AS stn, date_trunc('day', ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2"


def _station_days(t: Tables) -> DataFrame:
    return resample.to_step(t.events.select(F.col("user_id").alias("stn"), F.col("ts").alias("time"), "value"), ["stn"], ["value"])


@query("rolling_trailing", f"SELECT stn, time, CASE WHEN count(*) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS mean FROM ({ROLL}) WINDOW w AS (PARTITION BY stn ORDER BY time ROWS 4 PRECEDING)")
def rolling_trailing(t: Tables) -> DataFrame:
    """W1, W3."""
    return _station_days(t).select("stn", "time", F.round(windows.rolling_mean("value", ["stn"], "time", 4), 6).alias("mean"))


@query("rolling_centered", f"SELECT stn, time, round(avg(value) OVER (PARTITION BY stn ORDER BY time ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 9) AS mean FROM ({ROLL})")
def rolling_centered(t: Tables) -> DataFrame:
    """W2."""
    return _station_days(t).select("stn", "time", F.round(windows.rolling_mean("value", ["stn"], "time", 15, 15, full=False), 9).alias("mean"))


@query("low_high_split", f"WITH s AS (SELECT stn, time, value, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS low FROM ({ROLL}) WINDOW w AS (PARTITION BY stn ORDER BY time ROWS 6 PRECEDING)) SELECT stn, time, round(low, 6) AS low, round(value - low, 6) AS high FROM s")
def low_high_split(t: Tables) -> DataFrame:
    """R6, each series on its own."""
    return rounded(resample.low_and_high(_station_days(t), ["stn"], "value", 7, by_group=True).select("stn", "time", "low", "high"), 6, "low", "high")


@query("low_high_end_to_end", f"WITH s AS (SELECT stn, time, value, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS low FROM ({ROLL}) WINDOW w AS (ORDER BY stn, time ROWS 6 PRECEDING)) SELECT stn, time, round(low, 6) AS low, round(value - low, 6) AS high FROM s")
def low_high_end_to_end(t: Tables) -> DataFrame:
    """R6 as stored: series laid end to end."""
    return rounded(resample.low_and_high(_station_days(t), ["stn"], "value", 7, by_group=False).select("stn", "time", "low", "high"), 6, "low", "high")


@query("ecdf_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) / (count(*) OVER (PARTITION BY event_type) + 1) AS ecdf FROM events")
def ecdf_rank(t: Tables) -> DataFrame:
    """W4."""
    return stats.ecdf(t.events, ["event_type"], "value").select("event_id", "ecdf")


@query("group_rank", "SELECT stn, rank() OVER (PARTITION BY floor(lat) ORDER BY lon * lon + lat * lat, stn) AS rank FROM stations", "stations")
def group_rank(t: Tables) -> DataFrame:
    """W5."""
    w = W.partitionBy(F.floor("lat")).orderBy(F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat"), "stn")
    return t.stations.select("stn", F.rank().over(w).cast("long").alias("rank"))


@query("gap_periods", "WITH s AS (SELECT stn, lag(time) OVER (PARTITION BY stn ORDER BY time) AS a, time AS b FROM view_h), h AS (SELECT *, (epoch(b) - epoch(a)) / 3600 AS hours FROM s WHERE a IS NOT NULL) SELECT stn, a AS \"start\", b AS stop, hours FROM h QUALIFY hours > min(hours) OVER (PARTITION BY stn)", "view")
def gap_periods(t: Tables) -> DataFrame:
    """W6."""
    return windows.gaps(t.hourly("view", "v"), ["stn"])


@query("sessionize", "WITH s AS (SELECT user_id, ts, ts - lag(ts) OVER w > INTERVAL 12 HOUR AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts), 0) AS segment FROM s) SELECT user_id, segment::BIGINT AS segment, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY ALL")
def sessionize(t: Tables) -> DataFrame:
    """W7."""
    rows = windows.sessions(t.events.select("user_id", F.col("ts").alias("time")), ["user_id"], 12)
    return rows.groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("n"))


LAGS = "WITH s AS (SELECT user_id % 10 AS stn, ts, event_id, value FROM events), p AS (SELECT a.stn, k AS lag, a.value AS a, b.value AS b FROM (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY ts, event_id) AS i FROM s) a, range(1, 13) r(k), (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY ts, event_id) AS i FROM s) b WHERE a.stn = b.stn AND b.i = a.i + k)"


@query("lag_pairs_corr", f"{LAGS} SELECT stn, lag, round(corr(a, b), 6) AS acf, count(*) AS n FROM p GROUP BY ALL")
def lag_pairs_corr(t: Tables) -> DataFrame:
    """W8, A18."""
    rows = t.events.select((F.col("user_id") % 10).alias("stn"), F.struct("ts", "event_id").alias("at"), "value")
    return windows.lag_pairs(rows, ["stn"], "at", "value", 12).groupBy("stn", F.col("lag").cast("long").alias("lag")).agg(F.round(F.corr("a", "b"), 6).alias("acf"), F.count(F.lit(1)).alias("n"))


@query("prefix_until_negative", f"{LAGS}, c AS (SELECT stn, lag, corr(a, b) AS acf FROM p GROUP BY ALL) SELECT stn, lag, round(acf, 6) AS acf FROM c QUALIFY max((acf < 0)::INT) OVER (PARTITION BY stn ORDER BY lag) = 0")
def prefix_until_negative(t: Tables) -> DataFrame:
    """W9."""
    rows = t.events.select((F.col("user_id") % 10).alias("stn"), F.struct("ts", "event_id").alias("at"), "value")
    c = windows.lag_pairs(rows, ["stn"], "at", "value", 12).groupBy("stn", F.col("lag").cast("long").alias("lag")).agg(F.corr("a", "b").alias("acf"))
    return rounded(windows.until_negative(c, ["stn"], "lag", "acf"), 6, "acf")


@query("detrend", f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY time)::DOUBLE AS i FROM ({ROLL})), r AS (SELECT stn, regr_slope(value, i) AS m, regr_intercept(value, i) AS b FROM s GROUP BY 1) SELECT stn, time, round(value - m * i - b, 6) AS detrended FROM s JOIN r USING (stn)")
def detrend(t: Tables) -> DataFrame:
    """W10."""
    return rounded(windows.detrended(_station_days(t), ["stn"], "time", "value").select("stn", "time", "detrended"), 6, "detrended")


@query("cell_bounds", "WITH a AS (SELECT DISTINCT CAST(p_size * p_size AS DOUBLE) AS x FROM part), n AS (SELECT x, lag(x) OVER (ORDER BY x) AS p, lead(x) OVER (ORDER BY x) AS q FROM a) SELECT x, coalesce((x + p) / 2, x - (q - x) / 2) AS lo, coalesce((x + q) / 2, x + (x - p) / 2) AS hi FROM n")
def cell_bounds(t: Tables) -> DataFrame:
    """W12."""
    return grid.axis_bounds(t.part.select((F.col("p_size") * F.col("p_size")).cast("double").alias("x")), "x")


@query("window_cells", "WITH g AS (SELECT DISTINCT x, y FROM daily), s AS (SELECT max(m) AS d FROM (SELECT median(d) AS m FROM (SELECT DISTINCT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT x FROM g)) UNION ALL SELECT median(d) FROM (SELECT DISTINCT y - lag(y) OVER (ORDER BY y) AS d FROM (SELECT DISTINCT y FROM g)))) SELECT a.x, a.y, b.x AS near_x, b.y AS near_y FROM g a, g b, s WHERE abs(a.x - b.x) <= 1.5 * d AND abs(a.y - b.y) <= 1.5 * d", "daily")
def window_cells(t: Tables) -> DataFrame:
    """2.7: the cells of windows of three grids."""
    return grid.window_cells(t.daily, 3)


@query("grid_spacing", "SELECT median(d) AS spacing FROM (SELECT DISTINCT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT CAST(p_size * p_size AS DOUBLE) AS x FROM part)) WHERE d IS NOT NULL")
def grid_spacing(t: Tables) -> DataFrame:
    """A25."""
    return grid.spacing(t.part.select((F.col("p_size") * F.col("p_size")).cast("double").alias("x")), "x")


CENTERS = "d AS (SELECT CAST(u AS DATE) AS d FROM (SELECT unnest(generate_series(DATE '1980-01-01', DATE '1980-12-31', INTERVAL 1 DAY)) AS u)), c AS (SELECT strftime(d, '%m%d') AS center_day, CASE WHEN month(d) = 2 AND day(d) = 29 AND NOT (y % 4 = 0) THEN make_timestamp(y, 3, 1, 0, 0, 0) ELSE make_timestamp(y, month(d), day(d), 0, 0, 0) END AS center FROM d, range(1996, 2001) r(y))"


@query("window_instant", f"WITH {CENTERS}, w AS (SELECT DISTINCT center_day, center + to_days(CAST(k AS INTEGER)) AS t0 FROM c, range(-15, 16) r(k)) SELECT center_day, count(*) AS n, round(sum(value), 2) AS total, round(stddev_pop(value), 3) AS std FROM daily JOIN w ON time = t0 GROUP BY 1", "daily")
def window_instant(t: Tables) -> DataFrame:
    """W of 2.7, exact instants, through daily moments. The mean is shown as a sum, as means of cents often end in a 5 where they are rounded."""
    out = windows.pooled_moments(t.daily, YEARS, [], ["value"])
    return rounded(rounded(out.select("center_day", "n", (F.col("value_mean") * F.col("n")).alias("total"), F.col("value_std").alias("std")), 2, "total"), 3, "std")


FITS = f"WITH {CENTERS}, w AS (SELECT DISTINCT center_day, center + to_days(CAST(k AS INTEGER)) AS t0 FROM c, range(-15, 16) r(k)), p AS (SELECT center_day, l_returnflag, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem JOIN w ON l_shipdate = t0)"


@query("window_ols", f"{FITS} SELECT l_returnflag, center_day, round(regr_slope(l_extendedprice, l_quantity), 4) AS m, round(regr_intercept(l_extendedprice, l_quantity), 3) AS b, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(stddev_pop(l_quantity), 6) AS stdev, min(l_quantity) AS min_x, max(l_quantity) AS max_x, count(*) AS n FROM p GROUP BY ALL")
def window_ols(t: Tables) -> DataFrame:
    """2.7 with R2."""
    out = windows.window_ols(t.lineitem, YEARS, ["l_returnflag"], "l_quantity", "l_extendedprice", "l_shipdate")
    return rounded(rounded(rounded(rounded(out, 4, "m"), 3, "b"), 8, "r2"), 6, "stdev")


@query(
    "window_ols3",
    f"""
{FITS},
g AS (SELECT center_day, corr(l_quantity, l_discount) AS p, corr(l_quantity, l_tax) AS q, corr(l_discount, l_tax) AS r, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS c,
  sum(l_extendedprice) AS total, stddev_pop(l_extendedprice) AS s, count(*) AS n, avg(l_quantity) AS zm, stddev_pop(l_tax) AS zs FROM p GROUP BY 1),
h AS (SELECT *, 1 - r * r - p * (p - q * r) + q * (p * r - q) AS det FROM g),
e AS (SELECT *, (a * (1 - r * r) - p * (b - r * c) + q * (b * r - c)) / det AS u, ((b - r * c) - a * (p - q * r) + q * (p * c - b * q)) / det AS v, ((c - b * r) - p * (p * c - b * q) + a * (p * r - q)) / det AS w FROM h)
SELECT center_day, round(u * s, 3) AS m_l_quantity, round(v * s, 3) AS m_l_discount, round(w * s, 3) AS m_l_tax, round(total, 2) AS b_times_n, round(u * a + v * b + w * c, 6) AS r2, n, round(zm, 6) AS z_mean_l_quantity, round(zs, 8) AS z_std_l_tax FROM e
""",
)
def window_ols3(t: Tables) -> DataFrame:
    """2.7 with R1: the source's central fit. The intercept, a mean of cents, is shown as a sum."""
    out = windows.window_ols3(t.lineitem, YEARS, [], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_shipdate")
    slopes = ["m_l_quantity", "m_l_discount", "m_l_tax"]
    out = out.select("center_day", *slopes, (F.col("b") * F.col("n")).alias("b_times_n"), "r2", "n", "z_mean_l_quantity", "z_std_l_tax")
    return rounded(rounded(rounded(rounded(out, 3, *slopes), 2, "b_times_n"), 6, "r2", "z_mean_l_quantity"), 8, "z_std_l_tax")


@query(
    "window_acf",
    f"""
WITH {CENTERS},
s AS (SELECT status, time, sum(value) AS v FROM daily GROUP BY ALL),
p AS (SELECT DISTINCT status, center_day, time, v FROM s JOIN c ON time BETWEEN center - INTERVAL 15 DAY AND center + INTERVAL 15 DAY),
g AS (SELECT *, row_number() OVER w AS i, lead(time) OVER w AS nxt, coalesce(time - lag(time) OVER w > INTERVAL 48 HOUR, false) AS new FROM p WINDOW w AS (PARTITION BY status, center_day ORDER BY time)),
h AS (SELECT *, sum(new::INT) OVER (PARTITION BY status, center_day ORDER BY time) AS seg FROM g),
e AS (SELECT status, center_day, seg, v, row_number() OVER (PARTITION BY status, center_day, seg ORDER BY time) AS j FROM h WHERE i > 1 AND (nxt IS NULL OR nxt - time <= INTERVAL 48 HOUR)),
r AS (SELECT a.status, a.center_day, b.j - a.j AS lag, corr(a.v, b.v) AS acf, count(*) AS pairs FROM e a JOIN e b ON a.status = b.status AND a.center_day = b.center_day AND a.seg = b.seg AND b.j > a.j AND b.j <= a.j + 6 GROUP BY ALL)
SELECT status, center_day, lag, round(acf, 6) AS acf, pairs FROM r WHERE acf IS NOT NULL AND NOT isnan(acf) QUALIFY max((acf < 0)::INT) OVER (PARTITION BY status, center_day ORDER BY lag) = 0
""",
    "daily",
)
def window_acf(t: Tables) -> DataFrame:
    """2.7 with R18: empirical autocorrelation in all annual windows, from moments by day and lag."""
    days = t.daily.groupBy("status", "time").agg(F.sum("value").alias("value"))
    out = acf.window_acf(days, YEARS, ["status"], ["status"], "value", 6)
    return out.select("status", "center_day", F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"), "pairs")


@query("window_interval", f"WITH {CENTERS}, s AS (SELECT ROW_NUMBER() OVER () AS id, time + INTERVAL 12 HOUR AS time, value FROM daily) SELECT center_day, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT DISTINCT center_day, id, value FROM s JOIN c ON time BETWEEN center - INTERVAL 15 DAY AND center + INTERVAL 15 DAY) GROUP BY 1", "daily")
def window_interval(t: Tables) -> DataFrame:
    """2.7, closed intervals, each row once."""
    rows = t.daily.withColumn("time", F.col("time") + F.expr("INTERVAL 12 HOURS"))
    return windows.annual_window(rows, YEARS, match="interval").groupBy("center_day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("gap_fill", "WITH e AS (SELECT stn, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM view_h GROUP BY 1) SELECT stn, time, round(v, 6) AS v FROM e LEFT JOIN view_h USING (stn, time)", "view")
def gap_fill(t: Tables) -> DataFrame:
    """J15."""
    return rounded(resample.fill_gaps(t.hourly("view", "v"), ["stn"]), 6, "v")


@query("linear_interp_hourly", "WITH m AS (SELECT stn, date_trunc('day', time) AS time, avg(v) AS v FROM view_h GROUP BY ALL), n AS (SELECT *, lead(time) OVER w AS t1, lead(v) OVER w AS v1 FROM m WINDOW w AS (PARTITION BY stn ORDER BY time)), e AS (SELECT stn, v, time AS t0, t1, v1, unnest(generate_series(time, coalesce(t1 - INTERVAL 1 HOUR, time), INTERVAL 1 HOUR)) AS time FROM n) SELECT stn, time, round(CASE WHEN time = t0 THEN v ELSE v + (v1 - v) * (epoch(time) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 9) AS v FROM e", "view")
def linear_interp_hourly(t: Tables) -> DataFrame:
    """R9."""
    days = resample.to_step(t.hourly("view", "v"), ["stn"], ["v"])
    return rounded(resample.interpolate_linear(days, ["stn"], "v"), 9, "v")


@query("ols_simple", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS m, round(regr_intercept(l_extendedprice, l_quantity), 3) AS b, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(stddev_pop(l_quantity), 6) AS stdev, min(l_quantity) AS min_x, max(l_quantity) AS max_x, count(*) AS n FROM lineitem GROUP BY 1")
def ols_simple(t: Tables) -> DataFrame:
    """R2."""
    out = stats.ols(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(rounded(rounded(rounded(out, 4, "m"), 3, "b"), 8, "r2"), 6, "stdev")


@query("f_stat", "WITH r AS (SELECT l_suppkey, regr_r2(l_extendedprice, l_discount) AS r2, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, round(r2 / (1 - r2) * (n - 2), 6) AS f FROM r")
def f_stat(t: Tables) -> DataFrame:
    """R3."""
    out = stats.ols(t.lineitem, ["l_suppkey"], "l_discount", "l_extendedprice")
    return out.select("l_suppkey", "n", F.round(stats.f_statistic(F.col("r2"), F.col("n")), 6).alias("f"))


@query("f_p_value")
def f_p_value(t: Tables) -> DataFrame:
    """R3's p-value; no SQL here has the incomplete beta function, tests hold it against tables of F."""
    out = stats.ols(t.lineitem, ["l_suppkey"], "l_discount", "l_extendedprice")
    f = stats.f_statistic(F.col("r2"), F.col("n"))
    return out.select("l_suppkey", "n", f.alias("f"), stats.f_p_value(f, F.lit(1), F.col("n") - 2).alias("p"))


@query(
    "ols_three",
    """
WITH g AS (SELECT l_suppkey AS k, corr(l_quantity, l_discount) AS p, corr(l_quantity, l_tax) AS q, corr(l_discount, l_tax) AS r, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_tax, l_extendedprice) AS c,
  avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1),
h AS (SELECT *, 1 - r * r - p * (p - q * r) + q * (p * r - q) AS det FROM g),
e AS (SELECT *, (a * (1 - r * r) - p * (b - r * c) + q * (b * r - c)) / det AS u, ((b - r * c) - a * (p - q * r) + q * (p * c - b * q)) / det AS v, ((c - b * r) - p * (p * c - b * q) + a * (p * r - q)) / det AS w FROM h)
SELECT k AS l_suppkey, round(u * s, 3) AS m_l_quantity, round(v * s, 3) AS m_l_discount, round(w * s, 3) AS m_l_tax, round(mean, 3) AS b, round(u * a + v * b + w * c, 6) AS r2, n FROM e
""",
)
def ols_three(t: Tables) -> DataFrame:
    """R1."""
    out = stats.ols3(t.lineitem, ["l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    slopes = ["m_l_quantity", "m_l_discount", "m_l_tax"]
    return rounded(rounded(out.select("l_suppkey", *slopes, "b", "r2", "n"), 3, *slopes, "b"), 6, "r2")


@query(
    "fit_metrics",
    """
WITH s AS (SELECT l_suppkey AS k, l_quantity * 1500 AS s, l_extendedprice AS o FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY k ORDER BY o) + (count(*) OVER (PARTITION BY k, o) - 1) / 2 AS ro, avg(o) OVER (PARTITION BY k) AS m, avg(s) OVER (PARTITION BY k) AS ms FROM s)
SELECT k AS l_suppkey, round(sqrt(avg((s - o) ** 2)), 3) AS rmse, round(avg((s - o) ** 2) / 1e6, 6) AS mse, round(sqrt(sum((s - o) ** 2)), 3) AS ed, round(corr(s, o) ** 2, 8) AS r2, round(avg(abs(s - o)), 3) AS mae, round(sqrt(sum((o / m - s / ms) ** 2)), 6) AS ned, round(corr(s, o), 8) AS pearson, round(corr(rs, ro), 8) AS spearman,
  round(1 - sum((s - o) ** 2) / sum((o - m) ** 2), 6) AS nse, round(1 - sum(abs(s - o)) / sum(abs(o - m)), 6) AS nse_mod, round(1 - sum(((s - o) / o) ** 2) / sum(((o - m) / m) ** 2), 6) AS nse_rel,
  round(1 - sqrt((corr(s, o) - 1) ** 2 + (stddev_pop(s) / stddev_pop(o) - 1) ** 2 + (avg(s) / avg(o) - 1) ** 2), 6) AS kge_2009,
  round(1 - sqrt((corr(s, o) - 1) ** 2 + ((stddev_pop(s) / avg(s)) / (stddev_pop(o) / avg(o)) - 1) ** 2 + (avg(s) / avg(o) - 1) ** 2), 6) AS kge_2012, round(sum((s / o - 1) ** 2) / count(*), 6) AS relative_mse, count(*) AS n
FROM r GROUP BY 1
""",
)
def fit_metrics(t: Tables) -> DataFrame:
    """R4, R5."""
    rows = t.lineitem.select("l_suppkey", (F.col("l_quantity") * 1500).alias("sim"), F.col("l_extendedprice").alias("obs"))
    out = stats.fit_metrics(rows, ["l_suppkey"], "sim", "obs").withColumn("mse", F.col("mse") / 1e6)
    out = rounded(out, 8, "pearson", "spearman", "r2")
    return rounded(rounded(out, 6, "mse", "ned", "nse", "nse_mod", "nse_rel", "kge_2009", "kge_2012", "relative_mse"), 3, "rmse", "mae", "ed")


@query("l_moments", "WITH r AS (SELECT x, y, value AS v, row_number() OVER (PARTITION BY x, y ORDER BY value) AS i, count(*) OVER (PARTITION BY x, y) AS n FROM daily), b AS (SELECT x, y, avg(v) AS b0, avg((i - 1) / (n - 1) * v) AS b1, avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * v) AS b2, avg((i - 1) * (i - 2) * (i - 3) / ((n - 1) * (n - 2) * (n - 3)) * v) AS b3, count(*) AS n FROM r GROUP BY ALL) SELECT x, y, round(b0, 3) AS l1, round(2 * b1 - b0, 3) AS l2, round(6 * b2 - 6 * b1 + b0, 3) AS l3, round(20 * b3 - 30 * b2 + 12 * b1 - b0, 3) AS l4, n FROM b", "daily")
def l_moments(t: Tables) -> DataFrame:
    """A24."""
    return rounded(stats.l_moments(t.daily, ["x", "y"], "value"), 3, "l1", "l2", "l3", "l4")


@query("l_moment_dispersion", """
WITH r AS (SELECT status, x, y, value AS v, row_number() OVER (PARTITION BY status, x, y ORDER BY value) AS i, count(*) OVER (PARTITION BY status, x, y) AS n FROM daily),
b AS (SELECT status, x, y, avg(v) AS b0, avg((i - 1) / (n - 1) * v) AS b1, avg((i - 1) * (i - 2) / ((n - 1) * (n - 2)) * v) AS b2, avg((i - 1) * (i - 2) * (i - 3) / ((n - 1) * (n - 2) * (n - 3)) * v) AS b3, count(*) AS n FROM r GROUP BY ALL),
l AS (SELECT status, b0 AS l1, 2 * b1 - b0 AS l2, (2 * b1 - b0) / b0 AS t1, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) AS t4, n FROM b),
m AS (SELECT *, sum(t1 * n) OVER (PARTITION BY status) / sum(n) OVER (PARTITION BY status) AS a FROM l)
SELECT status, round(sum(l1 * n) / sum(n), 2) AS l1, round(sum(l2 * n) / sum(n), 3) AS l2, round(sum(t1 * n) / sum(n), 8) AS t1, round(sum(t3 * n) / sum(n), 8) AS t3, round(sum(t4 * n) / sum(n), 8) AS t4, sum(n)::BIGINT AS n, round(sum((t1 - a) ** 2 * n) / sum(n), 10) AS v FROM m GROUP BY 1
""", "daily")  # fmt: skip
def l_moment_dispersion(t: Tables) -> DataFrame:
    """Sites pooled by weight, and their spread."""
    sites = stats.l_moments(t.daily, ["status", "x", "y"], "value")
    out = rounded(rounded(stats.dispersion(sites, ["status"]), 2, "l1"), 3, "l2")
    return rounded(rounded(out, 8, "t1", "t3", "t4"), 10, "v")


DOY = """
s AS (SELECT x, y, date_trunc('day', time) AS time, avg(value) AS v, status FROM daily GROUP BY ALL),
r AS (SELECT status, x, y, dayofyear(time) AS doy, count(v) OVER w AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM s WINDOW w AS (PARTITION BY status, x, y ORDER BY time ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
p AS (SELECT status, x, y, doy, sum(s) / sum(n) AS mean, sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2, 0)) AS std FROM r GROUP BY ALL)
"""


def _doy(t: Tables) -> tuple[DataFrame, DataFrame]:
    days = resample.to_step(t.daily, ["status", "x", "y"], ["value"])
    return days, water.day_of_year_stats(days, ["status", "x", "y"], ["value"])


@query("doy_pooled_stats", "WITH s AS (SELECT status, x, y, date_trunc('day', time) AS time, sum(value) AS v FROM daily GROUP BY ALL), r AS (SELECT status, x, y, dayofyear(time) AS doy, v - 150000 AS v, row_number() OVER (PARTITION BY status, x, y ORDER BY time) AS i FROM s) SELECT a.status, a.x, a.y, a.doy AS dayofyear, count(*) AS n, round(sum(b.v + 150000), 2) AS total, round(stddev_pop(b.v), 4) AS std FROM r a JOIN r b ON a.status = b.status AND a.x = b.x AND a.y = b.y AND b.i BETWEEN a.i - 15 AND a.i + 15 GROUP BY ALL", "daily")
def doy_pooled_stats(t: Tables) -> DataFrame:
    """A7 on daily sums. The mean is shown as a sum, as means of cents often end in a 5 where they are rounded."""
    days = t.daily.groupBy("status", "x", "y", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.sum("value").alias("value"))
    out = water.day_of_year_stats(days, ["status", "x", "y"], ["value"])
    total = (F.col("value_mean") * F.col("value_n")).alias("total")
    return rounded(rounded(out.select("status", "x", "y", F.col("dayofyear").cast("long").alias("dayofyear"), F.col("value_n").alias("n"), total, F.col("value_std").alias("std")), 2, "total"), 4, "std")


@query("doy_spatial_stats", "WITH s AS (SELECT x, y, date_trunc('day', time) AS time, sum(value) AS v FROM daily GROUP BY ALL), r AS (SELECT x, y, dayofyear(time) AS doy, v - 150000 AS v, row_number() OVER (PARTITION BY x, y ORDER BY time) AS i FROM s), k AS (SELECT a.x, a.y, a.doy, b.v FROM r a JOIN r b ON a.x = b.x AND a.y = b.y AND b.i BETWEEN a.i - 15 AND a.i + 15), m AS (SELECT x, y, doy, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM k GROUP BY ALL), g AS (SELECT c.x, c.y, m.doy, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM (SELECT DISTINCT x, y FROM s) c JOIN m ON abs(c.x - m.x) <= 1 AND abs(c.y - m.y) <= 1 GROUP BY ALL) SELECT x, y, doy AS dayofyear, n::BIGINT AS n, round(s + n * 150000, 2) AS total, round(sqrt(q / n - (s / n) ** 2), 3) AS std FROM g", "daily")
def doy_spatial_stats(t: Tables) -> DataFrame:
    """Daily sums with those of the eight cells around."""
    days = t.daily.groupBy("x", "y", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.sum("value").alias("value"))
    out = water.day_of_year_stats(days, ["x", "y"], ["value"], neighbours=1)
    total = (F.col("value_mean") * F.col("value_n")).alias("total")
    return rounded(rounded(out.select("x", "y", F.col("dayofyear").cast("long").alias("dayofyear"), F.col("value_n").alias("n"), total, F.col("value_std").alias("std")), 2, "total"), 3, "std")


@query("bias_correct", f"WITH {DOY} SELECT s.status, s.x, s.y, s.time, round((v - (h.mean - o.mean)) / nullif(h.std / nullif(o.std, 0), 0), 1) AS corrected FROM s JOIN p h ON h.status = s.status AND h.x = s.x AND h.y = s.y AND h.doy = dayofyear(s.time) JOIN p o ON o.status = 'O' AND o.x = s.x AND o.y = s.y AND o.doy = h.doy WHERE s.status <> 'O'", "daily")
def bias_correct(t: Tables) -> DataFrame:
    """The other statuses towards O."""
    days, st = _doy(t)
    seen = st.filter("status = 'O'").withColumn("status", F.explode(F.array(F.lit("F"), F.lit("P"))))
    out = water.bias_corrected(days.filter("status <> 'O'"), st.filter("status <> 'O'"), seen, ["status", "x", "y"], ["value"])
    return out.select("status", "x", "y", "time", F.round("value_corrected", 1).alias("corrected"))


@query("regrid_conservative", "WITH v AS (SELECT x, y, date_trunc('month', time) AS time, avg(value) AS value FROM daily GROUP BY ALL), t(x, y) AS (SELECT a * 1.5 + 0.25, b * 1.5 + 0.25 FROM range(3) r(a), range(3) s(b)), w AS (SELECT g.x AS sx, g.y AS sy, t.x, t.y, (least(g.x + 0.5, t.x + 0.75) - greatest(g.x - 0.5, t.x - 0.75)) * (sin(radians(least(g.y + 0.5, t.y + 0.75))) - sin(radians(greatest(g.y - 0.5, t.y - 0.75)))) AS w FROM (SELECT DISTINCT x, y FROM daily) g, t WHERE g.x - 0.5 < t.x + 0.75 AND t.x - 0.75 < g.x + 0.5 AND g.y - 0.5 < t.y + 0.75 AND t.y - 0.75 < g.y + 0.5) SELECT w.x::DOUBLE AS x, w.y::DOUBLE AS y, time, round(sum(value * w) / sum(w), 3) AS value FROM v JOIN w ON v.x = sx AND v.y = sy GROUP BY ALL", "daily")
def regrid_conservative(t: Tables) -> DataFrame:
    """G1, J18."""
    v = resample.to_step(t.daily, ["x", "y"], ["value"], "month")
    side = t.spark.range(3).select((F.col("id") * 1.5 + 0.25).cast("double").alias("c"))
    target = side.select(F.col("c").alias("x")).crossJoin(side.select(F.col("c").alias("y")))
    return rounded(grid.regrid(v, grid.overlap_weights(grid.cells(t.grid), grid.cells(target)), "value"), 3, "value")


MSL = """
c AS (SELECT x, y, date_trunc('month', time) AS time, avg(value) / 1e6 AS zos, avg(CASE WHEN status = 'F' THEN value END) / 1e6 AS zostoga FROM daily GROUP BY ALL HAVING zostoga IS NOT NULL),
ti AS (SELECT year(l_shipdate) AS year, avg(l_discount) + 0.3 AS te, avg(l_tax) AS im FROM lineitem GROUP BY 1),
m AS (SELECT least((SELECT min(zostoga) FROM c), (SELECT min(te) FROM ti), (SELECT min(im) FROM ti)) AS m),
l AS (SELECT c.*, m, (im - m) / (te - m) AS r FROM c JOIN ti ON year(time) = year, m)
"""


def _msl(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "time").cast("timestamp_ntz")
    cube = t.daily.groupBy("x", "y", month.alias("time")).agg((F.avg("value") / 1e6).alias("zos"), (F.avg(F.when(F.col("status") == "F", F.col("value"))) / 1e6).alias("zostoga")).dropna(subset=["zostoga"])
    yearly = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg((F.avg("l_discount") + 0.3).alias("te"), F.avg("l_tax").alias("im"))
    return water.mean_level(cube, yearly)


@query("msl_monthly", f"WITH {MSL} SELECT x, y, time, round(zostoga - m, 11) AS zostoga, round((zostoga - m) * r + m, 11) AS ice_melt, round(zostoga - m + (zostoga - m) * r + m + m + zos, 11) AS msl FROM l", "daily")
def msl_monthly(t: Tables) -> DataFrame:
    """R13, A12."""
    return rounded(_msl(t).select("x", "y", "time", "zostoga", "ice_melt", "msl"), 11, "zostoga", "ice_melt", "msl")


@query("twl_sum", f"WITH {MSL}, n AS (SELECT x, y, date_trunc('month', time) AS time, max(value) / 1e6 AS ntr, min(value) / 1e6 AS tides FROM daily WHERE status = 'O' GROUP BY ALL) SELECT x, y, time, round(zostoga - m + (zostoga - m) * r + m + m + zos + tides + ntr, 7) AS twl FROM l JOIN n USING (x, y, time)", "daily")
def twl_sum(t: Tables) -> DataFrame:
    """R31, J7."""
    month = F.date_trunc("month", "time").cast("timestamp_ntz")
    other = t.daily.filter("status = 'O'").groupBy("x", "y", month.alias("time")).agg((F.max("value") / 1e6).alias("ntr"), (F.min("value") / 1e6).alias("tides"))
    return rounded(water.total_level(other.drop("ntr"), other.drop("tides"), _msl(t)).select("x", "y", "time", "twl"), 7, "twl")


NTR_SQL = """
d AS (SELECT l_shipdate AS time, l_orderkey AS k, l_linenumber AS j, l_quantity - 25 AS uas, (l_quantity - 25) * 0.9 AS ub, l_discount * 100 - 5 AS vb, l_extendedprice / 1000 AS pb, l_tax AS nino FROM lineitem),
p AS (SELECT strftime(time, '%m%d') AS md, avg(ub * abs(ub)) AS mu, stddev_pop(ub * abs(ub)) AS su, avg(vb * abs(vb)) AS mv, stddev_pop(vb * abs(vb)) AS sv, avg(pb) AS mp, stddev_pop(pb) AS sp FROM d GROUP BY 1)
"""


def _ntr(t: Tables, compat: Compat) -> DataFrame:
    u, v = (F.col("l_quantity") - 25) * 0.9, F.col("l_discount") * 100 - 5
    d = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.col("l_shipdate").alias("time"), (F.col("l_quantity") - 25).alias("uas"), u.alias("uas_corrected"), v.alias("vas_corrected"), (F.col("l_extendedprice") / 1000).alias("psl_corrected"), F.col("l_tax").alias("nino34"))
    z = {"tauu": F.col("uas_corrected") * F.abs("uas_corrected"), "tauv": F.col("vas_corrected") * F.abs("vas_corrected"), "slp": F.col("psl_corrected")}
    day = d.groupBy(F.date_format("time", "MMdd").alias("month_day")).agg(*(f(c).alias(f"{p}_{n}") for n, c in z.items() for p, f in (("z_mean", F.avg), ("z_std", F.stddev_pop), ("min", F.min), ("max", F.max))))
    day = day.withColumns({"m_tauu": F.lit(0.5), "m_tauv": F.lit(0.25), "m_slp": F.lit(-0.1), "b": F.lit(0.02), "m_lf": F.lit(2.0), "b_lf": F.lit(0.1)})
    return water.low_frequency(water.high_frequency(lookup_by_month_day(d, day), compat))


@query("ntr_linear", f"WITH {NTR_SQL} SELECT k, j, round(0.5 * (sign(ub) * uas * ub - mu) / su + 0.5 * (vb * abs(vb) - mv) / sv - 0.1 * (pb - mp) / sp + 0.02 + 2 * nino + 0.1, 5) AS ntr_total, false AS extrap_hf FROM d JOIN p ON strftime(time, '%m%d') = md WHERE su > 0 AND sv > 0 AND sp > 0")
def ntr_linear(t: Tables) -> DataFrame:
    """R12, F2, F3, F11 as stored."""
    rows = _ntr(t, Compat()).filter("z_std_tauu > 0 AND z_std_tauv > 0 AND z_std_slp > 0")
    return rows.select("k", "j", F.round(F.col("ntr_hf") + F.col("ntr_lf"), 5).alias("ntr_total"), "extrap_hf")


@query("ntr_corrected", f"WITH {NTR_SQL} SELECT k, j, round(0.5 * (ub * abs(ub) - mu) / su + 0.25 * (vb * abs(vb) - mv) / sv - 0.1 * (pb - mp) / sp + 0.02 + 2 * nino + 0.1, 5) AS ntr_total FROM d JOIN p ON strftime(time, '%m%d') = md WHERE su > 0 AND sv > 0 AND sp > 0")
def ntr_corrected(t: Tables) -> DataFrame:
    """R12 with the plain readings."""
    rows = _ntr(t, Compat(tauu_corrected=True, tauv_own_slope=True, extrapolated_either_side=True)).filter("z_std_tauu > 0 AND z_std_tauv > 0 AND z_std_slp > 0")
    return rows.select("k", "j", F.round(F.col("ntr_hf") + F.col("ntr_lf"), 5).alias("ntr_total"))


@query(
    "fitted_total",
    f"""
WITH {CENTERS}, w AS (SELECT DISTINCT center_day, center + to_days(CAST(k AS INTEGER)) AS t0 FROM c, range(-15, 16) r(k)),
s AS (SELECT l_shipdate AS time, u * abs(u) AS tu, v * abs(v) AS tv, l_tax * 100 AS ps, CAST(l_linenumber AS DOUBLE) AS nino, l_extendedprice / 10000 AS z FROM (SELECT *, (l_quantity - 25) * 0.9 AS u, l_discount * 100 - 5 AS v FROM lineitem)),
p AS (SELECT * FROM s JOIN w ON time = t0),
g AS (SELECT center_day, corr(tu, tv) AS p, corr(tu, ps) AS q, corr(tv, ps) AS r, corr(tu, z) AS a, corr(tv, z) AS b, corr(ps, z) AS c, avg(z) AS mean, stddev_pop(z) AS sd, avg(tu) AS mu, avg(tv) AS mv, avg(ps) AS mp, stddev_pop(tu) AS su, stddev_pop(tv) AS sv, stddev_pop(ps) AS sp, regr_slope(z, nino) AS ml, regr_intercept(z, nino) AS bl FROM p GROUP BY 1),
h AS (SELECT *, 1 - r * r - p * (p - q * r) + q * (p * r - q) AS det FROM g),
f AS (SELECT *, sd * (a * (1 - r * r) - p * (b - r * c) + q * (b * r - c)) / det AS cu, sd * ((b - r * c) - a * (p - q * r) + q * (p * c - b * q)) / det AS cv, sd * ((c - b * r) - p * (p * c - b * q) + a * (p * r - q)) / det AS cp FROM h),
n AS (SELECT time, avg(cu * (tu - mu) / su + cv * (tv - mv) / sv + cp * (ps - mp) / sp + mean + ml * nino + bl) AS ntr FROM s JOIN f ON strftime(time, '%m%d') = center_day GROUP BY 1),
t AS (SELECT o_orderdate AS time, avg(o_totalprice) / 1e6 AS tides FROM orders GROUP BY 1),
o AS (SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) / 1e6 AS msl FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT time, round(msl + tides + ntr, 6) AS twl FROM n JOIN t USING (time) JOIN o ON date_trunc('month', time) = month
""",
)
def fitted_total(t: Tables) -> DataFrame:
    """2.7 with R1 and R2, R12, R31: windows are fitted, the fits applied to their days, and the parts added up."""
    u, v = (F.col("l_quantity") - 25) * 0.9, F.col("l_discount") * 100 - 5
    d = t.lineitem.select(F.col("l_shipdate").alias("time"), u.alias("uas"), u.alias("uas_corrected"), v.alias("vas_corrected"), (F.col("l_tax") * 100).alias("psl_corrected"), F.col("l_linenumber").cast("double").alias("nino34"), (F.col("l_extendedprice") / 10000).alias("z"))
    ready = d.withColumns({"tauu": stress(F.col("uas_corrected")), "tauv": stress(F.col("vas_corrected")), "slp": F.col("psl_corrected")})
    slow = windows.window_ols(ready, YEARS, [], "nino34", "z").select("center_day", F.col("m").alias("m_lf"), F.col("b").alias("b_lf"))
    fits = windows.window_ols3(ready, YEARS, [], ["tauu", "tauv", "slp"], "z").join(slow, "center_day")
    plain = Compat(tauu_corrected=True, tauv_own_slope=True, extrapolated_either_side=True)
    rows = water.low_frequency(water.high_frequency(lookup_by_month_day(d, fits, key="center_day"), plain))
    ntr = rows.groupBy("time").agg(F.avg(F.col("ntr_hf") + F.col("ntr_lf")).alias("ntr"))
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    tides = t.orders.groupBy(F.col("o_orderdate").alias("time")).agg((F.avg("o_totalprice") / 1e6).alias("tides"))
    monthly = t.orders.filter("o_orderstatus = 'F'").groupBy(month("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 1e6).alias("msl"))
    msl = tides.select("time", month("time").alias("month")).join(monthly, "month").select("time", "msl")
    return rounded(water.total_level(tides, ntr, msl, ["time"]).select("time", "twl"), 6, "twl")


@query("shift_marginals", "WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'loc' ELSE 'scale' END AS param, p_size - 25.0::DOUBLE AS oh, p_retailprice / 100 - 15 AS od, p_size * 2.0::DOUBLE AS cd FROM part), c AS (SELECT p_partkey, param, CASE WHEN param = 'a' THEN least(greatest(oh, -50), 50) ELSE oh END AS oh, CASE WHEN param = 'a' THEN least(greatest(od, -50), 50) ELSE od END AS od, CASE WHEN param = 'a' THEN least(greatest(cd, -50), 50) ELSE cd END AS cd FROM s) SELECT p_partkey, param, 0.0 + round_even(CASE param WHEN 'loc' THEN oh + cd - od WHEN 'scale' THEN oh * cd / nullif(od, 0) ELSE least(greatest(sinh(asinh(oh) + asinh(cd) - asinh(od)), -50), 50) END, 4)::DOUBLE AS hourly_cmip FROM c")
def shift_marginals(t: Tables) -> DataFrame:
    """R25, P19."""
    param = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "loc").otherwise("scale")
    rows = t.part.select("p_partkey", param.alias("param"), (F.col("p_size") - 25.0).alias("hourly_obs"), F.nullif(F.col("p_retailprice") / 100 - 15, F.lit(0.0)).alias("daily_obs"), (F.col("p_size") * 2.0).alias("daily_cmip"))
    return water.shifted_parameters(rows, "skewnorm").select("p_partkey", "param", (F.col("hourly_cmip") + 0.0).alias("hourly_cmip"))


@query("capped_max", "WITH r AS (SELECT p_brand, p_partkey, p_size AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) / count(*) OVER (PARTITION BY p_brand) AS f FROM part) SELECT p_partkey, least(v, max(v) FILTER (f BETWEEN 0.2 AND 0.8) OVER (PARTITION BY p_brand)) AS capped FROM r")
def capped_max(t: Tables) -> DataFrame:
    """A23, R24, W11."""
    w = W.partitionBy("p_brand")
    rows = t.part.select("p_brand", "p_partkey", F.col("p_size").alias("v"), (F.row_number().over(w.orderBy("p_retailprice", "p_partkey")) / F.count(F.lit(1)).over(w)).alias("f"))
    return stats.capped(rows, ["p_brand"], "v", "f", 0.2, 0.8).select("p_partkey", "capped")


@query("interp_table", "WITH p AS (SELECT n_nationkey % 5 AS k, list(CAST(n_nationkey AS DOUBLE) ORDER BY n_nationkey) AS xs, list(CAST(n_nationkey * n_nationkey AS DOUBLE) ORDER BY n_nationkey) AS ys FROM nation GROUP BY 1), q AS (SELECT s_suppkey, s_suppkey % 5 AS k, s_acctbal / 300 AS x FROM supplier), i AS (SELECT *, least(greatest(len(list_filter(xs, lambda v: v <= x)), 1), len(xs) - 1) AS i FROM q JOIN p USING (k)) SELECT s_suppkey, round(CASE WHEN x <= xs[1] THEN ys[1] WHEN x >= xs[-1] THEN ys[-1] ELSE ys[i] + (ys[i + 1] - ys[i]) * (x - xs[i]) / (xs[i + 1] - xs[i]) END, 6) AS y FROM i")
def interp_table(t: Tables) -> DataFrame:
    """F8."""
    k = F.col("n_nationkey").cast("double")
    p = t.nation.groupBy((F.col("n_nationkey") % 5).alias("k")).agg(F.array_sort(F.collect_list(F.struct(k.alias("x"), (k * k).alias("y")))).alias("t"))
    q = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 5).alias("k"), (F.col("s_acctbal") / 300).alias("q"))
    return q.join(p, "k").select("s_suppkey", F.round(scalar.interpolate(F.col("q"), F.col("t.x"), F.col("t.y")), 6).alias("y"))


@query(
    "empirical_acf",
    """
WITH a AS (SELECT *, row_number() OVER w AS i, time - lag(time) OVER w > INTERVAL 3 HOUR AS new FROM view_h WINDOW w AS (PARTITION BY stn ORDER BY time)),
g AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY stn ORDER BY time), 0) AS seg FROM a),
e AS (SELECT * FROM g QUALIFY i > 1 AND coalesce(lead(seg) OVER (PARTITION BY stn ORDER BY time) = seg, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY stn, seg ORDER BY time) AS j FROM e),
p AS (SELECT a.stn, b.j - a.j AS lag, corr(a.v, b.v) AS acf, count(*) AS pairs FROM r a JOIN r b ON a.stn = b.stn AND a.seg = b.seg AND b.j > a.j AND b.j <= a.j + 6 GROUP BY ALL)
SELECT stn, lag, round(acf, 6) AS acf, pairs FROM p WHERE NOT isnan(acf) QUALIFY max((acf < 0)::INT) OVER (PARTITION BY stn ORDER BY lag) = 0
""",
    "view",
)
def empirical_acf(t: Tables) -> DataFrame:
    """R18."""
    out = acf.empirical_acf(t.hourly("view", "v"), ["stn"], "v", 6, 3)
    return out.select("stn", F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"), "pairs")


def _curve(name: str, sql: str, f):
    @query(name, f"SELECT p_partkey, lag, round({sql}, 9) AS acf FROM (SELECT p_partkey, p_size + 1.0::DOUBLE AS s, 0.3 + (p_partkey % 7) / 10 AS k FROM part), range(1, 13) r(lag)")
    def one(t: Tables) -> DataFrame:
        rows = t.part.select("p_partkey", (F.col("p_size") + 1.0).alias("s"), (0.3 + F.col("p_partkey") % 7 / 10).alias("k"))
        return rows.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(12)).cast("array<long>"))).select("p_partkey", "lag", F.round(f(F.col("lag"), F.col("s"), F.col("k")), 9).alias("acf"))


# R17, R22
_curve("acf_weibull", "exp(-((lag / s) ** k))", weibull_acf)
_curve("acf_pareto", "(1 + k * lag / s) ** (-1 / k)", pareto_acf)
_curve("acf_burr", "(1 + k * (lag / s) ** 1.5) ** (-k / 1.5)", lambda lag, s, k: burr_acf(lag, s, F.lit(1.5), k))
_curve("acf_burr_plain", "(1 + k * (lag / s) ** 1.5) ** (-(1 / (1.5 * k)))", lambda lag, s, k: burr_acf(lag, s, F.lit(1.5), k, plain=True))
_curve("acf_fgn", "abs(lag - 1) ** (2 * k) - 2 * abs(lag) ** (2 * k) + abs(lag + 1) ** (2 * k) / 2", lambda lag, s, k: fgn_acf(lag, k))
_curve("acf_fgn_plain", "0.5 * (abs(lag - 1) ** (2 * k) - 2 * abs(lag) ** (2 * k) + abs(lag + 1) ** (2 * k))", lambda lag, s, k: fgn_acf(lag, k, plain=True))
_curve("transformation_curve", "((1 + s * lag / 12) ** (1 - k) - 1) / ((1 + s) ** (1 - k) - 1)", lambda lag, s, k: transformation_curve(lag / 12, s, k))


@query("blocks_needed", "WITH r AS (SELECT p_brand, p_retailprice AS xk, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) / count(*) OVER (PARTITION BY p_brand) AS f, stddev_pop(p_retailprice) OVER (PARTITION BY p_brand) AS s, p_partkey FROM part), u AS (SELECT p_partkey, xk, (SELECT count(*) FROM part b WHERE b.p_brand = r.p_brand AND b.p_retailprice BETWEEN xk - greatest(0.001 * xk, 0.01 * s) AND xk + greatest(0.001 * xk, 0.01 * s)) / (SELECT count(*) FROM part b WHERE b.p_brand = r.p_brand) AS u FROM r) SELECT p_partkey, CASE WHEN u >= 1 THEN 1 ELSE ceil(round(ln(0.05) / ln(1 - u), 9)) END::BIGINT AS v FROM u")
def blocks_needed(t: Tables) -> DataFrame:
    """R23's count: how many draws put one within the tolerance with 95 % confidence, from shares in a value range."""
    x = F.col("p_retailprice")
    w = W.partitionBy("p_brand")
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice", F.stddev_pop(x).over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    delta = F.greatest(0.001 * x, 0.01 * F.col("s"))
    points = rows.select("p_brand", "p_retailprice").groupBy("p_brand", "p_retailprice").agg(F.count(F.lit(1)).alias("c"))
    total = points.select("p_brand", F.col("p_retailprice").alias("at"), F.sum("c").over(w.orderBy("p_retailprice")).alias("upto"))
    # counts below both bounds: each is the last running count before it
    bound = rows.select("p_brand", "p_partkey", "n", F.explode(F.array(F.struct((x + delta).alias("at"), F.lit(1).alias("sign"), F.lit(1).alias("tie")), F.struct((x - delta).alias("at"), F.lit(-1).alias("sign"), F.lit(-1).alias("tie")))).alias("q")).select("p_brand", "p_partkey", "n", "q.*")
    both = bound.unionByName(total.withColumn("tie", F.lit(0)), allowMissingColumns=True)
    seen = both.withColumn("below", F.coalesce(F.last("upto", True).over(w.orderBy("at", "tie")), F.lit(0))).filter("sign is not null")
    u = seen.groupBy("p_partkey", "n").agg((F.sum(F.col("sign") * F.col("below")) / F.col("n")).alias("u"))
    return u.select("p_partkey", F.when(F.col("u") >= 1, 1).otherwise(F.ceil(F.round(F.log(F.lit(0.05)) / F.log(1 - F.col("u")), 9))).cast("long").alias("v"))


@query("regional_index", "WITH m AS (SELECT status, date_trunc('month', time) AS time, avg(value) AS v FROM daily GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY time)::DOUBLE AS i FROM m), r AS (SELECT status, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM n GROUP BY 1), d AS (SELECT status, time, v - a * i - b AS d FROM n JOIN r USING (status)), c AS (SELECT status, time, d - avg(d) OVER (PARTITION BY status) AS c FROM d), s AS (SELECT status, time, avg(c) OVER w AS s, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY status ORDER BY time ROWS 4 PRECEDING)) SELECT status, time, round(s * 0.8 / stddev_pop(s) OVER (PARTITION BY status), 6) AS index FROM s WHERE k = 5", "daily")
def regional_index(t: Tables) -> DataFrame:
    """A3, A4, W10, W3."""
    return rounded(water.regional_index(t.daily, "value", 0.8, ["status"]), 6, "index")


MONTHS = """
m AS (SELECT x, y, date_trunc('month', time) + INTERVAL 14 DAY AS time, avg(ln(value)) AS v FROM daily GROUP BY ALL),
g AS (SELECT x, y, epoch(time) AS t, v, lead(epoch(time)) OVER w AS u, lead(v) OVER w AS z, row_number() OVER w AS i, count(*) OVER (PARTITION BY x, y) AS n FROM m WINDOW w AS (PARTITION BY x, y ORDER BY time)),
k AS (SELECT *, u - t AS h, (z - v) / (u - t) AS d FROM g),
l AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp, lead(h) OVER w AS hx, lead(d) OVER w AS dx FROM k WINDOW w AS (PARTITION BY x, y ORDER BY t))
"""
HERMITE = "v * (1 + 2 * p) * (1 - p) ** 2 + s * h * p * (1 - p) ** 2 + z * p * p * (3 - 2 * p) + r * h * p * p * (p - 1)"


@query(
    "spline_daily",
    f"""
WITH RECURSIVE daily AS (SELECT o_orderdate AS time, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority, CAST(c_nationkey % 5 AS DOUBLE) AS x, CAST(floor(c_nationkey / 5) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
{MONTHS},
b AS (SELECT x, y, i, n, t, v,
  CASE WHEN i = 1 OR n < 4 THEN 0 WHEN i = n THEN hp + hpp ELSE h END AS low, CASE WHEN n < 4 THEN 1 WHEN i = 1 THEN hx WHEN i = n THEN hpp ELSE 2 * (h + hp) END AS mid, CASE WHEN i = n OR n < 4 THEN 0 WHEN i = 1 THEN h + hx ELSE hp END AS up,
  CASE WHEN n = 2 THEN coalesce(d, dp) WHEN n = 3 AND i = 1 THEN d - h * (dx - d) / (h + hx) WHEN n = 3 AND i = 2 THEN dp + hp * (d - dp) / (h + hp) WHEN n = 3 THEN dp + hp * (dp - dpp) / (hp + hpp)
       WHEN i = 1 THEN ((h + 2 * (h + hx)) * hx * d + h * h * dx) / (h + hx) WHEN i = n THEN (hp * hp * dpp + (2 * (hp + hpp) + hp) * hpp * dp) / (hp + hpp) ELSE 3 * (h * dp + hp * d) END AS rhs FROM l),
f AS (SELECT x, y, i, up / mid AS c, rhs / mid AS d FROM b WHERE i = 1
      UNION ALL SELECT b.x, b.y, b.i, b.up / (b.mid - b.low * f.c), (b.rhs - b.low * f.d) / (b.mid - b.low * f.c) FROM f JOIN b ON b.x = f.x AND b.y = f.y AND b.i = f.i + 1),
e AS (SELECT f.x, f.y, f.i, f.d AS s FROM f JOIN b USING (x, y, i) WHERE f.i = b.n
      UNION ALL SELECT f.x, f.y, f.i, f.d - f.c * e.s FROM e JOIN f ON f.x = e.x AND f.y = e.y AND f.i = e.i - 1),
o AS (SELECT k.x, k.y, k.t, k.h, k.v, k.z, e.s, lead(e.s) OVER (PARTITION BY k.x, k.y ORDER BY k.t) AS r, unnest(generate_series(k.t::BIGINT, k.u::BIGINT - 86400, 86400)) AS q FROM k JOIN e USING (x, y, i)),
a AS (SELECT *, (q - t) / h AS p FROM o)
SELECT x, y, CAST(make_timestamp(q * 1000000) AS TIMESTAMP) AS time, round({HERMITE}, 6) AS value FROM a
""",
)
def spline_daily(t: Tables) -> DataFrame:
    """R8, of logarithms, whose digits have no ties where they are rounded."""
    m = resample.to_step(t.daily.withColumn("value", F.log("value")), ["x", "y"], ["value"], "month", shift="14 DAYS")
    return rounded(interpolate.cubic(m, ["x", "y"], "value"), 6, "value")


@query(
    "pchip_hourly",
    f"""
WITH {MONTHS},
s AS (SELECT *, CASE WHEN n = 2 THEN coalesce(d, dp)
    WHEN i = 1 THEN CASE WHEN e0 * d <= 0 THEN 0 WHEN d * dx <= 0 AND abs(e0) > 3 * abs(d) THEN 3 * d ELSE e0 END
    WHEN i = n THEN CASE WHEN e1 * dp <= 0 THEN 0 WHEN dp * dpp <= 0 AND abs(e1) > 3 * abs(dp) THEN 3 * dp ELSE e1 END
    WHEN dp * d <= 0 THEN 0 ELSE (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS s
  FROM (SELECT *, ((2 * h + hx) * d - h * dx) / (h + hx) AS e0, ((2 * hp + hpp) * dp - hp * dpp) / (hp + hpp) AS e1 FROM l)),
r AS (SELECT *, lead(s) OVER (PARTITION BY x, y ORDER BY t) AS r, min(t) OVER () AS a, max(t) OVER () AS b, min(v) OVER () AS lo, max(v) OVER () AS hi FROM s),
o AS (SELECT *, unnest(generate_series(CASE WHEN i = 1 THEN a ELSE t END::BIGINT, CASE WHEN i >= n - 1 THEN b ELSE u - 3600 END::BIGINT, 3600)) AS q FROM r WHERE i < n OR n = 1),
c AS (SELECT *, {HERMITE} AS smooth, CASE WHEN q BETWEEN t AND u THEN v + (z - v) * p END AS line FROM (SELECT *, (q - t) / h AS p FROM o)),
w AS (SELECT *, coalesce(bool_or(smooth < lo - 0.01 OR smooth > hi + 0.01) OVER (), false) AS off FROM c)
SELECT x, y, CAST(make_timestamp(q * 1000000) AS TIMESTAMP) AS time, round(CASE WHEN off THEN line ELSE smooth END, 6) AS value FROM w
""",
    "daily",
)
def pchip_hourly(t: Tables) -> DataFrame:
    """R10, of logarithms: all cells are one cube."""
    m = resample.to_step(t.daily.withColumn("value", F.log("value")), ["x", "y"], ["value"], "month", shift="14 DAYS")
    return rounded(interpolate.pchip(m, ["x", "y"], "value"), 6, "value")


# Kernels: no SQL; their tests hold them against closed forms and properties.


@query("fit_marginals")
def fit_marginals(t: Tables) -> DataFrame:
    """R15, R16."""
    return disagg.fit_marginals(t.daily.withColumn("value", F.col("value") / 1e5), ["x", "y"], "value", "skewnorm")


@query("homogeneity")
def homogeneity(t: Tables) -> DataFrame:
    """H of the cells of each status; simulated, so without SQL: tests hold it against regions of known kind."""
    return homogeneity_of(t.daily, ["status"], ["x", "y"], "value", 200)


@query("window_marginals")
def window_marginals(t: Tables) -> DataFrame:
    """2.7 with R15: a skew-normal fit for each status and calendar day; no SQL fits likelihoods, tests fit each window's rows one by one."""
    days = t.daily.groupBy("status", "time").agg((F.avg("value") / 1e5).alias("value"))
    return disagg.window_marginals(days, YEARS, ["status"], "value", "skewnorm")


@query("window_fit_acf")
def window_fit_acf(t: Tables) -> DataFrame:
    """2.7 with R18, R19: the Weibull curve of each window's autocorrelation."""
    days = t.daily.groupBy("status", "time").agg(F.sum("value").alias("value"))
    return disagg.fit_acf(acf.window_acf(days, YEARS, ["status"], ["status"], "value", 6), ["status", "center_day"])


@query("fit_acf_burr")
def fit_acf_burr(t: Tables) -> DataFrame:
    """R19 for Burr XII: the fit and its agreement with the empirical curve."""
    known = acf.empirical_acf(t.hourly("view", "v"), ["stn"], "v", 12, 48).select("stn", "lag", "acf")
    fits = disagg.fit_acf(known, ["stn"], "burrXII", places=None)
    fitted = known.join(fits, "stn").withColumn("fit", burr_acf(F.col("lag"), F.col("scale"), F.col("shape1"), F.col("shape2")))
    return fits.select("stn", *(F.round(n, 2).alias(n) for n in ("scale", "shape1", "shape2"))).join(stats.fit_metrics(fitted, ["stn"], "fit", "acf"), "stn")


@query("fit_acf")
def fit_acf(t: Tables) -> DataFrame:
    """R18, R19."""
    return disagg.fit_acf(acf.empirical_acf(t.hourly("view", "v"), ["stn"], "v", 12, 48), ["stn"])


def _marginals(t: Tables) -> DataFrame:
    return t.supplier.select((F.col("s_nationkey") % 5 - 2).cast("double").alias("a"), F.lit(0.0).alias("loc"), (0.05 + F.col("s_nationkey") / 100).alias("scale")).distinct()


@query("correlation_curves")
def correlation_curves(t: Tables) -> DataFrame:
    """R20, R22."""
    return disagg.correlation_curves(_marginals(t), "skewnorm").drop("rho_x")


@query("block_means")
def block_means(t: Tables) -> DataFrame:
    """R23, R24."""
    return disagg.block_means(_marginals(t), "skewnorm")


@query("disaggregate")
def disaggregate(t: Tables) -> DataFrame:
    """Each cell's days to hours; caches are computed for distinct tuples and joined by key."""
    d = t.daily.groupBy("x", "y", "time").agg(((F.avg("value") - 250000) / 1e6).alias("xk"))
    days = d.withColumns({"a": F.col("x") - 2, "loc": F.lit(0.0), "scale": F.bround(0.1 + F.col("y") / 50, 4)})
    ready = chain.with_blocks(days, "skewnorm", rest=["x", "y", "time"]).withColumns({"acs_scale": F.lit(8.0), "acs_shape": F.lit(0.8)})
    return disagg.disaggregate(ready, ["x", "y"], "skewnorm")


@query("hourly_totals")
def hourly_totals(t: Tables) -> DataFrame:
    """Chain C whole (2.7 with R15, R18, R19; R25; R20-R24; R30; R31): fitted in windows, shifted, cached, drawn and added up.

    Hours come from items (those of one order at one hour of their day), smoothed over half a day so that they are
    correlated; days to come, tides and levels from orders.
    """
    at = F.col("l_shipdate") + F.expr("make_dt_interval(0, cast(l_orderkey % 24 as int))")
    hours = t.lineitem.groupBy(at.alias("time"), F.lit(0).alias("stn")).agg((F.avg("l_extendedprice") / 1e5).alias("v"))
    hours = hours.select("stn", "time", windows.rolling_mean("v", ["stn"], "time", 11, full=False).alias("ntr"))
    days = t.orders.groupBy(F.lit(0).alias("stn"), F.col("o_orderdate").alias("time")).agg((F.avg("o_totalprice") / 1e6).alias("ntr"), (F.max("o_totalprice") / 1e6).alias("msl"))
    # the chain reads both many times; a row for each hour and day of the calendar, whatever the tables' size
    hours, days = hours.localCheckpoint(), days.localCheckpoint()
    hour = F.explode(F.sequence(F.col("time"), F.col("time") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("time")
    tides = days.select("stn", hour).withColumn("tides", 0.5 * F.cos(2 * 3.141592653589793 / 12.42 * F.unix_timestamp(F.col("time").cast("timestamp")) / 3600))
    return chain.hourly_totals(hours, days, tides, days.select("stn", "time", "msl"), ["stn"], YEARS, YEARS)
