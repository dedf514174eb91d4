"""Queries: projections, filters, reshaping, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.functions.scalar import clip, close, identifier, in_box, in_dates, key4, month_day, short_name, stress, wrap_longitude
from marigrid.operators import grid, joins, stats, windows
from marigrid.params import BBox
from marigrid.plans import water
from marigrid.plans.registry import Tables, query, rounded
from marigrid.sources.readers import standard_date


@query("lon_wrap", "SELECT s_suppkey AS stn, round((((s_suppkey * 7.25 - 90 + 180) % 360 + 360) % 360) - 180, 6) AS lon FROM supplier")
def lon_wrap(t: Tables) -> DataFrame:
    """P1, P3."""
    return rounded(t.supplier.select(F.col("s_suppkey").alias("stn"), wrap_longitude(F.col("s_suppkey") * 7.25 - 90).alias("lon")), 6, "lon")


@query("bbox_filter", "SELECT x, y, count(*) AS n FROM daily WHERE x BETWEEN 1 AND 3 AND y BETWEEN 0 AND 2 GROUP BY x, y", "daily")
def bbox_filter(t: Tables) -> DataFrame:
    """P4, P5."""
    return t.daily.filter(in_box(F.col("x"), F.col("y"), BBox(1, 0, 3, 2))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("time_slice", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '1997-03-02'")
def time_slice(t: Tables) -> DataFrame:
    """P6; the filter reaches the scan."""
    return t.orders.filter(in_dates(F.col("o_orderdate"), "1996-02-29", "1997-03-01")).select("o_orderkey", "o_orderdate")


@query("pivot_params", "SELECT date_trunc('month', time) AS ts, round(avg(value) FILTER (status = 'F'), 7) AS f, round(avg(value) FILTER (status = 'O'), 7) AS o, round(avg(value) FILTER (status = 'P'), 7) AS p FROM daily GROUP BY 1", "daily")
def pivot_params(t: Tables) -> DataFrame:
    """P12, D4; listing the values saves a pass."""
    rows = t.daily.withColumn("ts", F.date_trunc("month", "time").cast("timestamp_ntz"))
    wide = rows.groupBy("ts").pivot("status", ["F", "O", "P"]).agg(F.avg("value"))
    return rounded(wide.withColumnsRenamed({"F": "f", "O": "o", "P": "p"}), 7, "f", "o", "p")


@query("melt_params", "WITH w AS (SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1) SELECT l_returnflag, param, round(value, 6) AS value FROM (UNPIVOT w ON quantity, discount, tax INTO NAME param VALUE value)")
def melt_params(t: Tables) -> DataFrame:
    """P13, P14."""
    wide = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return rounded(wide.unpivot(["l_returnflag"], ["quantity", "discount", "tax"], "param", "value"), 6, "value")


@query("distinct_batches", "SELECT scale, loc, (row_number() OVER (ORDER BY loc, scale) - 1) // 100 AS batch FROM (SELECT DISTINCT greatest(l_discount, 0.02) AS scale, l_quantity AS loc FROM lineitem)")
def distinct_batches(t: Tables) -> DataFrame:
    """P11, P18, P21."""
    tuples = t.lineitem.select(F.greatest("l_discount", F.lit(0.02)).alias("scale"), F.col("l_quantity").alias("loc")).distinct()
    return windows.with_row_index(tuples, "loc", ["scale"]).select("scale", "loc", F.floor(F.col("row_index") / 100).alias("batch"))


@query("clip_params", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN least(greatest(p_retailprice - 950, -50), 50) ELSE least(greatest(p_retailprice - 950, 2.1), 200) END AS value FROM part")
def clip_params(t: Tables) -> DataFrame:
    """P19."""
    v = F.col("p_retailprice") - 950
    return t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, clip(v, -50.0, 50.0)).otherwise(clip(v, 2.1, 200.0)).alias("value"))


@query("explode_props", "SELECT event_id, unnest([k, k + 1]) AS k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def explode_props(t: Tables) -> DataFrame:
    """P24, F10."""
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", F.explode(F.array(k, k + 1)).alias("k"))


@query("fill_constants", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, 'none') AS name, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END, -1) AS region FROM nation")
def fill_constants(t: Tables) -> DataFrame:
    """P20, P8."""
    gaps = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("region"))
    return gaps.fillna({"name": "none", "region": -1})


@query("recode_emissions", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'co2' WHEN 'STANDARD' THEN 'n2o' ELSE p_type END AS variable, round(sum(p_retailprice * CASE WHEN p_type = 'ECONOMY' THEN 12.0 / 44 ELSE 1 END), 4) AS mass FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1")
def recode_emissions(t: Tables) -> DataFrame:
    """P16, P17, R35."""
    rows = t.part.filter(~F.col("p_name").startswith("red")).replace({"ECONOMY": "co2", "STANDARD": "n2o"}, subset=["p_type"])
    mass = F.col("p_retailprice") * F.when(F.col("p_type") == "co2", 12.0 / 44).otherwise(1.0)
    return rounded(rows.groupBy(F.col("p_type").alias("variable")).agg(F.sum(mass).alias("mass")), 4, "mass")


@query("shift_times", "SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 12 HOUR AS noon, date_trunc('month', o_orderdate) + INTERVAL 15 DAY AS mid FROM orders")
def shift_times(t: Tables) -> DataFrame:
    """P22."""
    at = lambda step, by: F.date_trunc(step, "o_orderdate").cast("timestamp_ntz") + F.expr(f"INTERVAL {by}")
    return t.orders.select("o_orderkey", at("day", "12 HOURS").alias("noon"), at("month", "15 DAYS").alias("mid"))


@query("scenario_period", "SELECT status, count(*) AS n, min(time) AS first, max(time) AS last FROM daily WHERE CASE WHEN status = 'F' THEN year(time) >= 1996 ELSE time <= TIMESTAMP '2000-01-01' END GROUP BY status", "daily")
def scenario_period(t: Tables) -> DataFrame:
    """P23."""
    rows = t.daily.withColumn("exp", F.when(F.col("status") == "F", "historical").otherwise("ssp"))
    return water.scenario_period(rows, 1996, 1998).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("id_parse", "SELECT DISTINCT string_split(name, '.')[1] AS label, string_split(name, '.')[2] AS domain, string_split(name, '.')[3] AS suffix FROM (SELECT split_part(split_part(url, '//', 2), '/', 1) AS name FROM pages)")
def id_parse(t: Tables) -> DataFrame:
    """D11, F6."""
    name = F.split_part(F.split_part(F.col("url"), F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return t.pages.select(identifier(name, ["label", "domain", "suffix"]).alias("i")).select("i.*").distinct()


@query("grid_name_shorten", "SELECT p_partkey, substring(replace(replace(replace(lower(p_name || ' ' || p_brand || ' ' || p_type), 'widget', ''), 'brand#', ''), ' ', ''), 1, 12) AS name FROM part")
def grid_name_shorten(t: Tables) -> DataFrame:
    """F6, F7."""
    return t.part.select("p_partkey", short_name(F.concat_ws(" ", "p_name", "p_brand", "p_type"), ["widget", "brand#"], 12).alias("name"))


@query("scalar_math", "SELECT l_orderkey, l_linenumber, round(x * abs(x), 6) AS stress, round(asinh(x), 9) AS asinh, round(sqrt(abs(x)) * exp(-abs(x) / 50), 9) AS damped, sign(x) AS sign, CAST(round_even(x / 3, 2) AS DOUBLE) AS even, abs(l_discount - 0.05) < 1e-7 AS close FROM (SELECT *, l_quantity - 25 AS x FROM lineitem)")
def scalar_math(t: Tables) -> DataFrame:
    """F1, F2, F12."""
    x = F.col("l_quantity") - 25
    rows = t.lineitem.select("l_orderkey", "l_linenumber", stress(x).alias("stress"), F.asinh(x).alias("asinh"), (F.sqrt(F.abs(x)) * F.exp(-F.abs(x) / 50)).alias("damped"), F.signum(x).cast("int").alias("sign"), F.bround(x / 3, 2).alias("even"), close(F.col("l_discount"), F.lit(0.05)).alias("close"))
    return rounded(rounded(rows, 6, "stress"), 9, "asinh", "damped")


@query("date_parts", "SELECT DISTINCT o_orderdate AS d, dayofyear(o_orderdate) AS doy, strftime(o_orderdate, '%m%d') AS month_day, CAST(last_day(o_orderdate) AS DATE) AS month_end, round(year(o_orderdate) + month(o_orderdate) / 12.0, 6) AS decimal_year FROM orders")
def date_parts(t: Tables) -> DataFrame:
    """F4, F5."""
    d = F.col("o_orderdate")
    return t.orders.select(d.alias("d"), F.dayofyear(d).cast("long").alias("doy"), month_day(d).alias("month_day"), F.last_day(d).alias("month_end"), F.round(F.year(d) + F.month(d) / 12.0, 6).alias("decimal_year")).distinct()


@query("array_ops", "SELECT vec_id, len(list_distinct(embedding)) AS n, round(list_dot_product(embedding[1:63]::DOUBLE[], embedding[2:64]::DOUBLE[]), 7) AS lagged, round(embedding[64] - embedding[1], 6) AS span FROM embeddings")
def array_ops(t: Tables) -> DataFrame:
    """F9."""
    e = F.col("embedding").cast("array<double>")
    lagged = F.aggregate(F.zip_with(F.slice(e, 1, 63), F.slice(e, 2, 63), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return t.embeddings.select("vec_id", F.size(F.array_distinct("embedding")).cast("long").alias("n"), F.round(lagged, 7).alias("lagged"), F.round(F.element_at("embedding", 64) - F.element_at("embedding", 1), 6).alias("span"))


RESIDUAL = "SELECT v.stn, v.time, round(v.v, 6) AS twl, round(c.v, 6) AS tides, round(e.v * 0.01, 6) AS msl, round(v.v - c.v - e.v * 0.01, 6) AS ntr FROM view_h v JOIN click_h c USING (stn, time) JOIN error_h e USING (stn, time)"


@query("residual_chain", RESIDUAL, "view", "click", "error")
def residual_chain(t: Tables) -> DataFrame:
    """J1, P8 and the residual."""
    msl = t.hourly("error", "msl").withColumn("msl", F.col("msl") * 0.01)
    return rounded(water.residual(t.hourly("view", "twl"), t.hourly("click", "tides"), msl).select("stn", "time", "twl", "tides", "msl", "ntr"), 6, "twl", "tides", "msl", "ntr")


@query("left_chain_join", "SELECT v.stn, v.time, round(v.v, 6) AS twl, round(c.v, 6) AS tides, round(e.v, 6) AS msl FROM view_h v LEFT JOIN click_h c USING (stn, time) LEFT JOIN error_h e USING (stn, time)", "view", "click", "error")
def left_chain_join(t: Tables) -> DataFrame:
    """J1, J5."""
    return rounded(joins.left_chain([t.hourly("view", "twl"), t.hourly("click", "tides"), t.hourly("error", "msl")], ["stn", "time"]), 6, "twl", "tides", "msl")


@query("outer_align", "SELECT coalesce(v.stn, c.stn) AS stn, coalesce(v.time, c.time) AS time, round(v.v, 6) AS twl, round(c.v, 6) AS tides FROM view_h v FULL JOIN click_h c ON v.stn = c.stn AND v.time = c.time", "view", "click")
def outer_align(t: Tables) -> DataFrame:
    """J6."""
    return rounded(joins.outer_align([t.hourly("view", "twl"), t.hourly("click", "tides")], ["stn", "time"]), 6, "twl", "tides")


@query("inner_align_sum", "SELECT stn, time, round(v.v + c.v, 6) AS total FROM view_h v JOIN click_h c USING (stn, time)", "view", "click")
def inner_align_sum(t: Tables) -> DataFrame:
    """J2, J7."""
    both = t.hourly("view", "a").join(t.hourly("click", "b"), ["stn", "time"])
    return both.select("stn", "time", F.round(F.col("a") + F.col("b"), 6).alias("total"))


@query("mmdd_lookup", "WITH p AS (SELECT strftime(time, '%m%d') AS md, avg(value) AS m, stddev_pop(value) AS s FROM daily WHERE status = 'F' AND month(time) < 7 GROUP BY 1) SELECT time, x, y, round(sum((value - m) / nullif(s, 0)), 4) AS z FROM daily JOIN p ON strftime(time, '%m%d') = md WHERE status <> 'F' GROUP BY ALL", "daily")
def mmdd_lookup(t: Tables) -> DataFrame:
    """J3; days without parameters go."""
    d = t.daily
    params = d.filter("status = 'F' AND month(time) < 7").groupBy(month_day(F.col("time")).alias("month_day")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = joins.lookup_by_month_day(d.filter("status <> 'F'"), params)
    return rows.groupBy("time", "x", "y").agg(F.round(F.sum((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))), 4).alias("z"))


@query("doy_lookup", "WITH p AS (SELECT dayofyear(time) AS doy, avg(value) AS m FROM daily GROUP BY 1) SELECT time, round(sum(value - m), 6) + 0.0 AS anomaly, count(*) AS n FROM daily JOIN p ON dayofyear(time) = doy GROUP BY time", "daily")
def doy_lookup(t: Tables) -> DataFrame:
    """J4."""
    params = t.daily.groupBy(F.dayofyear("time").alias("dayofyear")).agg(F.avg("value").alias("m"))
    return joins.lookup_by_day_of_year(t.daily, params).groupBy("time").agg((F.round(F.sum(F.col("value") - F.col("m")), 6) + 0.0).alias("anomaly"), F.count(F.lit(1)).alias("n"))


@query("nearest_lookup", "SELECT s_suppkey, (SELECT min_by(p_retailprice, abs(p_retailprice - s_acctbal / 10 - 900) * 1e9 + p_retailprice) FROM part WHERE p_size % 5 = s_nationkey % 5) AS nearest FROM supplier")
def nearest_lookup(t: Tables) -> DataFrame:
    """J8, P7."""
    q = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 5).alias("family"), (F.col("s_acctbal") / 10 + 900).alias("q"))
    return joins.nearest(q, t.part.select((F.col("p_size") % 5).alias("family"), "p_retailprice"), ["family"], "q", "p_retailprice").select("s_suppkey", "nearest")


@query("point_in_cell", "SELECT x, y, count(*) AS n, round(avg(value), 6) AS value FROM stations JOIN grid ON lon > x - 0.5 AND lon < x + 0.5 AND lat > y - 0.5 AND lat < y + 0.5 GROUP BY x, y", "stations", "grid")
def point_in_cell(t: Tables) -> DataFrame:
    """J9, G2, A6."""
    found = joins.points_in_cells(t.stations, grid.cells(t.grid), 1.0)
    return found.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("box_semi_join", "SELECT x, y FROM grid WHERE EXISTS (SELECT 1 FROM stations WHERE lon BETWEEN x - 0.05 AND x + 0.05 AND lat BETWEEN y - 0.05 AND y + 0.05)", "stations", "grid")
def box_semi_join(t: Tables) -> DataFrame:
    """J10."""
    return joins.cells_near_points(t.grid, t.stations, 0.05)


@query("cross_manifest", "SELECT r_name AS model, n_name AS cell, DATE '2000-01-01' + CAST(d AS INTEGER) AS day FROM region, nation, range(3) AS s(d)")
def cross_manifest(t: Tables) -> DataFrame:
    """A manifest of few models and cells."""
    days = t.spark.range(3).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return t.region.select(F.col("r_name").alias("model")).crossJoin(t.nation.select(F.col("n_name").alias("cell"))).crossJoin(days)


@query("hash_lookup_miss", "WITH c AS (SELECT DISTINCT CAST(round_even(p_retailprice, 4) AS DECIMAL(18,4)) AS k, CAST(p_size AS DOUBLE) AS b FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, b FROM part LEFT JOIN c ON CAST(round_even(p_retailprice, 4) AS DECIMAL(18,4)) = k")
def hash_lookup_miss(t: Tables) -> DataFrame:
    """Prices of all parts in a cache that holds those of the even ones."""
    cache = t.part.filter("p_partkey % 2 = 0").select("p_retailprice", F.col("p_size").cast("double").alias("b")).distinct()
    return joins.lookup_exact(t.part.select("p_partkey", "p_retailprice"), cache, ["p_retailprice"]).select("p_partkey", "b")


@query("packed_lookup", "WITH k AS (SELECT *, CAST(round_even(l_discount * 1000, 0) AS BIGINT) * 1000000000 + CAST(round_even(l_tax * 1000, 0) AS BIGINT) * 1000000 + CAST(round_even(l_quantity / 100 * 1000, 0) AS BIGINT) AS k FROM lineitem), c AS (SELECT k, min(l_extendedprice) AS least FROM k WHERE l_linenumber = 1 GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, least FROM k LEFT JOIN c USING (k)")
def packed_lookup(t: Tables) -> DataFrame:
    """All items in a cache of orders' first items, by three floats in one number."""
    rows = t.lineitem.withColumn("share", F.col("l_quantity") / 100)
    cache = rows.filter("l_linenumber = 1").select("l_discount", "l_tax", "share", F.col("l_extendedprice").alias("least"))
    return joins.lookup_packed(rows, cache, ["l_discount", "l_tax", "share"], "least").select("l_orderkey", "l_linenumber", "l_partkey", "least")


@query("common_models_semi", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup')")
def common_models_semi(t: Tables) -> DataFrame:
    """J16, O5."""
    of = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id")
    return of("view").join(of("purchase").intersect(of("signup")), "user_id", "left_semi").distinct()


@query("time_intersect", "SELECT stn, time, round(v, 6) AS twl FROM view_h SEMI JOIN click_h USING (stn, time)", "view", "click")
def time_intersect(t: Tables) -> DataFrame:
    """J17."""
    return rounded(t.hourly("view", "twl").join(t.hourly("click", "c"), ["stn", "time"], "left_semi"), 6, "twl")


@query("match_extents", "SELECT x, y, count(*) AS n FROM daily WHERE x BETWEEN (SELECT min(x) FROM grid WHERE x > 0) AND (SELECT max(x) FROM grid WHERE x > 0) AND y BETWEEN (SELECT min(y) FROM grid WHERE x > 0) AND (SELECT max(y) FROM grid WHERE x > 0) GROUP BY x, y", "daily", "grid")
def match_extents(t: Tables) -> DataFrame:
    """J19."""
    return joins.match_extents(t.daily, t.grid.filter("x > 0")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("missing_months", "SELECT user_id, year_month FROM (SELECT DISTINCT user_id FROM events), (SELECT round(2024 + d / 366.0, 3) AS year_month FROM range(31) s(d)) EXCEPT SELECT user_id, round(2024 + (dayofyear(ts) - 1) / 366.0, 3) FROM events WHERE event_type = 'error'")
def missing_months(t: Tables) -> DataFrame:
    """Full spine less what is there."""
    spine = t.spark.range(31).select(F.round(2024 + F.col("id") / 366.0, 3).alias("year_month"))
    whole = t.events.select("user_id").distinct().crossJoin(spine)
    there = t.events.filter("event_type = 'error'").select("user_id", F.round(2024 + (F.dayofyear("ts") - 1) / 366.0, 3).alias("year_month"))
    return whole.join(there, ["user_id", "year_month"], "left_anti")


@query("union_all", "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_all(t: Tables) -> DataFrame:
    """O2, S7, K4."""
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")))


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    """O3."""
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("first_smallest", "SELECT p_brand, min_by(p_partkey, p_retailprice * 1e6 + p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_smallest(t: Tables) -> DataFrame:
    """Ties go to the least key."""
    return t.part.groupBy("p_brand").agg(F.min(F.struct("p_retailprice", "p_partkey")).alias("m")).select("p_brand", "m.p_partkey")


@query("merge_intervals", "WITH i AS (SELECT l_suppkey AS k, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT k AS l_suppkey, min(s) AS \"start\", max(e) AS \"end\" FROM g GROUP BY k, island")
def merge_intervals(t: Tables) -> DataFrame:
    """O7; days are rounded, ties to even."""
    rows = t.lineitem.select("l_suppkey", F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.make_dt_interval(F.rint("l_quantity").cast("int"))).alias("end"))
    return windows.merged_intervals(rows, ["l_suppkey"])


@query("superset_groups", "SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'error', 'signup') AND value > 20 GROUP BY 1 HAVING count(DISTINCT event_type) = 4")
def superset_groups(t: Tables) -> DataFrame:
    """A15."""
    return stats.has_all(t.events.filter("value > 20"), ["user_id"], "event_type", ["view", "click", "error", "signup"])


@query("relational_division", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1 HAVING count(*) = 4")
def relational_division(t: Tables) -> DataFrame:
    """A16."""
    wanted = t.orders.filter("o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_orderstatus", "o_orderpriority")
    return stats.divide(t.orders, ["o_custkey"], wanted)


@query("group_any", "SELECT o_custkey, bool_or(contains(o_orderpriority, 'URGENT')) AS urgent FROM orders GROUP BY 1")
def group_any(t: Tables) -> DataFrame:
    """A17."""
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.contains("o_orderpriority", F.lit("URGENT"))).alias("urgent"))


@query("key_rounding", "SELECT CAST(round_even(l_tax / 3, 4) AS DECIMAL(18,4)) AS k, count(*) AS n FROM lineitem GROUP BY 1")
def key_rounding(t: Tables) -> DataFrame:
    """J13's keys."""
    return t.lineitem.groupBy(key4(F.col("l_tax") / 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_cells", "SELECT x, y, status, round(sum(value), 2) AS total FROM daily WHERE (x, y) NOT IN (SELECT (x, y) FROM (SELECT x, y, CASE WHEN value > 495000 AND y < 3 THEN NULL ELSE value END AS v FROM daily) WHERE v IS NULL) GROUP BY ALL", "daily")
def complete_cells(t: Tables) -> DataFrame:
    """K8: cells that lack no value."""
    rows = t.daily.withColumn("v", F.when(~((F.col("value") > 495000) & (F.col("y") < 3)), F.col("value")))
    return rounded(grid.complete_cells(rows, ["v"]).groupBy("x", "y", "status").agg(F.sum("value").alias("total")), 2, "total")


@query("snap_to_axis", "WITH q AS (SELECT s_suppkey, s_acctbal / 100 AS lon FROM supplier), r AS (SELECT s_suppkey, CAST(n_nationkey * 4 AS DOUBLE) AS x, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(n_nationkey * 4 - lon), n_nationkey) AS i FROM q, nation) SELECT s_suppkey, x FROM r WHERE i = 1")
def snap_to_axis(t: Tables) -> DataFrame:
    """K8: the nearest coordinate of an axis."""
    axis = t.nation.select((F.col("n_nationkey") * 4).cast("double").alias("x"))
    return grid.snapped(t.supplier.select("s_suppkey", (F.col("s_acctbal") / 100).alias("x")), axis, "x")


@query("ocean_cells", "SELECT x, y, count(*) AS n FROM daily WHERE (x, y) NOT IN (SELECT (x, y) FROM grid WHERE x + y > 5) GROUP BY ALL", "daily", "grid")
def ocean_cells(t: Tables) -> DataFrame:
    """Cells out of a mask."""
    return grid.outside_mask(t.daily, t.grid.filter("x + y > 5")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("central_location", "SELECT 2.5 BETWEEN min(x) AND max(x) AND 1.5 BETWEEN min(y) AND max(y) AND bool_or(x + y <= 5 AND x BETWEEN 2 AND 3 AND y BETWEEN 1 AND 2) AS ok FROM grid", "grid")
def central_location(t: Tables) -> DataFrame:
    """G4."""
    return grid.central_location(grid.outside_mask(t.grid, t.grid.filter("x + y > 5")), t.grid, 2.5, 1.5, BBox(2, 1, 3, 2))


@query("frames_sum", "SELECT nation, round(sum(balance), 2) AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
def frames_sum(t: Tables) -> DataFrame:
    """A19."""
    frames = [t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))]
    return rounded(stats.summed(frames, ["nation"], ["balance"]), 2, "balance")


@query("whole_row_means", "SELECT l_returnflag, round(avg(a), 7) AS a, round(avg(l_discount), 8) AS l_discount FROM (SELECT *, CASE WHEN l_quantity <= 40 THEN l_quantity END AS a FROM lineitem) WHERE a IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1")
def whole_row_means(t: Tables) -> DataFrame:
    """A21."""
    rows = t.lineitem.withColumn("a", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")))
    return rounded(rounded(stats.whole_means(rows, ["a", "l_discount"], ["l_returnflag"]), 7, "a"), 8, "l_discount")


@query("standard_calendar", "SELECT o_orderkey, CAST(make_date(y, 1, 1) + CAST(round_even(((o_orderkey % 12) * 30 + o_custkey % 30 + 1) * dayofyear(make_date(y, 12, 31)) / 360.0::DOUBLE, 0) - 1 AS INTEGER) AS DATE) AS d FROM (SELECT *, year(o_orderdate) AS y FROM orders)")
def standard_calendar(t: Tables) -> DataFrame:
    """Dates of a year of 360 days."""
    month, day = (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_custkey") % 30 + 1).cast("int")
    return t.orders.select("o_orderkey", standard_date(F.year("o_orderdate"), month, day).alias("d"))


#: The test tables' stand-in for one scenario of an emission database, as common table expressions.
_EMISSIONS = """
WITH n AS (SELECT unnest(['Emissions|CO2|MAGICC Fossil and Industrial', 'Emissions|CO2', 'Emissions|N2O', 'Emissions|Sulfur', 'Emissions|VOC', 'Emissions|HFC4310mee', 'Emissions|NOx', 'Emissions|NH3', 'Emissions|CH4', 'Population']) AS variable, unnest(range(10)) AS k),
l AS (SELECT variable, y AS year, p_retailprice * (y - 1999) + p_size AS value FROM part JOIN n ON p_partkey % 10 = k, range(2000, 2003) r(y) WHERE p_size % 3 > 0),
w AS (SELECT year, avg(value) FILTER (variable = 'Emissions|CO2|MAGICC Fossil and Industrial') AS fossil, avg(value) FILTER (variable = 'Emissions|CO2') AS co2, avg(value) FILTER (variable = 'Emissions|N2O') AS n2o, avg(value) FILTER (variable = 'Emissions|Sulfur') AS sulfur,
  avg(value) FILTER (variable = 'Emissions|VOC') AS voc, avg(value) FILTER (variable = 'Emissions|HFC4310mee') AS hfc, avg(value) FILTER (variable = 'Emissions|NOx') AS nox, avg(value) FILTER (variable = 'Emissions|NH3') AS nh3, avg(value) FILTER (variable = 'Emissions|CH4') AS ch4 FROM l GROUP BY 1)"""


@query(
    "emission_table",
    _EMISSIONS
    + """
SELECT CAST(year AS INTEGER) AS year, round(fossil * 12 / 44000, 7) AS "FossilCO2", round((co2 - fossil) / 1000, 7) AS "OtherCO2", round(n2o * 28 / 44 / 1000, 7) AS "N2O", round(sulfur * 32 / 64, 7) AS "SOx", round(voc, 7) AS "NMVOC", round(hfc, 7) AS "HFC43-10", round(nox * 14 / 30, 7) AS "NOx", round(nh3 * 14 / 17, 7) AS "NH3", round(ch4, 7) AS "CH4" FROM w
""",
)
def emission_table(t: Tables) -> DataFrame:
    """P13, P16, P12, P17."""
    shown = ["FossilCO2", "OtherCO2", "N2O", "SOx", "NMVOC", "HFC43-10", "NOx", "NH3", "CH4"]
    return rounded(_emissions(t).select("year", *shown), 7, *shown)


def _emissions(t: Tables) -> DataFrame:
    names = ["CO2|MAGICC Fossil and Industrial", "CO2", "N2O", "Sulfur", "VOC", "HFC4310mee", "NOx", "NH3", "CH4"]
    variable = F.get(F.array(*(F.lit(f"Emissions|{n}") for n in names), F.lit("Population")), (F.col("p_partkey") % 10).cast("int"))
    years = {str(y): F.col("p_retailprice") * (y - 1999) + F.col("p_size") for y in range(2000, 2003)}
    rows = t.part.select(variable.alias("variable"), F.when(F.col("p_size") % 3 > 0, "clean").otherwise("raw").alias("stage"), *(c.alias(y) for y, c in years.items()))
    return water.emission_table(rows, list(years))


@query(
    "emission_lines",
    _EMISSIONS
    + """,
v AS (SELECT year, unnest(range(23)) AS k, unnest([fossil * 12 / 44000, (co2 - fossil) / 1000, ch4, n2o * 28 / 44 / 1000, sulfur * 32 / 64, NULL, voc, nox * 14 / 30, NULL, NULL, nh3 * 14 / 17, NULL, NULL, NULL, NULL, NULL, hfc, NULL, NULL, NULL, NULL, NULL, NULL]) AS x FROM w)
SELECT 9 AS part, CAST(year AS INTEGER) AS year, printf('%11d', year) || string_agg(' ' || coalesce(printf('%10.4f', round(x, 4)), lpad('nan', 10, ' ')), '' ORDER BY k) AS line FROM v GROUP BY year
UNION ALL SELECT 0, NULL, ' ' || count(DISTINCT year) FROM w
UNION ALL SELECT part, NULL, line FROM (VALUES (1, ' 11'), (2, ' SSP1'), (3, ' Description line 1'), (4, ' Description line 2'), (5, ''), (6, ' WORLD'), (10, ''), (10, ''),
  (7, '      YEARS  FossilCO2   OtherCO2        CH4        N2O        SOx         CO      NMVOC        NOx         BC         OC        NH3        CF4       C2F6      C6F14      HFC23      HFC32   HFC43-10     HFC125    HFC134a    HFC143a   HFC227ea   HFC245fa        SF6'),
  (8, '        Yrs        GtC        GtC      MtCH4    MtN2O-N        MtS       MtCO         Mt        MtN         Mt         Mt        MtN         kt         kt         kt         kt         kt         kt         kt         kt         kt         kt         kt         kt')) f(part, line)
""",
)
def emission_lines(t: Tables) -> DataFrame:
    """The file's lines."""
    return water.emission_lines(_emissions(t), "SSP1")
