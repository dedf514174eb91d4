"""Inputs that the given tables don't hold, derived from them by rules that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marigrid.llm.common import table
from marigrid.llm.urls import host

START = "timestamp_ntz'2023-01-01'"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a fetch time within two years of ``START``."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"{START} + make_dt_interval(cast(page_id * 7919 % 730 as int))").alias("fetched"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries of three lists. Digits of the md5 of a host say when it is listed, removed and listed again."""
    hosts = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host")).distinct().dropna().withColumn("m", F.md5("host"))
    digit = lambda i: f"(instr('0123456789abcdef', substr(m, {i}, 1)) - 1)"
    on, off = f"({digit(1)} * 16 + {digit(2)})", f"({digit(1)} * 16 + {digit(2)} + {digit(3)} * 16 + {digit(4)} + 1)"
    day = lambda d: F.expr(f"{START} + make_dt_interval({d})").alias("at")
    verdict = F.expr(f"if({digit(6)} < 4, 'allow', 'block')").alias("verdict")
    row = lambda name, v, event, d: [F.lit(name).alias("list_name"), "host", v, F.lit(event).alias("event"), day(d)]
    allow, block = F.lit("allow").alias("verdict"), F.lit("block").alias("verdict")
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct()
    own = hosts.select(*row("hosts", verdict, "add", on)).union(hosts.select(*row("hosts", verdict, "remove", off)))
    again = hosts.filter(f"{digit(5)} < 8").select(*row("hosts", verdict, "add", f"{off} + 30"))
    extra = hosts.filter(f"{digit(7)} = 0").select(*row("extra", allow, "add", "100"))
    wide = domains.select(*row("domains", block, "add", "300")).union(domains.select(*row("domains", block, "remove", "500")))
    return own.union(again).union(extra).union(wide)


def other_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that ``tool_calls`` doesn't read: those of the system and of any other role."""
    return table(spark, sf_dir, "conversations").filter("role is null or role not in ('user', 'assistant')")


def tool_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, tools): user turns call a tool, the turn after them has its result, the user turn before them is their parent."""
    turns = table(spark, sf_dir, "conversations")
    n = F.length("text")
    query = F.col("text").alias("query")
    arguments = F.when(n % 5 == 0, '{"limit":5}').when(n % 7 == 0, F.to_json(F.struct(F.lit("12").alias("limit"), query))).otherwise(F.to_json(F.struct(query, (n % 50).alias("limit"))))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("answer")
    key = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    calls = turns.filter("role = 'user'").select("conv_id", key(0).alias("call_id"), key(2).alias("parent_id"), name.alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'assistant'").select("conv_id", key(1).alias("call_id"), F.col("text").alias("content"))
    field = "name string, type string, required boolean"
    tools = spark.createDataFrame([("search", [("query", "string", True), ("limit", "integer", False)]), ("lookup", [("query", "string", True), ("limit", "string", False)])], f"name string, fields array<struct<{field.replace(' ', ':').replace(',:', ',')}>>")
    return calls, results, tools


URLS_SQL = """
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2023-01-01' + to_days(CAST(page_id * 7919 % 730 AS INTEGER)) AS fetched, count(*) AS n_rows,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS name
  FROM pages GROUP BY ALL),
m AS (SELECT DISTINCT name AS host, md5(name) AS m FROM c WHERE name IS NOT NULL),
d AS (SELECT host, [instr('0123456789abcdef', substr(m, i, 1)) - 1 FOR i IN range(1, 8)] AS x FROM m),
p AS (SELECT host, x[1] * 16 + x[2] AS day_on, x[1] * 16 + x[2] + x[3] * 16 + x[4] + 1 AS day_off, x[5] < 8 AS again, CASE WHEN x[6] < 4 THEN 'allow' ELSE 'block' END AS verdict, x[7] = 0 AS extra FROM d),
s AS (
  SELECT host, verdict, day_on AS a, day_off AS b FROM p
  UNION ALL SELECT host, verdict, day_off + 30, NULL FROM p WHERE again
  UNION ALL SELECT host, 'allow', 100, NULL FROM p WHERE extra
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), 'block', 300, 500 FROM p),
e AS (SELECT host, verdict, TIMESTAMP '2023-01-01' + to_days(CAST(a AS INTEGER)) AS since, TIMESTAMP '2023-01-01' + to_days(CAST(b AS INTEGER)) AS until FROM s),
j AS (
  SELECT c.*, e.host AS listed, e.verdict AS v FROM c LEFT JOIN e
  ON (c.name = e.host OR ends_with(c.name, '.' || e.host)) AND c.fetched >= e.since AND (e.until IS NULL OR c.fetched < e.until))
SELECT page_id, url, fetched, n_rows,
       coalesce(arg_max(v, length(listed) * 2 + CAST(v = 'block' AS INTEGER)), 'none') AS verdict,
       arg_max(listed, length(listed)) AS matched_host, count(listed) AS hits
FROM j GROUP BY page_id, url, fetched, n_rows
"""

CHAT_SQL = """
WITH u AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE role = 'user'),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS depth FROM g),
call AS (
  SELECT conv_id, 'c' || turn AS call_id, depth, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'answer' END AS name, n,
         CASE WHEN n % 5 = 0 THEN '{"limit":5}' WHEN n % 7 = 0 THEN '{"limit":"12","query":' || to_json(text) || '}' ELSE '{"limit":' || (n % 50) || ',"query":' || to_json(text) || '}' END AS arguments
  FROM o),
res AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(call.conv_id, res.conv_id) AS conv_id, coalesce(call.call_id, res.call_id) AS call_id, depth, name, n, arguments, content, call.call_id IS NULL AS no_call, res.call_id IS NULL AS no_result
      FROM call FULL JOIN res ON call.conv_id = res.conv_id AND call.call_id = res.call_id)
SELECT conv_id, call_id, depth, name, CASE WHEN no_call THEN 0 ELSE 1 END AS n_calls, CASE WHEN no_result THEN 0 ELSE 1 END AS n_results,
       CASE WHEN no_call THEN 'no call' WHEN no_result THEN 'no result' ELSE 'linked' END AS status,
       CASE WHEN no_call THEN NULL WHEN name = 'answer' THEN 'unknown tool'
            WHEN n % 5 = 0 THEN CASE name WHEN 'search' THEN 'missing query' ELSE 'missing query, type limit' END
            WHEN (n % 7 = 0) = (name = 'search') THEN 'type limit' ELSE '' END AS problems,
       '{"arguments":' || coalesce(arguments, 'null') || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM j
UNION ALL
SELECT conv_id, 'c' || turn, NULL, role, 0, 0, 'message', NULL, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
