"""Operator 8: dated URL lists: entries become validity intervals that captures are joined with as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket of time: intervals and captures meet in (host, bucket).
DAYS = 64
_SECONDS = DAYS * 86_400


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and closing dots; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def parents(name: Column) -> Column:
    """The host and every parent domain of it, the longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, host, verdict, since, until): from each "add" to the next event of its list and host.

    entries: list_name, host, verdict ("block" or "allow"), event ("add" or "remove"), at (timestamp). At one
    time a removal comes last and so wins. ``until`` is null for entries that are still listed. Rows with a null
    host, event or time are left out; repeated rows count once.
    """
    known = entries.select("list_name", F.lower("host").alias("host"), "verdict", "event", "at").dropna(subset=["host", "event", "at"]).distinct()
    order = Window.partitionBy("list_name", "host").orderBy("at", "event", "verdict")
    spans = known.withColumn("until", F.lead("at").over(order)).filter("event = 'add'")
    return spans.filter(F.col("until").isNull() | (F.col("until") > F.col("at"))).select("list_name", "host", "verdict", F.col("at").alias("since"), "until")


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, n_rows, verdict, matched_host, hits) of every distinct capture.

    captures: page_id, url, fetched (timestamp). Entries hold for their host and all hosts below it, from their
    addition on until their removal (exclusive). The longest host decides; "block" comes before "allow". ``hits``
    counts the active entries. Without one, without a host or without a time, the verdict is "none". ``n_rows``
    says how often the capture is in the table; null ids and urls stay. Very long urls are matched whole.
    """
    seen = captures.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n_rows"))
    bucket = F.floor(F.unix_timestamp(F.col("fetched").cast("timestamp")) / _SECONDS)
    asked = seen.withColumn("name", F.explode_outer(parents(host(F.col("url"))))).withColumn("bucket", bucket)
    span = captures.agg(F.min("fetched"), F.max("fetched")).first()
    valid = intervals(entries).filter((F.col("since") <= F.lit(span[1])) & (F.col("until").isNull() | (F.col("until") > F.lit(span[0]))))
    first = F.greatest(F.col("since"), F.lit(span[0]).cast("timestamp_ntz")) if span[0] is not None else F.col("since")
    last = F.least(F.coalesce("until", F.lit(span[1]).cast("timestamp_ntz")), F.lit(span[1]).cast("timestamp_ntz")) if span[0] is not None else F.col("since")
    at = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / _SECONDS)
    listed = valid.withColumn("at_bucket", F.explode(F.sequence(at(first), at(last)))).withColumnRenamed("host", "listed")
    active = (F.col("name") == F.col("listed")) & (F.col("bucket") == F.col("at_bucket")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    joined = asked.join(listed, active, "left")
    rank = F.struct(F.length("listed").alias("n"), F.col("verdict"), F.col("listed"))
    best = F.max(F.when(F.col("listed").isNotNull(), rank))
    out = joined.groupBy("page_id", "url", "fetched", "n_rows").agg(best.alias("best"), F.count("listed").alias("hits"))
    return out.select("page_id", "url", "fetched", "n_rows", F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.listed").alias("matched_host"), "hits")
