"""Operator 4: tool calls of conversations linked with their results, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import cut

#: JSON types and the variant types that satisfy them.
TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls before this one on the way of its parents; null on a cycle.

    Parents are followed by doubling: each round joins every call with its pointer's pointer, so the rounds grow
    with the log of the depth. A parent that isn't a call of the conversation doesn't count.
    """
    own = calls.select("conv_id", "call_id", "parent_id").distinct()
    known = own.select("conv_id", F.col("call_id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    start = own.join(known, ["conv_id", "parent_id"], "left").groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("known"), F.col("parent_id"))).alias("to"))
    step = cut(start.withColumn("depth", F.col("to").isNotNull().cast("long")))
    most = step.count()
    reach = 1
    while reach < 2 * most and step.filter("to is not null").limit(1).count():
        on = step.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        step = cut(step.join(on, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        reach *= 2
    return step.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def problems(arguments: Column, fields: Column) -> Column:
    """Sorted problems of a variant of arguments: fields are (name, type, required); other names are not allowed."""
    given = F.expr("map()").cast("map<string,variant>")
    given = F.coalesce(F.when(F.schema_of_variant(arguments).startswith("OBJECT"), arguments.cast("map<string,variant>")), given)
    names = F.map_keys(given)

    def wrong(f: Column) -> Column:
        kind = F.schema_of_variant(F.try_element_at(given, f["name"]))
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((f["type"] == name) & kind.rlike(pattern))
        return F.array_contains(names, f["name"]) & ~F.coalesce(fits, F.lit(False))

    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.array_contains(names, f["name"])), lambda f: F.concat(F.lit("missing "), f["name"]))
    unknown = F.transform(F.array_except(names, F.transform(fields, lambda f: f["name"])), lambda n: F.concat(F.lit("unknown "), n))
    typed = F.transform(F.filter(fields, wrong), lambda f: F.concat(F.lit("type "), f["name"]))
    shape = F.when(F.schema_of_variant(arguments).startswith("OBJECT"), F.array().cast("array<string>")).otherwise(F.array(F.lit("not an object")))
    return F.array_sort(F.concat(shape, missing, unknown, typed))


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, name, status, problems, json, n_calls, n_results) of every call and of results without one.

    calls: conv_id, call_id, parent_id, name, arguments (JSON text); results: conv_id, call_id, content;
    tools: name, fields array<struct<name, type, required>>. Calls and results are joined by (conv_id, call_id).
    (depth, call_id) is a topological order within a conversation. ``status`` is "linked", "no result" or
    "no call". ``problems`` joins what the tool's schema finds by ", "; text that is no JSON is "not an object",
    names without a tool are "unknown tool". ``json`` is canonical: sorted keys, no blanks. Rows with a null key never
    link: each is a row of its own. Repeated calls or results of an id are shown by the least of them, with ties broken by
    content, and counted in ``n_calls`` and ``n_results``. Empty and very long texts are kept whole.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    columns = ["conv_id", "call_id", "depth", "name", "status", "problems", "json", "n_calls", "n_results"]
    lone = [_linked(*pair, tools).select(columns) for pair in (
        (calls.filter(~keyed).select("conv_id", "call_id", F.lit(None).cast("long").alias("depth"), "name", "arguments", F.lit(1).cast("long").alias("n_calls")).withColumns({"content": F.lit(None).cast("string"), "n_results": F.lit(0).cast("long")}),),
        (results.filter(~keyed).select("conv_id", "call_id", "content").withColumns({"depth": F.lit(None).cast("long"), "name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "n_calls": F.lit(0).cast("long"), "n_results": F.lit(1).cast("long")}),),
    )]
    call = calls.filter(keyed).groupBy("conv_id", "call_id").agg(F.min(F.struct("parent_id", "name", "arguments")).alias("c"), F.count(F.lit(1)).alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls")
    answer = results.filter(keyed).groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    both = call.join(depths(call), ["conv_id", "call_id"], "left").join(answer, ["conv_id", "call_id"], "full").fillna(0, ["n_calls", "n_results"])
    return _linked(both, tools).select(columns).unionByName(lone[0]).unionByName(lone[1])


def messages(turns: DataFrame) -> DataFrame:
    """The rows of ``link`` for turns that neither call nor answer: status "message", the role as ``name``, role and text as ``json``."""
    text = F.to_json(F.struct(F.col("text").alias("content"), F.col("role")), {"ignoreNullFields": "false"})
    none = lambda kind: F.lit(None).cast(kind)
    return turns.select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), none("long").alias("depth"), F.col("role").alias("name"), F.lit("message").alias("status"), none("string").alias("problems"), text.alias("json"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"))


def _linked(rows: DataFrame, tools: DataFrame) -> DataFrame:
    linked = rows.withColumn("parsed", F.try_parse_json("arguments")).withColumn("called", F.col("n_calls") > 0).join(tools, "name", "left")
    found = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(problems(F.coalesce(F.col("parsed"), F.parse_json(F.lit("null"))), F.col("fields")))
    status = F.when(~F.col("called"), "no call").when(F.col("n_results") == 0, "no result").otherwise("linked")
    text = F.to_json(F.struct(F.col("parsed").alias("arguments"), "depth", F.col("call_id").alias("id"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return linked.select("conv_id", "call_id", "depth", "name", status.alias("status"), F.when(F.col("called"), F.array_join(found, ", ")).alias("problems"), text.alias("json"), "n_calls", "n_results")
