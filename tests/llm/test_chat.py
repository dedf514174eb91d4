import json

from marigrid.llm import chat

CALLS = "conv_id long, call_id string, parent_id string, name string, arguments string, depth string"
RESULTS = "conv_id long, call_id string, content string, json string"
TOOLS = "name string, fields array<struct<name:string,type:string,required:boolean>>"
FIELDS = [("q", "string", True), ("n", "integer", False), ("x", "number", False), ("b", "boolean", False), ("l", "array", False), ("o", "object", False)]


def run(spark, calls, results):
    tools = spark.createDataFrame([("find", FIELDS), ("nothing", [])], TOOLS)
    out = chat.link(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), tools)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_links_and_order(spark):
    calls = [(1, f"c{i}", f"c{i - 1}" if i else None, "nothing", "{}") for i in range(40)] + [(2, "a", "b", "nothing", "{}"), (2, "b", "a", "nothing", "{}"), (2, "z", "gone", "nothing", "{}"), (2, "y", "a", "nothing", "{}")]
    got = run(spark, calls, [(1, "c3", "three"), (1, "none", "lost"), (None, "c3", "no key")])
    assert [got[1, f"c{i}"].depth for i in range(40)] == list(range(40))
    assert [got[2, k].depth for k in "abyz"] == [None, None, None, 0]
    assert got[1, "c3"].status == "linked" and got[1, "c4"].status == "no result"
    assert got[1, "none"].status == got[None, "c3"].status == "no call"
    assert got[1, "c3"].json == '{"arguments":{},"depth":3,"id":"c3","name":"nothing","result":"three"}'


def test_schemas(spark):
    cases = {
        '{"q": "é \\"x\\"", "n": 3}': "", '{"n":3}': "missing q", '{"q":1}': "type q", '{"q":"a","n":"3"}': "type n", '{"q":"a","n":1.5}': "type n", '{"q":"a","x":1.5}': "", '{"q":"a","x":2}': "",
        '{"q":"a","b":true,"l":[1],"o":{"k":1}}': "", '{"q":"a","b":1,"l":{},"o":[]}': "type b, type l, type o", '{"q":"a","w":1}': "unknown w", "not json": "missing q, not an object", "[1]": "missing q, not an object", None: "missing q, not an object", "": "missing q, not an object", '{"q":null}': "type q",
    }
    got = run(spark, [(1, str(i), None, "find", a) for i, a in enumerate(cases)] + [(1, "u", None, "who", "{}"), (1, "n", None, None, "{}")], [])
    assert {a: got[1, str(i)].problems for i, a in enumerate(cases)} == cases
    assert got[1, "u"].problems == got[1, "n"].problems == "unknown tool"


def test_canonical_json(spark):
    text = '{"b": 1, "a": {"d": [1, 2.50, null], "c": "x\\ny"},\n "é": "\\u00e9"}'
    r = run(spark, [(1, "c", None, "find", text)], [(1, "c", "line\n\"q\"")])[1, "c"]
    assert json.loads(r.json)["arguments"] == json.loads(text)
    assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_repeats_nulls_and_empty(spark):
    got = run(spark, [(1, "c", None, "find", '{"q":"b"}'), (1, "c", None, "find", '{"q":"a"}'), (None, None, None, None, None)], [(1, "c", "z"), (1, "c", "y"), (None, None, None)])
    assert '"q":"a"' in got[1, "c"].json and got[1, "c"].json.endswith('"result":"y"}')
    assert run(spark, [], []) == {}
    long = "w " * 200_000
    assert json.loads(run(spark, [(1, "c", None, "find", json.dumps({"q": long}))], [(1, "c", long)])[1, "c"].json)["result"] == long


def test_null_keys_keep_their_rows_and_repeats_are_counted(spark):
    tools = spark.createDataFrame([("find", FIELDS)], TOOLS)
    calls = [(1, "c", None, "find", '{"q":"a"}', "x"), (1, "c", None, "find", '{"q":"a"}', "x"), (1, None, None, "find", '{"q":"b"}', "x"), (1, None, None, "find", "{}", "x"), (None, "c", None, None, None, "x")]
    results = [(1, "c", "y", "x"), (1, None, "u", "x"), (1, None, "v", "x"), (None, "c", "w", "x"), (None, None, None, "x")]
    out = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools).collect()
    assert sorted((r.status, r.n_calls, r.n_results) for r in out) == sorted([("linked", 2, 1)] + [("no result", 1, 0)] * 3 + [("no call", 0, 1)] * 4)
    assert {json.loads(r.json)["result"] for r in out} == {"y", "u", "v", "w", None}


def test_other_turns_are_messages(spark):
    turns = spark.createDataFrame([(1, 0, "system", 'say "é"'), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.messages(turns).collect()}
    assert got[1].json == '{"content":"say \\"é\\"","role":"system"}' and got[1].name == "system" and got[1].call_id == "c0"
    assert got[None].json == '{"content":null,"role":null}' and got[None].status == "message"
