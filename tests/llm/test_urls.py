from datetime import datetime as dt

from marigrid.llm import urls

CAPTURES = "page_id long, url string, fetched timestamp_ntz, host string, bucket int, verdict string"
ENTRIES = "list_name string, host string, verdict string, event string, at timestamp_ntz, url string"


def day(m, d):
    return dt(2023, m, d)


def run(spark, captures, entries):
    out = urls.decide(spark.createDataFrame([(*c, "h", 1, "v") for c in captures], CAPTURES), spark.createDataFrame([(*e, "u") for e in entries], ENTRIES))
    return {(r.page_id, r.fetched): r for r in out.collect()}


def test_as_of(spark):
    entries = [("l", "bad.com", "block", "add", day(2, 1)), ("l", "bad.com", "block", "remove", day(4, 1)), ("l", "bad.com", "block", "add", day(9, 1)), ("l", "ok.bad.com", "allow", "add", day(1, 1)), ("l", "zero.com", "block", "add", day(3, 1)), ("l", "zero.com", "block", "remove", day(3, 1)), ("a", "both.com", "allow", "add", day(1, 1)), ("b", "both.com", "block", "add", day(1, 1)), ("l", None, "block", "add", day(1, 1)), ("l", "bad.com", "block", "add", day(2, 1))]
    captures = [(1, "http://x.bad.com/p?q", t) for t in (day(1, 31), day(2, 1), day(3, 31), day(4, 1), day(8, 1), day(12, 31))]
    captures += [(2, "https://user:pw@OK.bad.com.:8080/", day(3, 1)), (3, "http://zero.com", day(3, 1)), (4, "ftp://both.com/", day(5, 5)), (5, "not a url", day(3, 1)), (6, None, day(3, 1)), (7, "http://bad.com", None), (None, "http://notbad.com", day(3, 1)), (9, "http://bad.com/" + "x" * 100_000, day(3, 1)), (8, "", day(3, 1)), (10, "http://bad.com/", day(3, 1)), (10, "http://bad.com/", day(3, 1))]
    got = run(spark, captures, entries)
    assert [got[1, c[2]].verdict for c in captures[:6]] == ["none", "block", "block", "none", "none", "block"]
    assert (got[2, day(3, 1)].verdict, got[2, day(3, 1)].matched_host, got[2, day(3, 1)].hits) == ("allow", "ok.bad.com", 2)
    assert got[4, day(5, 5)].verdict == "block" and got[4, day(5, 5)].hits == 2
    for k in ((3, day(3, 1)), (5, day(3, 1)), (6, day(3, 1)), (7, None), (None, day(3, 1)), (8, day(3, 1))):
        assert got[k].verdict == "none" and got[k].hits == 0
    assert got[9, day(3, 1)].verdict == "block" and got[10, day(3, 1)].n_rows == 2


def test_empty(spark):
    assert run(spark, [], [("l", "a.com", "block", "add", day(1, 1))]) == {}
    assert run(spark, [(1, "http://a.com", day(1, 1))], [])[1, day(1, 1)].verdict == "none"


def test_plan_is_native(spark):
    df = urls.decide(spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
