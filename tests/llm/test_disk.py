"""What the disk holds: no shuffle of whole texts or of all runs of words past the bounds of broadcasts, none of earlier steps."""

import os
import time

import numpy as np
import pytest
from marigrid.llm import common, passages
from pyspark.sql import functions as F


def shuffled(spark, f):
    """(result of f, most records that one of its stages shuffled)."""
    sc = spark.sparkContext

    def stages():
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(listed.apply, range(listed.size()))}

    before = set(stages())
    out = f()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, max((n for k, n in stages().items() if k not in before), default=0)


def test_few_rows_are_shuffled_for_many_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 5)
    rows = spark.range(5000).select(F.col("id").cast("int").alias("k"), F.repeat(F.lit("x"), 9).alias("t")).union(spark.sql("select cast(null as int), 'y'"))
    ids = spark.range(0, 6000, 400).withColumnRenamed("id", "k")
    got, records = shuffled(spark, lambda: sorted(r.k for r in common.narrowed(rows, ids, "k").collect()))
    assert got == list(range(0, 5000, 400)) and records < 100
    some, others = common.parted(rows, ids, "k")
    assert some.count() + others.count() == 5001 and some.count() < 50
    assert {*got} <= {r.k for r in some.collect()} and not {*got} & {r.k for r in others.collect()}
    assert {r.k for r in common.likely(rows, ids, "k").collect()} >= {*got}


def test_few_runs_are_shuffled(spark, docs, prose, monkeypatch):
    """Past the bound of a broadcast only runs that may be asked for are shuffled, and the rows are the same."""
    text = prose(130, 1)
    rows = [(i, prose(300, 100 + i)) for i in range(60)] + [(100, text), (101, f"{prose(40, 2)} {text}"), (102, text[: len(text) // 2])]
    wanted = spark.createDataFrame([(101, [(40, 121)]), (102, [(0, 20)])], "doc_id long, spans array<struct<lo:int,hi:int>>")
    table = docs(rows).select("doc_id", "text")
    want = {tuple(r) for r in passages._rest(table, wanted).collect()}
    assert {r[0] for r in want} == {101, 102}
    monkeypatch.setattr(passages, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    got, records = shuffled(spark, lambda: {tuple(r) for r in passages._rest(table, wanted).collect()})
    assert got == want and records < 1000


def test_same_passages_past_all_bounds(docs, prose, monkeypatch):
    text = prose(90, 7).split()
    rows = [(i, f"{prose(60, 200 + i)} {' '.join(text[: 90 - i % 3 * 10])} {prose(30, 300 + i)}") for i in range(0, 40, 2)] + [(i, prose(80, 400 + i)) for i in range(1, 40, 2)] + [(None, " ".join(text))]
    table = docs(rows)
    seen = lambda: (sorted(map(tuple, passages.repeats(table).collect())), sorted((str(r.doc_id), r.text, r.n_chars) for r in passages.trimmed(table).collect()))
    want = seen()
    assert want[0] and len(want[1]) == 41
    for module in (common, passages):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    assert seen() == want


def test_files_of_a_step_are_deleted(spark):
    folders = [str(d) for d in (lambda a: [a[i] for i in range(len(a))])(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())]
    files = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common._DELETES, None)
    kept = common.cut(spark.range(5000).repartition(7, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._DELETES, None) == setting
    assert kept.count() == 5000


@pytest.mark.parametrize("buckets", [16, 324, 3900])
def test_sent_bytes_and_bucket_tell_hashes_apart(buckets):
    h = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    sent = passages._sent(h)
    assert not (sent & np.uint64((1 << (64 - 8 * passages.BYTES)) - 1)).any()
    near = h ^ (np.uint64(1) << np.random.default_rng(2).integers(0, 64, len(h), dtype=np.uint64))
    apart = (passages._sent(near) != sent) | ((near >> np.uint64(34)) % np.uint64(buckets) != (h >> np.uint64(34)) % np.uint64(buckets))
    low = (h ^ near) < np.uint64(1 << 34)
    assert apart[low].all() and (passages._sent(h[:-1]) != passages._sent(h[1:])).all()


def test_earliest():
    columns = lambda *rows: [np.array(c) for c in zip(*rows, strict=True)]
    held = [columns((1, 9, 5, 60, 7, 0, 0), (1, 3, 8, 63, 7, 0, 0)), columns((1, 3, 6, 61, 7, 0, 0), (2, 9, 5, 60, 7, 0, 0), (1, 9, 5, 60, 8, 0, 0))]
    assert sorted(zip(*(c.tolist() for c in passages._earliest(held)), strict=True)) == [(1, 3, 6, 61, 7, 0, 0), (1, 9, 5, 60, 8, 0, 0), (2, 9, 5, 60, 7, 0, 0)]
