import random
import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from("aB#é|　\x1c\x85 \t\n\x0b😀Z"), max_size=60))
def test_failures(text):
    assert [audit.failures(text.encode()) >> i & 1 == 1 for i in range(4)] == fails(text)


def test_index():
    rng = np.random.default_rng(3)
    parts = rng.choice([4, 7, 9, 11], 500, p=[0.7, 0.2, 0.098, 0.002])
    failed, labels = rng.random((5, 500)) < 0.3, rng.random((2, 500)) < 0.4
    index = audit.Index(parts, failed, labels)
    counts = index.counts()
    for p, row in zip(index.parts, counts, strict=True):
        for mask in range(32):
            rows = (parts == p) & ~np.any(failed[[i for i in range(5) if mask >> i & 1]], axis=0)
            assert row[mask].tolist() == [rows.sum(), (rows & labels[0]).sum(), (rows & labels[1]).sum()]


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, t in labels if i is not None and t == 1}
    flags = []
    for i, text, part in rows:
        same = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        flags.append((part or "", i, fails(text or "") + [same]))
    out = {}
    for part in {p for p, _, _ in flags}:
        own = [(i, f) for p, i, f in flags if p == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                totals[letter] += len(gone)
                alone = sum(f[k] and sum(f) == 1 for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[k] for _, f in own) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone), letter]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = totals[v[-1]]
    return out


def test_audit(spark, odd, prose):
    rng = random.Random(8)
    texts = [prose(rng.choice([150, 220, 260]), s) for s in range(12)] + ["Word " * 250, "LOUD " * 210, "a b # " * 90]
    rows = [(i, t, rng.choice(["web", "book", None, ""])) for i, t in odd]
    rows += [(100 + i, rng.choice(texts) + rng.choice(["", "", " |", " A" * 40]), rng.choice(["web", "web", "web", "rare"])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (7, 0, 0), (7, 1, 1)]
    docs = spark.createDataFrame([(i, t, "xx", p, 5, True, 3, b"d") for i, t, p in rows], "doc_id long, text string, lang string, source string, bits int, good boolean, part int, digest binary").repartition(5)
    table = spark.createDataFrame([(*r, 9, "z") for r in labels], "doc_id long, quality int, toxic int, first int, part string").repartition(3)
    result = audit.audit(docs, table)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in result.collect()}
    assert result.count() == len(got) == 600 * 4
    assert got == brute(rows, labels)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = audit.audit(one, labels)
    assert got.count() == 600 and {r.part for r in got.collect()} == {""}
