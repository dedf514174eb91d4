import math
import random

import numpy as np
import pytest
from marigrid.llm import inner_products as ip

SCHEMA = "vec_id long, embedding array<{}>, label int, part long, dim int, norm double, band int, rank int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4.0, 5, 6) for i, v in rows], SCHEMA.format(kind)).repartition(3)


def brute(rows, asked, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(math.isfinite(x) for x in v):
            whole = [math.floor(1024 * float(x)) for x in v]
            fine[i] = min(fine[i], whole, key=lambda w: (len(w), w)) if i in fine else whole
    out = {}
    for q in asked:
        if q in fine:
            found = [(-max(-ip._LONG, min(ip._LONG, sum(a * b for a, b in zip(fine[q], v, strict=True)))), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: v for q, v in out.items() if v}


def searched(table, every, k):
    got = {}
    for r in ip.search(table, table.filter(f"vec_id % {every} = 0"), k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [v[i] for i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize(("spread", "chunk", "queries", "sample"), [(16, 2048, 256, 1 << 20), (1, 7, 3, 400)])
def test_exact(spark, monkeypatch, spread, chunk, queries, sample):
    for name, value in (("SPREAD", spread), ("CHUNK", chunk), ("QUERIES", queries), ("SAMPLE", sample)):
        monkeypatch.setattr(ip, name, value)
    rng = np.random.default_rng(1)
    # lengths from a heavy tail, a third of the rows one vector, negative and zero vectors, other lengths, odd ones
    rows = [(i, (rng.standard_normal(16) * rng.pareto(2.0)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(200)]
    rows += [(800 + i, [0.0] * 16) for i in range(15)] + [(-20 * i, [-0.25] * 16) for i in range(1, 4)]
    rows += [(2000, None), (2020, []), (2040, []), (2060, [float("nan")] * 16), (2080, [float("inf")] + [1.0] * 15), (2100, [None] + [1.0] * 15), (None, rows[1][1]), (2120, [1.0, 2.0]), (2140, [2.0, 0.5]), (2160, [7.0]), (20, rows[20][1])]
    got = searched(frame(spark, rows), 20, 10)
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 10)


def test_beyond_a_long(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12 if i % 2 else 200) for _ in range(6)]) for i in range(60)]
    assert searched(frame(spark, rows, "double"), 20, 10) == brute(rows, {0, 20, 40}, 10)


def test_empty(spark):
    table = frame(spark, [])
    assert ip.search(table, table).collect() == []
    one = frame(spark, [(100, [1.0, 2.0])])
    assert ip.search(one, one).collect() == []


def test_lengths_and_residuals_prune():
    rng = np.random.default_rng(2)
    # strong first directions and lengths of a heavy tail: both bounds bite
    x = rng.standard_normal((6000, 64)) * np.exp(-np.arange(64) / 6) * (0.2 + rng.pareto(3.0, 6000))[:, None]
    ids = np.arange(6000)
    _, turn = np.linalg.eigh(ip.integers(x).T @ ip.integers(x))
    own, asked = ip.Turned.of(ids, x, turn[:, ::-1]), ip.Turned.of(ids[:50], x[:50], turn[:, ::-1], ordered=False)
    plan = ip.Plan(turn[:, ::-1], own.ids[:500], own.x[:500])
    where, found, score, scored = ip.best(own, asked, plan.floors(asked, 10), 10)
    assert scored < 0.05 * 50 * 6000
    whole = ip.integers(x)
    for q in range(50):
        s = (whole @ whole[q]).astype(int)
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if i != q)[:10]
        assert list(zip(found[where == q].tolist(), score[where == q].tolist(), strict=True)) == [(i, -v) for v, i in want]
