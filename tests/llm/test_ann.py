import numpy as np
import pytest
from marigrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, part long, dim int, norm double, cell int, copy int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4.0, 5, 6) for i, v in rows], schema).repartition(3)


def brute(rows, asked, k, kind=np.float32):
    fine = {i: np.array(v, kind).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in fine:
            scores = sorted((-(fine[q] * v).sum(), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def searched(table, k):
    got = {}
    for r in ann.search(table, table.filter("vec_id % 20 = 0"), k).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return got


@pytest.mark.parametrize(("cell", "block", "sample"), [(4096, 16_384, 8192), (90, 40, 200)])
def test_recall(spark, monkeypatch, cell, block, sample):
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "SAMPLE", sample)
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((12, 64))
    rows = [(i, (centers[i % 12] + 0.7 * rng.standard_normal(64)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 64), (2060, [float("nan")] * 64), (2080, [float("inf")] + [1.0] * 63), (2100, [None] + [1.0] * 63), (None, rows[1][1]), (2120, [1.0, 2.0]), (2140, [2.0, 0.5]), (20, rows[20][1])]
    got = searched(frame(spark, rows), 20)
    want = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert set(got) == {q for q, v in want.items() if v}
    hits = total = 0
    for q, best in want.items():
        mine = [got[q][r] for r in sorted(got.get(q, {}))]
        assert [r for r in sorted(got.get(q, {}))] == list(range(1, len(best) + 1))
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in mine} & {i for i, _ in best})
        total += len(best)
    assert hits / total >= 0.97


def test_few_are_scored():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    ids, turn, centre = np.arange(4000), ann.rotation(64), np.zeros(64)
    out = list(ann.nearest(ids, x, ann.encode(x, centre, turn), centre, turn, ids[:50], x[:50], np.full(50, -np.inf), 20))
    assert np.mean([n for *_, n in out]) < 0.1 * 4000
    hits = 0
    for q, found, _, _ in out:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(found.tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.97 * 1000


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 64)) * np.exp(rng.standard_normal((500, 1))), rng.standard_normal((20, 64))
    centre, turn = ann.directions(x[:1])[0][0] * 0.3, ann.rotation(64)
    codes = ann.encode(x, centre, turn)
    ones = np.bitwise_count(codes.bits).sum(0, dtype=np.int32)
    unit, _ = ann.directions(q)
    true, off = unit @ x.T * ann._SHRINK, []
    for i, u in enumerate(unit):
        estimate, spread = ann.estimates(codes, ones, float(u @ centre), ann.planes(turn @ u))
        off.append((estimate - true[i]) / spread)
    off = np.array(off)
    assert (np.abs(off) <= ann.BOUND).mean() > 0.96 and (np.abs(off) <= 6).all() and 0.7 < off.std() < 1.2


def test_any_finite_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * s).tolist()) for i, s in enumerate([1e39] * 10 + [1e-200] * 5 + [1.0] * 6 + [1e307] * 3 + [5e-324])]
    schema = SCHEMA.replace("array<float>", "array<double>")
    got = searched(frame(spark, rows, schema), 30)
    with np.errstate(over="ignore", invalid="ignore"):
        want = brute(rows, [0, 20], 30, float)
    for q in (0, 20):
        assert sorted(i for i, _ in got[q].values()) == sorted(i for i, _ in want[q])
        assert not any(np.isnan(s) for _, s in got[q].values())
    few = searched(frame(spark, rows, schema), 3)
    assert [few[20][r][0] for r in (1, 2, 3)] == [i for i, _ in want[20][:3]]


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [2.0, 9.0]), (1, [9.0]), (2, [3.0, 0.0]), (40, [1.0])]
    got = searched(frame(spark, rows), 5)
    assert got[0] == {1: (2, 3.0)} and got[40] == {1: (1, 9.0)}


def test_empty(spark):
    table = frame(spark, [])
    assert ann.search(table, table).count() == 0
    one = frame(spark, [(0, [1.0, 2.0])])
    assert ann.search(one, one).count() == 0
