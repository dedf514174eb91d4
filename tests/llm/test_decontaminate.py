import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.llm import decontaminate


def infix(item, text):
    """(distance, first end) of the item's best place, by the textbook recurrence."""
    d = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(d[j] + (w != v), d[j + 1] + 1, new[j] + 1))
        d = new
    return min(d), d.index(min(d))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=14))
def test_distance_is_exact(item, text):
    d, s, e = decontaminate.distances(np.array([item], np.uint64), np.array([len(item)]), np.array([text], np.uint64))
    assert (d[0], e[0]) == infix(item, text)
    assert infix(item, text[s[0] : e[0]])[0] == d[0]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_planted_leaks(spark, docs, prose, odd):
    rng = random.Random(8)
    items = [(i, prose(rng.randint(14, 60), 500 + i)) for i in range(40)]
    rows, expected = [], {}
    for i in range(300):
        text = prose(rng.randint(30, 300), i).split()
        if i % 3 == 0:
            item = items[i % 40][1].split()
            edits = (i // 3) % (1 + len(item) // 5)
            copy = list(item)
            for _ in range(edits):
                kind, at = rng.randrange(3), rng.randrange(len(copy))
                if kind == 0:
                    copy[at] = f"q{rng.random()}".replace(".", "")
                elif kind == 1:
                    copy.insert(at, f"q{rng.random()}".replace(".", ""))
                else:
                    del copy[at]
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() if i % 2 and w.isascii() else w + "," for w in copy]
            expected[i, i % 40] = edits
        rows.append((i, " ".join(text)))
    got = decontaminate.leaks(docs(rows + [(1000 + (i or 0), t) for i, t in odd[:6]]), bench(spark, items + [(900, None), (901, ""), (902, "...")])).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    assert set(found) <= set(expected)
    assert len(set(found) & set(expected)) >= 0.97 * len(expected)
    assert all(found[k] <= expected[k] for k in found)
    for r in got:
        assert infix(items[r.item_id][1].lower().split(), [w.lower().strip(",") for w in rows[r.doc_id][1].split()])[0] == r.distance


def test_kept(spark, docs, prose, odd):
    item = prose(30, 77)
    table = docs([*odd, (50, prose(40, 1) + " " + item), (50, item), (51, prose(90, 2))])
    out = decontaminate.kept(table, bench(spark, [(1, item)]))
    assert sorted(out.columns) == sorted(table.columns)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(i) for i, _ in odd] + ["51"])


def test_short_items_and_empty_tables(spark, docs):
    got = decontaminate.leaks(docs([(1, "see the red fox run"), (2, "a red dog")]), bench(spark, [(5, "red fox"), (6, "dog")])).collect()
    assert {(r.doc_id, r.item_id, r.start_word, r.end_word) for r in got} == {(1, 5, 2, 4), (2, 6, 2, 3)}
    assert decontaminate.leaks(docs([]), bench(spark, [(5, "red fox")])).count() == 0
    assert decontaminate.leaks(docs([(1, "a b")]), bench(spark, [])).count() == 0


def test_items_without_id_and_small_blocks(spark, docs, prose, monkeypatch):
    items = [(None, prose(30, 1)), (None, prose(40, 2)), (3, prose(20, 3)), (3, prose(20, 4)), (4, prose(300, 5)), (5, "x,y;" * 20)]
    table = docs([(i, prose(50, 90 + i) + " " + t) for i, (_, t) in enumerate(items)] + [(None, items[2][1])])
    run = lambda: sorted(map(str, decontaminate.leaks(table, bench(spark, items)).drop("distance").collect()))
    whole = run()
    assert len(whole) == 7
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert run() == whole
