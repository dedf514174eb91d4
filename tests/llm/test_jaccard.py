import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from marigrid.llm import jaccard


def shingle_sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    return out


def brute(rows, k, percent):
    """Components over rows; each row's (n, least id)."""
    sets = shingle_sets(rows, k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(least[find(i)], d)
    return sorted((d if d is not None else -1, len(s), (least[find(i)] if s else d) or 0) for i, (d, s) in enumerate(sets))


def corpus(prose):
    """Families of edited copies from near to far, chains, exact copies, short texts and a shared passage."""
    rng, rows, n = random.Random(3), [], 0
    passage = prose(60, 999)
    for f in range(30):
        base = prose(rng.choice([3, 4, 9, 12, 15, 20, 40, 150, 400]), f).split()
        chain = list(base)
        for e in range(rng.randint(1, 10)):
            copy = list(base)
            for _ in range(e * len(base) // 80):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            rows.append((n, " ".join(copy)))
            chain[rng.randrange(len(chain))] = f"c{f}{e}"
            rows.append((n + 1, " ".join(chain).upper() if e % 2 else " ".join(chain)))
            n += 2
        rows.append((n, passage + " " + " ".join(base)))
        n += 1
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(docs, prose, odd, k, percent):
    rows = corpus(prose) + [((5000 + i) if i is not None else None, t) for i, t in odd]
    got = jaccard.near_duplicates(docs(rows), k=k, percent=percent).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id or 0) for r in got) == brute(rows, k, percent)


def test_split_clusters_lose_no_link(docs, prose, monkeypatch):
    """Clusters over a task's bound go through pivots, and blocks where sets are all alike."""
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 12)
    rng, base, rows = random.Random(1), prose(120, 5).split(), []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = jaccard.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)


def test_large_clusters_shrink_by_pivots(docs, prose, monkeypatch):
    """Chains of edits far from each other's ends: regions of pivots shrink, level by level, and no link is lost."""
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 10)
    monkeypatch.setattr(jaccard, "PIVOTS", 5)
    rng, rows = random.Random(6), []
    for f in range(2):
        text = prose(200, 40 + f).split()
        for i in range(90):
            rows.append((1000 * f + i, " ".join(text)))
            for _ in range(1 + i % 3):
                text[rng.randrange(200)] = f"y{f}-{i}-{rng.random()}"
    got = jaccard.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 90)


def test_pivots_are_used(prose):
    rng, base, sets = random.Random(2), prose(300, 9).split(), []
    for _ in range(30):
        sets.append(np.unique(np.array([hash(tuple(base[j : j + 3])) for j in range(298)], np.int64).view(np.uint64)))
        for _ in range(3):
            base[rng.randrange(300)] = f"z{rng.random()}"
    g = jaccard.Group(sets, 90)
    g.join(np.arange(30))
    assert g.regions[0] > 1 and max(g.regions) >= 1
    jac = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    whole = jaccard.Group(sets, 90)
    for i in range(30):
        whole.link(i, np.array([j for j in range(30) if j != i and jac(sets[i], sets[j])], int))
    assert (g.root == whole.root).all()


@pytest.mark.parametrize("middle", [None, 2])
def test_links_through_rows_without_an_id(docs, prose, middle):
    text = prose(120, 3).split()
    nearer, far = list(text), list(text)
    nearer[50] = far[50] = "one"
    far[90] = "two"
    rows = [(1, " ".join(text)), (middle, " ".join(nearer)), (3, " ".join(far))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, middle: 1, 3: 1}
    assert brute(rows, 3, 90) != brute([rows[0], rows[2]], 3, 90)
    assert {r.doc_id for r in jaccard.kept(docs(rows), k=3, percent=90).collect()} == {1} | ({None} if middle is None else set())


def test_kept_decides_on_each_text_of_an_id(docs, prose):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, b), (None, a), (None, a)]
    got = sorted(((r.doc_id or 0), r.text) for r in jaccard.kept(docs(rows)).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (0, a), (0, a)])


def test_kept(docs, prose, odd):
    rows = corpus(prose) + [(5000 + i if i is not None else None, t) for i, t in odd]
    table = docs(rows)
    kept = jaccard.kept(table)
    assert sorted(kept.columns) == sorted(table.columns)
    ids = {r.doc_id for r in kept.collect()}
    expected = {d for d, n, c in brute(rows, 5, 80) if d >= 0 and (d == c or not n)}
    assert ids - {None} == expected and None in ids


def test_empty_table(docs):
    assert jaccard.near_duplicates(docs([])).count() == 0
