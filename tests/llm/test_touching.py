"""What meets in a cell's region is shuffled once, and joined whatever the chunks and buckets are."""

import numpy as np
import pytest
from marigrid.llm import jaccard
from marigrid.llm.graph import components


def regions_of(rows, k, percent):
    """The sets of nodes that share a region, by plain Python."""
    found = {}
    import pyarrow as pa

    for _, s in jaccard.doc_sets(pa.array([t for _, t in rows]), k):
        if len(s):
            node, keys = jaccard.cell_keys(s, percent, jaccard.Common(np.zeros(0, np.uint64)))
            for key in keys.tolist():
                found.setdefault(key, set()).add(node)
    return [nodes for nodes in found.values() if len(nodes) > 1]


@pytest.mark.parametrize("chunk", [50, 1 << 19])
def test_all_that_meets_is_connected(docs, prose, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "KEYS", chunk)
    rows = []
    for i in range(40):
        text = prose(90, i).split()
        for j in range(i % 5 + 1):
            text[7 * j] = f"edit{j}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, None if i % 2 else "") for i in range(4)]
    named = jaccard._named(docs(rows), "doc_id", "text")
    touching = jaccard._touching(named, np.zeros(0, np.uint64), 3, 80, 16)
    root = {r.node: r.root for r in components(touching).collect()}
    want = regions_of(rows, 3, 80)
    assert want and set(root) == set().union(*want)
    assert all(len({root[n] for n in nodes}) == 1 for nodes in want)
    # and nothing else is: components of the regions themselves
    groups = {}
    for n, r in root.items():
        groups.setdefault(r, set()).add(n)
    for nodes in groups.values():
        inside = [w for w in want if w & nodes]
        assert set().union(*inside) == nodes


def test_keys_are_shuffled_once(spark, docs, prose, monkeypatch):
    """The step before shuffled every key by hash and, past a bound, a second time for the join back."""
    plans = []
    monkeypatch.setattr(jaccard, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = [(i, prose(60, i % 3)) for i in range(9)]
    jaccard._touching(jaccard._named(docs(rows), "doc_id", "text"), np.zeros(0, np.uint64), 3, 80, 16)
    assert len(plans) == 1 and "Join" not in plans[0]
