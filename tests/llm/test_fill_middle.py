import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from("ab<PSM>é　\x1c😀 \t\n\x0b"), max_size=400)


def plain(doc_id, text):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(tree):
    """Height, units and points of every node."""
    if tree.text is not None:
        assert (tree.height, tree.points) == (0, len(tree.text))
        return
    check(tree.left), check(tree.right)
    assert tree.height == 1 + max(tree.left.height, tree.right.height)
    assert (tree.units, tree.points) == (tree.left.units + tree.right.units, tree.left.points + tree.right.points)
    assert abs(tree.left.height - tree.right.height) <= 1


@settings(deadline=None, max_examples=300)
@given(TEXT, st.integers(0, 10_000), st.integers(1, 9))
def test_rearranged(text, doc_id, size):
    whole = fm.LEAVES
    fm.LEAVES = re.compile(f"(?:{fm._UNIT}){{1,{size}}}+")
    try:
        got = fm.rearranged(doc_id, text, fm.Choice())
        assert got == plain(doc_id, text)
        assert fm.restored(got[-1], got[1]) == text
    finally:
        fm.LEAVES = whole


@settings(deadline=None, max_examples=200)
@given(TEXT, st.lists(st.integers(0, 60), max_size=6))
def test_ropes_stay_balanced(text, cuts):
    units = UNIT.findall(text)
    fm_leaves = [fm.leaf(u, 1) for u in units]
    tree = fm.EMPTY
    for x in fm_leaves:
        tree = fm.join(tree, x)
        check(tree)
    for c in cuts:
        a, b = fm.split(tree, c)
        check(a), check(b)
        assert (str(a), str(b)) == ("".join(units[:c]), "".join(units[c:]))
        assert (a.units, b.units) == (min(c, len(units)), max(len(units) - c, 0))
        p, q = fm.split(fm.rope(text), c, "points")
        assert (str(p), str(q)) == (text[:c], text[c:])
        tree, units = fm.join(b, a), units[c:] + units[:c]
        check(tree)


def test_transform(spark, docs, odd, prose):
    rows = odd + [(100 + i, prose(3 * i, i) + "\n" * (i % 3)) for i in range(120)] + [(300 + i, f"has <{m}> in it") for i, m in enumerate("PSMpsm")]
    got = fm.restore(fm.transform(docs(rows))).collect()
    want = sorted(((i, *plain(i, t or ""), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert max(r.n for r in got) == 30_000


def test_choice(spark, docs, prose):
    rows = [(i, prose(20, i)) for i in range(60)]
    assert {r.form for r in fm.transform(docs(rows), fm.Choice(rate=100, suffix_first=0)).collect()} == {"psm"}
    assert {r.form for r in fm.transform(docs(rows), fm.Choice(rate=0)).collect()} == {"plain"}
    assert fm.transform(docs([])).count() == 0
    none = fm.restore(spark.createDataFrame([(1, None, "psm"), (2, "x", None)], "id int, output string, form string"))
    assert sorted(map(tuple, none.collect())) == [(1, None, "psm", None), (2, "x", None, "x")]
