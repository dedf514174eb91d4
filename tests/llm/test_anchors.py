"""Anchors whose neighbourhood lacks the item's words are told before any window is laid out, and no match is lost."""

import numpy as np
import pyarrow as pa
from marigrid.llm import decontaminate
from marigrid.llm.text import word_batches


def test_unlike_neighbourhoods_are_not_walked(monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    items = [prose(int(n)) for n in rng.integers(14, 60, 30)]
    texts, planted = [], set()
    for r in range(200):
        text = prose(150)
        if r % 4 == 0:
            copy = list(items[r % 30])
            for at in rng.choice(len(copy), len(copy) // 6, replace=False):
                copy[at] = f"q{r}x{at}"
            place = [0, 150, int(rng.integers(150))][r % 3]
            text[place:place] = copy
            planted.add((r, r % 30))
        texts.append(" ".join(text))
    held = decontaminate.prepare(list(range(30)), [" ".join(i) for i in items], {})
    walked = [0]
    walk = decontaminate.walk
    monkeypatch.setattr(decontaminate, "walk", lambda words, at, end, salt: (walked.__setitem__(0, walked[0] + len(at)), walk(words, at, end, salt))[1])
    found = {(b + r, c) for b, words, rows in word_batches(pa.array(texts), bare=True) for r, c, *_ in decontaminate.matches(held, words, rows, decontaminate._bitmap(held.anchor))}
    assert found <= planted and len(found) >= 0.96 * len(planted)
    anchors = sum(int(np.isin(words, held.anchor).sum()) for _, words, _ in word_batches(pa.array(texts), bare=True))
    assert walked[0] < anchors


def test_no_neighbourhood_is_alike():
    held = decontaminate.prepare([7], ["a b c d e f g h i j k l m n"], {})
    ((_, words, rows),) = word_batches(pa.array(["z a z z b z z z c z z"]), bare=True)
    assert list(decontaminate.matches(held, words, rows, decontaminate._bitmap(held.anchor))) == []
