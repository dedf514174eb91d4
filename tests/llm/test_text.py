"""Words are hashed a bounded piece at a time, with the same hashes whatever the pieces are."""

import numpy as np
import pyarrow as pa
from marigrid.llm import text


def test_pieces_are_small_and_change_nothing(prose):
    column = pa.array([prose(150, i) for i in range(1500)] + [None, "", prose(150_000, 7), "last"])
    sizes = np.array([len((t or "").encode()) for t in column.to_pylist()])
    assert sizes.sum() > 1 << 21
    raw, at = text.utf8(column)
    whole, rows = text.hashed(raw, at)
    got, last = [], 0
    for base, words, ends in text.word_batches(column):
        assert base == last
        last = base + len(ends) - 1
        assert last == base + 1 or sizes[base:last].sum() <= 1 << 19
        got.append(words)
        assert (rows[base : last + 1] - rows[base] == ends).all()
    assert last == len(column) and (np.concatenate(got) == whole).all()
