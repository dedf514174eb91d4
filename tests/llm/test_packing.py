import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.llm import packing
from marigrid.llm.bpe import encoder
from marigrid.llm.queries import vocabulary
from tokenizers import Tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_is_the_plain_rule(lengths):
    window, offset, fill = packing.best_fit(lengths, 64)
    rooms = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(64 - lengths[i])
    assert sorted(64 - f for f in fill) == sorted(rooms)
    seen = defaultdict(list)
    for w, o, n in zip(window, offset, lengths, strict=True):
        seen[w].append((o, n))
    for w, parts in seen.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == fill[w] <= 64


@pytest.mark.parametrize("text", ["Hello world", "a  b", " lead", "trail ", "x\n y", "don't they're", "été 12 345!?", "a b c", "tab\tx y", "<|endoftext|> is special", "é x", "日本 語", "\x1c x", "a  b"])
def test_ids_equal_the_tokenizers(text):
    own = np.frombuffer(encoder(vocabulary()).encode(text), "<u4").tolist()
    assert own == Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_every_id_in_one_piece(docs, odd, prose):
    rows = odd + [(100 + i, prose(20 * i, i)) for i in range(60)]
    got = packing.pack(docs(rows), vocabulary()).collect()
    tok, expected = Tokenizer.from_file(vocabulary()), defaultdict(list)
    for i, t in rows:
        expected[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(expected)
    for i, texts in expected.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            for r in by_doc[i]:
                part = texts[0][r.start : r.start + r.length]
                assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(np.asarray(part, "<u4").tobytes()), len(texts[0]))
    for parts in by_sequence.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048


def test_empty_table(docs):
    assert packing.pack(docs([]), vocabulary()).count() == 0
