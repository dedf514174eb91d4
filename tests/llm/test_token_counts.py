from hypothesis import given, settings
from hypothesis import strategies as st
from marigrid.llm.bpe import read_vocabulary
from marigrid.llm.queries import vocabulary
from marigrid.llm.token_counts import Matcher, token_counts


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        i = max([j for j in range(i + 1, len(word) + 1) if word[i:j] in pieces], default=i + 1)
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.integers(97, 99), max_size=14).map(bytes))
def test_automaton_is_greedy_longest_match(pieces, word):
    whole = pieces | {b"a", b"b", b"c"}
    assert Matcher(sorted(whole)).count(word) == greedy(word, whole)
    assert Matcher(sorted(pieces)).count(word) == greedy(word, pieces)  # also without a full alphabet


def test_rows(docs, odd, prose):
    rows = odd[:6] + odd[7:10] + [(20 + i, prose(50, i)) for i in range(10)]
    pieces = set(read_vocabulary(vocabulary())[0])
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts(docs(rows), vocabulary()).collect())
    expected = []
    for i, t in rows:
        words = (t or "").encode().split()
        expected.append((i or 0, len(words), sum(greedy(b" " + w, pieces) for w in words)))
    assert got == sorted(expected)
    assert token_counts(docs([]), vocabulary()).count() == 0
