"""Operator 6: token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.bpe import read_vocabulary
from marigrid.llm.common import small_batches

#: Distinct words that a worker keeps.
CACHED_WORDS = 400_000


class Matcher(dict):
    """Word -> number of greedy longest-match pieces, in one pass over the word's bytes.

    A trie of the vocabulary has, at each node, a failure link and the number of pieces that following it pops;
    pieces themselves are never built. A byte that no piece starts with counts as one piece.
    """

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b""):
        super().__init__()
        self.prefix = prefix
        self.next: dict[int, int] = {}
        token = [False]
        parent_byte: list[tuple[int, int]] = [(0, 0)]
        for piece in vocabulary:
            node = 0
            for b in piece:
                key = node << 8 | b
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(token)
                    token.append(False)
                    parent_byte.append((node, b))
                node = child
            if node:
                token[node] = True
        children: list[list[int]] = [[] for _ in token]
        for node, (parent, _) in enumerate(parent_byte[1:], 1):
            children[parent].append(node)
        #: -1: no way on; the pieces popped on the way to the link.
        self.fail, self.popped = [-1] * len(token), [0] * len(token)
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            p, b = parent_byte[v]
            if token[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, popped = self.fail[p], self.popped[p]
            while z >= 0 and (z << 8 | b) not in self.next:
                popped += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.next[z << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; unmatched bytes (only without a full byte alphabet) count one each."""
        node, n, step, fail, popped = 0, 0, self.next, self.fail, self.popped
        i, size = 0, len(word)
        while i < size:
            child = step.get(node << 8 | word[i])
            if child is not None:
                node = child
                i += 1
            elif node == 0:
                n += 1
                i += 1
            elif fail[node] >= 0:
                n += popped[node]
                node = fail[node]
            else:
                # the node's own bytes have no full match: the slow, exact way for this stretch
                return self._slow(word)
        while node:
            if fail[node] < 0:
                return self._slow(word)
            n += popped[node]
            node = fail[node]
        return n

    def _slow(self, word: bytes) -> int:
        n = i = 0
        while i < len(word):
            node, j, best = 0, i, i + 1
            while j < len(word) and (child := self.next.get(node << 8 | word[j])) is not None:
                node, j = child, j + 1
                if self.popped[node] == 1 and self.fail[node] == 0:
                    best = j
            n, i = n + 1, best
        return n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = n = self.count(self.prefix + word)
        return n


_MATCHERS: dict[str, Matcher] = {}


def matcher(path: str) -> Matcher:
    if path not in _MATCHERS:
        _MATCHERS[path] = Matcher(read_vocabulary(path)[0], b" ")
    return _MATCHERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row's whole text.

    A word is a run without ASCII white space; with a blank before it, as byte-level vocabularies mark the start
    of words, it is matched greedily, longest piece first. Null and empty texts count 0. Null ids and repeated
    rows stay; one row out for each row in. There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = matcher(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = text.split() if text else ()
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")
