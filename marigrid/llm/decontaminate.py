"""Operator 1: benchmark passages within an edit distance, by CGK embeddings and bit-sampling LSH."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import small_batches
from marigrid.llm.text import mix, word_batches

#: Share of an item's words that may be edited, and the share of such passages that the LSH has to find.
EDITS, RECALL = 0.2, 0.99
#: Coordinates in a sample, samples of each walk, walks at most.
BITS, SAMPLES, WALKS = 4, 32, 16
#: Items that are sent to the tasks at once, and words of them when all are padded to the longest; one item at least.
BLOCK, BLOCK_WORDS = 5000, 2_000_000
#: Bits of the table of items' words; anchors whose neighbourhoods are looked at at once.
PAIR_BITS, AT_ONCE = 22, 10_000
_PAD = np.uint64(0)
_SHORT = 12
_WORD = re.compile(r"[^\s!-/:-@\[-`{-~]+")


@dataclass
class Items:
    """Word hashes of the items, padded to equal length, and what the windows are compared with."""

    ids: list[int | None]
    words: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    #: Items that the walks can't be trusted with: all their anchored windows are compared.
    sure: np.ndarray
    #: (walks, 3 * longest) salts; (walks, items, 3 * longest) embeddings; (walks, samples, bits) places from 0 to 1.
    salts: np.ndarray
    codes: np.ndarray
    places: np.ndarray
    #: Anchors in order of their hash: the item and the word's place in it.
    anchor: np.ndarray
    anchor_item: np.ndarray
    anchor_at: np.ndarray

    @cached_property
    def members(self) -> np.ndarray:
        """Bits of all (item, word) pairs; other pairs may share one."""
        item, at = np.nonzero(np.arange(self.words.shape[1]) < self.size[:, None])
        bits = np.zeros(1 << PAIR_BITS, bool)
        bits[_pair(item, self.words[item, at])] = True
        return bits


def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mix(word ^ mix(item.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def walk(words: np.ndarray, at: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """CGK embeddings of the strings words[at:end]: each step writes the word read and moves on by a random bit of (step, word)."""
    at = at.copy()
    out = np.zeros((len(at), len(salt)), np.uint64)
    for j, s in enumerate(salt):
        w = np.where(at < end, words[np.minimum(at, len(words) - 1)], _PAD)
        out[:, j] = w
        at += (mix(w ^ s) >> np.uint64(63)).astype(np.int64)
    return out


def collide(code: np.ndarray, other: np.ndarray, size: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether rows agree in all coordinates of one sample at least; the coordinates are places within 3 * size."""
    same = code == other
    hit = np.zeros(len(code), bool)
    row = np.arange(len(code))[:, None]
    for p in places:
        hit |= same[row, (p[None, :] * (3 * size)[:, None]).astype(np.int64)].all(1)
    return hit


def distances(item: np.ndarray, size: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edit distance, start, end) of each item's best place within its region; the first such end, its least start."""
    n, m = region.shape
    one = 1 << 20
    column = np.arange(m + 1)
    d = np.broadcast_to(column, (n, m + 1)).astype(np.int64)
    for i in range(item.shape[1]):
        live = i < size
        step = d + one
        step[:, 1:] = np.minimum(step[:, 1:], d[:, :-1] + one * (item[:, i : i + 1] != region))
        step = np.minimum.accumulate(step - one * column, axis=1) + one * column
        d = np.where(live[:, None], step, d)
    end = (d >> 20).argmin(1)
    best = d[np.arange(n), end]
    return best >> 20, best & (one - 1), end


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(len(out), 1)))
        if kind == 0 and out:
            out[at] = rng.integers(1, 2**63, dtype=np.uint64)
        elif kind == 1:
            out.insert(at, rng.integers(1, 2**63, dtype=np.uint64))
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def prepare(ids: list[int | None], texts: list[str | None], counts: dict[int, int], share: float = EDITS, recall: float = RECALL) -> Items:
    """Items with words, embedded by as many walks as the target recall needs on copies with all edits allowed.

    Short items, whose few coordinates tell little, and those whose own copy no walk finds skip the filter.
    """
    all_words = [w[r[i] : r[i + 1]] for _, w, r in word_batches(pa.array(texts, pa.string()), bare=True) for i in range(len(r) - 1)]
    some = [i for i, w in enumerate(all_words) if len(w)]
    words = [all_words[i] for i in some]
    size = np.array([len(w) for w in words], np.int64)
    edits = np.floor(share * size + 1e-9).astype(np.int64)
    longest = int(size.max()) if len(size) else 1
    table = np.zeros((len(words), longest), np.uint64)
    for r, w in enumerate(words):
        table[r, : len(w)] = w
    rng = np.random.default_rng(11)
    salts = rng.integers(1, 2**63, (WALKS, 3 * longest), dtype=np.uint64)
    places = rng.random((WALKS, SAMPLES, BITS)) * (1 - 1e-9)
    flat, start = (np.concatenate(words), np.concatenate([[0], np.cumsum(size)])) if words else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
    tried = [_edited(w, int(e), rng) for w, e in zip(words, edits, strict=True)]
    other, begin = (np.concatenate(tried), np.concatenate([[0], np.cumsum([len(t) for t in tried])])) if words else (flat, start)
    codes, found = [], np.zeros(len(words), bool)
    for t in range(WALKS if words else 0):
        codes.append(walk(flat, start[:-1], start[1:], salts[t]))
        found |= collide(codes[-1], walk(other, begin[:-1], np.minimum(begin[1:], begin[:-1] + size), salts[t]), size, places[t])
        if found.mean() >= recall and t:
            break
    # at most `edits` words of an item are touched, so one of its edits + 1 rarest places stays as it is
    hashes, owner, place = [], [], []
    for r, w in enumerate(words):
        rare = sorted(range(len(w)), key=lambda p: (counts.get(int(w[p]), 0), p))[: int(edits[r]) + 1]
        hashes += [w[p] for p in rare]
        owner += [r] * len(rare)
        place += rare
    order = np.argsort(np.array(hashes, np.uint64), kind="stable")
    return Items([ids[i] for i in some], table, size, edits, ~found | (size < _SHORT), salts[: len(codes)], np.array(codes), places[: len(codes)], np.array(hashes, np.uint64)[order], np.array(owner, np.int64)[order], np.array(place, np.int64)[order])


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 18, bool)
    bits[(hashes >> np.uint64(46)).astype(np.int64)] = True
    return bits


def _alike(items: Items, words: np.ndarray, rows: np.ndarray, row: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether all that an anchor's windows are compared with holds enough words of the item: size - edits places have one in any match."""
    edits, size = items.edits[item], items.size[item]
    low, high = rows[row], rows[row + 1]
    first = np.maximum(np.clip(begin - edits, low, np.maximum(high - 1, low)) - edits, low)
    last = np.minimum(np.clip(begin + edits, low, np.maximum(high - 1, low)) + size + edits, high)
    out = np.zeros(len(row), bool)
    for some in range(0, len(row), AT_ONCE):
        part = slice(some, some + AT_ONCE)
        n = last[part] - first[part]
        start = np.concatenate([[0], np.cumsum(n)])
        cell = np.arange(start[-1]) + np.repeat(first[part] - start[:-1], n)
        known = np.concatenate([[0], np.cumsum(items.members[_pair(np.repeat(item[part], n), words[cell])])])
        out[part] = known[start[1:]] - known[start[:-1]] >= size[part] - edits[part]
    return out


def matches(items: Items, words: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, distance) of each row's best place of each item within its edits."""
    at = np.flatnonzero(bits[(words >> np.uint64(46)).astype(np.int64)])
    low, high = np.searchsorted(items.anchor, words[at]), np.searchsorted(items.anchor, words[at], "right")
    at, low, high = at[high > low], low[high > low], high[high > low]
    if not len(at):
        return
    n = high - low
    anchor = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    item = items.anchor_item[anchor]
    begin, row = at - items.anchor_at[anchor], np.searchsorted(rows, at, "right") - 1
    near = _alike(items, words, rows, row, item, begin)
    if not near.any():
        return
    item, begin, row = item[near], begin[near], row[near]
    # all windows that can hold the anchor with the edits allowed
    wide = 2 * items.edits[item] + 1
    shift = np.arange(wide.sum()) - np.repeat(np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) - np.repeat(items.edits[item], wide)
    row, item, begin = np.repeat(row, wide), np.repeat(item, wide), np.repeat(begin, wide) + shift
    begin = np.clip(begin, rows[row], np.maximum(rows[row + 1] - 1, rows[row]))
    key = np.unique(np.stack([row, item, begin], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in range(0, len(key), 20_000):
        row, item, begin = key[part : part + 20_000].T
        size, edits = items.size[item], items.edits[item]
        hit = items.sure[item]
        for t, salt in enumerate(items.salts):
            rest = np.flatnonzero(~hit)
            if not len(rest):
                break
            code = walk(words, begin[rest], np.minimum(begin[rest] + size[rest], rows[row[rest] + 1]), salt)
            hit[rest] = collide(code, items.codes[t][item[rest]], size[rest], items.places[t])
        row, item, begin, size, edits = (x[hit] for x in (row, item, begin, size, edits))
        for some in range(0, len(row), 2000):
            r, c = row[some : some + 2000], item[some : some + 2000]
            first = np.maximum(begin[some : some + 2000] - edits[some : some + 2000], rows[r])
            last = np.minimum(begin[some : some + 2000] + size[some : some + 2000] + edits[some : some + 2000], rows[r + 1])
            width = int((last - first).max())
            cell = first[:, None] + np.arange(width)
            region = np.where(cell < last[:, None], words[np.minimum(cell, len(words) - 1)], _PAD)
            d, s, e = distances(items.words[c][:, : int(items.size[c].max())], items.size[c], region)
            for k in np.flatnonzero(d <= items.edits[c]):
                own, found = (int(r[k]), int(c[k])), (int(d[k]), int(first[k] + s[k] - rows[r[k]]), int(first[k] + e[k] - rows[r[k]]))
                if own not in best or found < best[own]:
                    best[own] = found
    for (r, c), (d, s, e) in sorted(best.items()):
        yield r, c, s, e, d


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each of the given words is in all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = _bitmap(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, words, _ in word_batches(batch.column(0), bare=True):
                words = words[bits[(words >> np.uint64(46)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    rows = docs.select("text").mapInArrow(work, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r[0]]): r[1] for r in rows}


SCHEMA = "doc_id long, item_id long, start_word long, end_word long, distance long, item_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, item_words): the best place of each item in each document.

    Words are lower-cased and parted by white space and ASCII punctuation. A place counts within
    floor(``share`` * words of the item) word edits. An item's edits + 1 rarest words in the corpus anchor the
    item-sized windows: one of them is untouched in any such place, so no window is lost. Windows that agree with
    the item in a bit sample of a CGK embedding are verified by exact edit distance. The items, in blocks of
    ``BLOCK``, go to the tasks, like lengths together; documents aren't shuffled. Null and empty texts or
    items match nothing; repeated rows give repeated results; null ids of both stay; other columns are ignored. Very long
    texts are searched whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark.select("item_id", "text").dropna(subset=["text"]).orderBy(F.length("text")).toLocalIterator()):
        texts = [r[1] for r in block]
        vocabulary = np.unique(np.concatenate([w for _, w, _ in word_batches(pa.array(texts, pa.string()), bare=True)]))
        if len(vocabulary):
            items = prepare([r[0] for r in block], texts, _counts(docs, vocabulary), share, recall)
            out = out.unionByName(docs.mapInArrow(_search(items), SCHEMA))
    return out


def _blocks(rows) -> Iterator[list]:
    """Rows, shortest texts first, in blocks of bounded size."""
    block: list = []
    longest = 0
    for r in rows:
        words = max(longest, len(_WORD.findall(r[1])))
        if block and (len(block) == BLOCK or (len(block) + 1) * words > BLOCK_WORDS):
            yield block
            block, words = [], len(_WORD.findall(r[1]))
        block.append(r)
        longest = words
    if block:
        yield block


def _search(items: Items):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bitmap(items.anchor)
        for batch in batches:
            ids = batch.column(0)
            found = [(ids[base + r].as_py(), items.ids[c], s, e, d, int(items.size[c])) for base, words, rows in word_batches(batch.column(1), bare=True) for r, c, s, e, d in matches(items, words, rows, bits)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return work


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark passage; columns stay, whatever their names.

    Rows without an id stay, as do null and empty texts; very long texts are read whole. Of rows with one id all go if one
    of them holds a passage; repeated rows go or stay together. Without items, or without rows, nothing goes.
    """
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
