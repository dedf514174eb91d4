"""Vectorised word hashes of whole Arrow batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once, in whole rows; two powers of eight bytes for each of them stay in a worker.
_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes that ``bare`` words don't keep: ASCII other than letters and digits.
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if column.null_count:
        dead = np.flatnonzero(np.asarray(column.is_null()) & (np.diff(at) > 0))
        if len(dead):
            return utf8(pa.array(column.fill_null("").to_pylist(), column.type))
    return raw, at


def hashed(raw: np.ndarray, at: np.ndarray, bare: bool = False, table: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each row, A-Z in lower case, and the rows' offsets in them.

    Words are runs without ASCII white space; with ``bare``, ASCII punctuation parts words too.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    gap = (_SPACE | _PUNCT if bare else _SPACE)[raw]
    word = ~gap
    first = word.copy()
    first[1:] &= gap[:-1]
    heads = at[:-1][at[:-1] < n]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    last = word
    last[:-1] &= gap[1:] | first[1:]
    ends = np.flatnonzero(last)
    up, down = _powers(n + 1)
    total = table[_LOWER][raw]
    total *= up[:n]
    np.cumsum(total, out=total)
    h = total[ends]
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    h = (h - before) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, at)


def pieces(at: np.ndarray, most: int = _BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; at least one row each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_batches(column: pa.Array, bare: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of the rows in them) for ranges of rows of bounded size."""
    raw, at = utf8(column)
    for i, j in pieces(at):
        words, rows = hashed(raw[at[i] : at[j]], at[i : j + 1] - at[i], bare)
        yield i, words, rows


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within rows, and each one's first word; runs across rows are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + words[i : i + n]) * np.uint64(0xA24BAED4963EE407)
    whole = np.ones(n, bool)
    for i in range(1, k):
        cut = rows[1:-1] - i
        whole[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(whole)
    return mix(h[at]), at
