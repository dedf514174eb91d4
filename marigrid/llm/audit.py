"""Operator 12: how filters interact, from a packed bitmap index of what each of them fails."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import cut, small_batches

#: The filters that look at one text, and the one that compares texts.
FILTERS = "ABCDE"
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of UTF-8 that go on with a code point.
_TAILS = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a whole text fails."""
    words = text.split()  # bytes split at \\x20 and \\x09-\\x0D only
    points = len(text) if text.isascii() else len(text.translate(None, _TAILS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | (symbols > 0) << 3


class Index:
    """A bitmap for each filter and label over rows in order of their part; each part starts at a new 64-bit word.

    ``failed`` and ``labels`` hold a row of flags for each filter or label.
    """

    def __init__(self, parts: np.ndarray, failed: np.ndarray, labels: np.ndarray):
        order = np.argsort(parts, kind="stable")
        self.parts, first, sizes = np.unique(parts[order], return_index=True, return_counts=True)
        words = -(-sizes // 64)
        self.starts = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
        at = np.arange(len(parts)) - np.repeat(first, sizes) + np.repeat(self.starts * 64, sizes)
        self.size = int(words.sum()) * 64
        self.rows = self.bits(at, np.ones(len(parts), bool))
        self.failed = [self.bits(at, f[order]) for f in failed]
        self.labels = [self.bits(at, v[order]) for v in labels]

    def bits(self, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
        wide = np.zeros(self.size, bool)
        wide[at] = flags
        return np.packbits(wide, bitorder="little").view(np.uint64)

    def passes(self) -> list[np.ndarray]:
        """For each subset of the filters, in order of its mask, the rows that pass them all: AND-NOT from a subset with one less."""
        out = [self.rows]
        for mask in range(1, 1 << len(self.failed)):
            low = (mask & -mask).bit_length() - 1
            out.append(out[mask & (mask - 1)] & ~self.failed[low])
        return out

    def counts(self) -> np.ndarray:
        """(parts, subsets, 1 + labels): rows of the part that pass the subset; of those, the rows with each label."""
        return np.stack([np.stack([np.add.reduceat(np.bitwise_count(b).astype(np.int64), self.starts) for b in (p, *(p & v for v in self.labels))], axis=1) for p in self.passes()], axis=1)


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, bits, digest): what each text fails of A to D, and 128 bits that stand for the text. One scan, nothing else.

    Null texts are empty, null parts the empty string; null ids and repeated rows stay.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            bits = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits, digests], names=["doc_id", "part", "bits", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, part string, bits int, digest binary")


def subset_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, passed, good, toxic): for each part, three arrays of 32 counts, one for each subset of the filters as a mask.

    ``passed`` counts the rows that pass all filters of the subset, ``good`` those of them with quality 1, ``toxic``
    those with toxic 1. A text's least id comes from a partial aggregate by digest and is joined back by id, so
    neither many copies nor a large part meet in one task. Each task packs its rows into an ``Index``; its counts are added up.
    A row fails E where a smaller id has the same text; rows without an id have no smaller one. Ids with several labels
    have each label that any of their rows has.
    """
    rows = cut(flagged(docs, id_col, text_col, part_col))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    no = F.lit(False)
    whole = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "part", (F.col("bits") + F.when(F.col("doc_id").isNull() | F.coalesce("first", no), 0).otherwise(16)).alias("bits"), F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("bad"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            bits = batch.column(1).to_numpy()
            failed = np.stack([bits >> i & 1 == 1 for i in range(len(FILTERS))])
            index = Index(coded.indices.to_numpy(), failed, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]))
            counts = index.counts()
            flat = pa.array(counts.reshape(len(counts), -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(index.parts)), flat], names=["part", "counts"])

    many = 3 << len(FILTERS)
    sums = whole.mapInArrow(work, "part string, counts array<long>").select("part", *(F.col("counts")[i].alias(f"c{i}") for i in range(many)))
    sums = sums.groupBy("part").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(many)))
    return sums.select("part", *(F.array(*(f"c{3 * m + j}" for m in range(1 << len(FILTERS)))).alias(name) for j, name in enumerate(("passed", "good", "toxic"))))


def steps(passed: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> Iterator[tuple]:
    """All orders of the filters, step by step, from the counts by subset: what each step keeps, removes and loses."""
    n, everything = len(FILTERS), (1 << len(FILTERS)) - 1
    share = [0] * n
    for mask in range(1 << n):
        orders = factorial(mask.bit_count()) * factorial(n - 1 - mask.bit_count()) if mask != everything else 0
        for i in range(n):
            if not mask >> i & 1:
                share[i] += orders * (passed[mask] - passed[mask | 1 << i])
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after, removed = before | 1 << i, passed[before] - passed[before | 1 << i]
            yield (
                "".join(FILTERS[j] for j in order), step, passed[after], removed, passed[0] - passed[1 << i] - removed, passed[everything ^ 1 << i] - passed[everything],
                good[before] - good[after], toxic[before] - toxic[after], share[i],
            )
            before = after


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step (``SCHEMA``), from ``subset_counts``. No parts give no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        for batch in batches:
            for r in batch.to_pylist():
                columns = zip(*((r["part"], *row) for row in steps(r["passed"], r["good"], r["toxic"])), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return counts.mapInArrow(work, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``interactions`` of the five filters over all documents; edge cases as in ``subset_counts``. Other columns aren't read."""
    return interactions(subset_counts(docs, labels, id_col, text_col, part_col))
