"""Operator 11: exact top-k by inner product of integer vectors, in descending order of length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marigrid.llm.common import small_batches

#: Components are floor(SCALE * x).
SCALE = 1024.0
#: Components of a sample that gives rotations and first floors, about: the documented bound of what reaches the driver.
SAMPLE = 1 << 20
#: A block holds about SPREAD * sqrt(rows) vectors, so that both blocks and their number grow, and this many components at most.
SPREAD, BLOCK = 16, 1 << 21
#: Queries that travel together, and vectors that meet them at a time.
QUERIES, CHUNK = 256, 2048
#: Parts of the rotated dimensions after which residual bounds are looked at.
LEVELS = 4
#: Relative slack of bounds in double precision.
SLACK = 1e-9
_LONG = 2**63 - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold these integers exactly."""
    return np.floor(SCALE * vectors.astype(np.float64))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms that only overflow where the norm itself does."""
    top = np.abs(x).max(1, initial=0.0)
    with np.errstate(over="ignore"):
        return top * np.sqrt(np.square(x / np.where(top > 0, top, 1.0)[:, None]).sum(1))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row inner products as integers; those beyond a long are at its limits."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = float(np.abs(x).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * x.shape[1]
    if most < 2**53:  # every partial sum is an exact double
        return np.einsum("ij,ij->i", x, q).astype(np.int64)
    if most < 2**62 and max(np.abs(x).max(), np.abs(q).max()) < 2**62:
        return np.einsum("ij,ij->i", x.astype(np.int64), q.astype(np.int64))
    sums = (sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x.tolist(), q.tolist(), strict=True))
    return np.array([max(-_LONG, min(_LONG, s)) for s in sums], np.int64)


@dataclass
class Turned:
    """Vectors in descending order of length, their rotated components, and lengths of what is left after each level."""

    ids: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    rotated: np.ndarray
    rests: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, ordered: bool = True) -> Turned:
        x = integers(vectors)
        norms = lengths(x)
        if ordered:
            order = np.lexsort((ids, -norms))
            ids, x, norms = ids[order], x[order], norms[order]
        with np.errstate(over="ignore", invalid="ignore"):
            rotated = x @ rotation
        return cls(ids, x, norms, rotated, [lengths(rotated[:, b:]) for _, b in levels(x.shape[1])])


def levels(dim: int) -> list[tuple[int, int]]:
    """Ranges of the rotated dimensions, strongest first."""
    edges = sorted({dim * i // LEVELS for i in range(LEVELS + 1)})
    return list(zip(edges[:-1], edges[1:], strict=True))


def best(own: Turned, asked: Turned, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(index of the query, id, score, pairs scored exactly): each query's ``k`` best among the vectors.

    Vectors come by descending length, a chunk at a time. A query leaves when its length times the chunk's longest is
    under its floor, the k-th best so far. For the others, sums over the first rotated dimensions plus the product of the
    lengths of what is left (Cauchy-Schwarz) bound every score from above, level by level; pairs whose bound
    reaches the floor are scored in integers.
    """
    floor = floors.astype(np.float64).copy()
    where, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scored = 0
    for s in range(0, len(own.ids), CHUNK):
        e = min(s + CHUNK, len(own.ids))
        with np.errstate(over="ignore", invalid="ignore"):
            there = np.flatnonzero(~(asked.norms * own.norms[s] * (1 + SLACK) < floor))
            if not len(there):
                break  # the vectors that follow are no longer
            least = floor[there] - SLACK * asked.norms[there] * own.norms[s]
            part = np.zeros((e - s, len(there)))
            alive = np.ones(part.shape, bool)
            for (a, b), rest, left in zip(levels(own.x.shape[1]), own.rests, asked.rests, strict=True):
                part += own.rotated[s:e, a:b] @ asked.rotated[there, a:b].T
                alive = ~(part + rest[s:e, None] * left[there] < least)
                if alive.mean() < 1 / 16:
                    break
        alive &= own.ids[s:e, None] != asked.ids[there]
        row, column = np.nonzero(alive)
        for i in range(0, len(row), 65_536):
            r, c = row[i : i + 65_536] + s, there[column[i : i + 65_536]]
            where, ids, score = (np.concatenate(p) for p in ((where, c), (ids, own.ids[r]), (score, exact(own.x[r], asked.x[c]))))
            scored += len(r)
            order = np.lexsort((ids, -score, where))
            where, ids, score = where[order], ids[order], score[order]
            first = np.searchsorted(where, where)
            keep = np.arange(len(where)) - first < k
            where, ids, score = where[keep], ids[keep], score[keep]
            full = np.flatnonzero(np.arange(len(where)) - np.searchsorted(where, where) == k - 1)
            floor[where[full]] = np.maximum(floor[where[full]], score[full])
    return where, ids, score, scored


@dataclass
class Plan:
    """Of the vectors of one length: the rotation and a sample that holds the longest of them."""

    rotation: np.ndarray
    ids: np.ndarray
    x: np.ndarray

    def floors(self, asked: Turned, k: int) -> np.ndarray:
        """Each query's k-th best score in the sample: no better than the k-th best of all."""
        if len(self.ids) <= k:
            return np.full(len(asked.ids), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            s = asked.x @ self.x.T
            s[asked.ids[:, None] == self.ids] = -np.inf
            t = np.partition(np.nan_to_num(s, nan=-np.inf), -k, axis=1)[:, -k]
            return np.clip(t - SLACK * asked.norms * lengths(self.x).max(), -float(_LONG), float(_LONG))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    if batch.num_rows:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims).tolist():
            part = pa.Table.from_batches([batch]).filter(pa.array(dims == d))
            yield d, part, _matrix(part.column("vector"), d)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` greatest inner products of floor(1024 x), exactly.

    One aggregate finds quantiles of the vectors' lengths. Bands between them, split by id where many vectors are of one
    length, are blocks of about ``SPREAD * sqrt(n)`` vectors; a block is one row. A bounded sample with the
    longest vectors gives each query a first floor and the rotation (right singular vectors, strongest first). Queries
    travel in groups of ``QUERIES`` to the blocks whose longest vector can reach their floors, where ``best`` prunes.

    Ties go to the smaller id. A query's own id is no candidate. Vectors that are null or hold a null or non-finite
    component (or one that isn't finite after scaling) take no part, as do null ids; zero and empty vectors do. Vectors only meet
    queries of their own length. Of rows with one id the least vector counts, shorter ones first. Scores
    beyond a long are at its limits. Other columns aren't read. No rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    single = all(isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) for df in (vectors, queries))
    kind = "array<float>" if single else "array<double>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(kind)
        fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")))
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine).withColumn("dim", F.size("vector"))
        many, different = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
        return rows if many == different else rows.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.vector", "v.dim")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, x in _by_dim(batch):
                yield from part.append_column("norm", pa.array(lengths(integers(x)))).combine_chunks().to_batches()

    measured = usable(vectors).mapInArrow(measure, f"vec_id long, vector {kind}, dim int, norm double")
    # one row for each length of vectors; the quantiles are a mergeable sketch of bounded size
    known = {r.dim: (r.n, r.edges) for r in measured.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("norm", [i / 256 for i in range(1, 256)], 2048).alias("edges")).collect()}
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = {d: max(1, min(math.ceil(SPREAD * math.sqrt(n)), BLOCK // max(d, 1))) for d, (n, _) in known.items()}
    edges = {d: np.unique(e[max(1, 256 * size[d] // n) - 1 :: max(1, 256 * size[d] // n)]) for d, (n, e) in known.items()}
    plans = spark.sparkContext.broadcast(_plans(measured, known))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, _ in _by_dim(batch):
                at = np.searchsorted(edges[d], part.column("norm").to_numpy(), "left")
                yield from part.append_column("band", pa.array(at.astype(np.int32))).combine_chunks().to_batches()

    banded = measured.mapInArrow(band, f"vec_id long, vector {kind}, dim int, norm double, band int")
    # at most 256 rows for each length of vectors
    sizes = {(r.dim, r.band): (max(1, math.ceil(r.n / size[r.dim])), r.norm) for r in banded.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("dim").to_pylist(), batch.column("band").to_pylist(), strict=True)
            many = np.array([sizes[key][0] for key in keys], np.uint64)
            mixed = batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mixed % many).astype(np.int32))], names=[*batch.schema.names, "part"])

    def block(rows: pa.Table) -> pa.Table:
        d = rows.column("dim")[0].as_py()
        x = _matrix(rows.column("vector"), d)
        first = {n: rows.column(n).slice(0, 1) for n in ("dim", "band", "part")}
        return pa.table(first | {"ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), "block": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    keys = ["dim", "band", "part"]
    dealt = banded.mapInArrow(deal, f"vec_id long, vector {kind}, dim int, norm double, band int, part int")
    blocks = dealt.groupBy(*keys).applyInArrow(block, "dim int, band int, part int, ids binary, block binary")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_dim(batch):
                if d not in known:
                    continue
                longest = [(b, v[0], v[1]) for (e, b), v in sorted(sizes.items(), reverse=True) if e == d]
                for s in range(0, len(x), QUERIES):
                    ids = part.column("vec_id").to_numpy()[s : s + QUERIES]
                    asked = Turned.of(ids, x[s : s + QUERIES], plans.value[d].rotation, ordered=False)
                    floors = plans.value[d].floors(asked, k)
                    for b, many, norm in longest:
                        with np.errstate(over="ignore", invalid="ignore"):
                            go = ~(asked.norms * norm * (1 + SLACK) < floors)
                        if go.any():
                            packed = [ids[go].tobytes(), np.ascontiguousarray(x[s : s + QUERIES][go]).tobytes(), floors[go].tobytes()]
                            for p in range(many):
                                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b], pa.int32()), pa.array([p], pa.int32()), *(pa.array([v], pa.binary()) for v in packed)], names=[*keys, "query_ids", "queries", "floors"])

    visiting = usable(queries).mapInArrow(visits, "dim int, band int, part int, query_ids binary, queries binary, floors binary")
    real = np.float32 if single else np.float64

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for r in batch.to_pylist():
                rotation, key = plans.value[r["dim"]].rotation, (r["dim"], r["band"], r["part"])
                of = lambda ids, x, ordered: Turned.of(np.frombuffer(ids, np.int64), np.frombuffer(x, real).reshape(-1 if r["dim"] else len(ids) // 8, r["dim"]), rotation, ordered)  # noqa: B023, E731
                if at != key:  # a block's rows come one after the other
                    at, own = key, of(r["ids"], r["block"], True)
                asked = of(r["query_ids"], r["queries"], False)
                where, ids, score, _ = best(own, asked, np.frombuffer(r["floors"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[where]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = blocks.join(visiting, keys).mapInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plans(measured: DataFrame, known: dict) -> dict[int, Plan]:
    """Rotations and samples: of each length's vectors the longest and some chosen by id, about ``SAMPLE`` components in all."""
    share = {d: max(16, SAMPLE // len(known) // max(d, 1) // 2) for d in known}
    # lengths over the quantile that half a sample exceeds; of many vectors of one length, the limit leaves some out
    cut = {d: e[min(254, max(0, 256 - math.ceil(256 * share[d] / n) - 1))] for d, (n, e) in known.items()}
    thin = {d: max(1, math.ceil(n / share[d])) for d, (n, _) in known.items()}
    wanted = (F.pmod(F.xxhash64("vec_id", F.lit(11)), _by(thin, "long")) == 0) | (F.col("norm") >= _by(cut, "double"))
    picked = measured.filter(wanted).select("dim", "vec_id", "vector").limit(sum(3 * s for s in share.values())).toArrow()
    plans = {d: Plan(np.eye(d), np.zeros(0, np.int64), np.zeros((0, d))) for d in known}
    for batch in picked.combine_chunks().to_batches():
        for d, part, raw in _by_dim(batch):
            x = integers(raw)
            top = np.abs(x).max(initial=0.0) or 1.0
            _, turn = np.linalg.eigh((x / top).T @ (x / top)) if d else (None, np.eye(0))
            plans[d] = Plan(np.ascontiguousarray(turn[:, ::-1]), part.column("vec_id").to_numpy(), x)
    return plans


def _by(values: dict[int, float], kind: str):
    """A column that reads ``values`` by dim."""
    return F.create_map(*(F.lit(v) for pair in values.items() for v in pair))[F.col("dim")].cast(kind)
