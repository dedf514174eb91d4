"""Operator 7: nearest neighbours by inner product, from randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a code, at least, and bits of a query's coordinate.
BITS, PLANES = 256, 3
#: Width of the error bound in standard deviations.
BOUND = 2.3
#: Vectors that cells and thresholds are fitted on (about; twice as many at most): the documented bound of the sample.
SAMPLE = 8192
#: Vectors of a cell (about), cells at most, vectors of a cell that one task holds, queries that it holds.
CELL, CELLS, BLOCK, QUERIES = 4096, 1024, 16_384, 4096
#: Norms are kept divided by this, so that none of a finite vector overflows.
_SHRINK = 2.0**-16


def rotation(dim: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """The first ``dim`` columns of a random orthogonal matrix with at least ``bits`` rows, a multiple of 64."""
    rows = -(-max(bits, dim) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((rows, dim)))
    return q * np.sign(np.diag(r))


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms times ``_SHRINK``); nothing overflows, whatever the finite components are."""
    top = np.abs(vectors).max(1)
    y = vectors / top[:, None]
    n = np.linalg.norm(y, axis=1)
    return y / n[:, None], top * _SHRINK * n


@dataclass
class Codes:
    """Packed bits as (words, vectors); per vector: norm, scale of the bits' product, standard deviation of its error."""

    bits: np.ndarray
    norm: np.ndarray
    scale: np.ndarray
    spread: np.ndarray


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
    """Signs of the rotated residuals of the directions from ``centre`` (a row, or one for each vector)."""
    unit, norm = directions(vectors)
    rest = unit - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T / np.maximum(length, 1e-300)[:, None]
    bits = len(turn)
    fit = np.where(length > 1e-12, np.abs(turned).sum(1) / math.sqrt(bits), 1.0)
    packed = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    return Codes(np.ascontiguousarray(packed.T), norm, norm * length / (fit * math.sqrt(bits)), norm * length * np.sqrt(np.maximum(1 - fit * fit, 0)) / (fit * math.sqrt(bits - 1)))


def planes(turned: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """A rotated unit query in ``PLANES`` bits a coordinate: (planes of packed bits, least level, step, length of the rest)."""
    low = -2.4 / math.sqrt(len(turned))
    step = -2 * low / (2**PLANES - 1)
    level = np.clip(np.rint((turned - low) / step), 0, 2**PLANES - 1).astype(np.uint8)
    packed = np.stack([np.packbits((level >> j) & 1, bitorder="little").view(np.uint64) for j in range(PLANES)])
    return packed, low, step, float(np.linalg.norm(turned - low - step * level))


def estimates(codes: Codes, ones: np.ndarray, base: float, query: tuple[np.ndarray, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, standard deviations) of a unit query's inner products, in units of ``_SHRINK``.

    ``ones`` counts the codes' bits, ``base`` is the product of query and centre. Bits meet bits: the product
    comes from the counts of ones that a code and each plane of the query share.
    """
    packed, low, step, rest = query
    shared = sum(np.bitwise_count(codes.bits & packed[j][:, None]).sum(0, dtype=np.uint16) * np.float64(1 << j) for j in range(PLANES))
    total = low * packed.shape[1] * 64 + step * sum(int(np.bitwise_count(p).sum()) << j for j, p in enumerate(packed))
    product = 2 * (low * ones + step * shared) - total
    return codes.norm * base + codes.scale * product, np.sqrt(codes.spread**2 + (codes.scale * rest) ** 2)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; where they overflow on the way, from scaled vectors, so never NaN."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (vectors * query).sum(axis=1)
        for i in np.flatnonzero(~np.isfinite(s)):
            a, b = np.abs(vectors[i]).max(), np.abs(query).max()
            s[i] = (vectors[i] / a * (query / b)).sum() * a * b
    return s


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, ids, scores, vectors scored exactly): each query's ``k`` best of a cell's block.

    The ``3 k`` best estimates are scored first; the k-th of those scores or the query's floor is the threshold, and
    of the others only those whose estimate and error bound reach it are scored.
    """
    ones = np.bitwise_count(codes.bits).sum(0, dtype=np.int32)
    unit, norm = directions(queries)
    turned = unit @ turn.T
    base = unit @ centre
    for r, qid in enumerate(query_ids):
        estimate, spread = estimates(codes, ones, float(base[r]), planes(turned[r]))
        estimate[ids == qid] = -np.inf
        top = np.argpartition(estimate, -3 * k)[-3 * k :] if len(ids) > 3 * k else np.arange(len(ids))
        top = top[ids[top] != qid]
        found = scores(vectors[top], queries[r])
        floor = floors[r]
        if len(top) >= k:
            with np.errstate(over="ignore", invalid="ignore"):
                least = np.partition(found, -k)[-k] * _SHRINK / norm[r] * _SHRINK
            floor = max(floor, least - abs(least) * 1e-9) if np.isfinite(least) else floor
        rest = estimate + BOUND * spread >= floor - 1e-300
        rest[top] = False
        rest &= ids != qid
        rest = np.flatnonzero(rest)
        some, score = np.concatenate([top, rest]), np.concatenate([found, scores(vectors[rest], queries[r])])
        best = np.lexsort((ids[some], -score))[:k]
        yield int(qid), ids[some[best]], score[best], len(some)


@dataclass
class Plan:
    """Of the vectors of one length: centres of the cells, and the sample's ids, directions and norms."""

    centres: np.ndarray
    ids: np.ndarray
    units: np.ndarray
    norms: np.ndarray

    def cells(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centres.T).argmax(1)

    def floor(self, query_id: int, unit: np.ndarray, k: int) -> float:
        """The k-th best score of a unit query in the sample: no better than the k-th best of all."""
        s = np.where(self.ids == query_id, -np.inf, self.norms * (self.units @ unit))
        if len(s) <= k:
            return -np.inf
        t = float(np.partition(s, -k)[-k])
        return t - abs(t) * 1e-9


def centres(units: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; one cell is the origin's, so that the codes are those of the directions themselves."""
    if many <= 1:
        return np.zeros((1, units.shape[1]))
    c = units[np.random.default_rng(3).choice(len(units), many, replace=False)]
    for _ in range(rounds):
        at = (units @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, units)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    at = (units @ c.T).argmax(1)
    mean = np.zeros_like(c)
    np.add.at(mean, at, units)
    return mean / np.maximum(np.bincount(at, minlength=many), 1)[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """(dim, rows, vectors) for each length of vectors in a batch."""
    if batch.num_rows:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            part = pa.Table.from_batches([batch]).filter(pa.array(dims == d))
            yield int(d), part, _matrix(part.column("vector"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product in double precision.

    Vectors go to cells of like direction (k-means on a sample of about ``SAMPLE``), once, with their codes. A query
    visits the cells that can hold a score over its floor, the k-th best in the sample; a cell's radius and greatest norm
    say so exactly. There, packed bits give estimates, and their error bounds choose the vectors that are scored.
    Ties go to the smaller id. A query's own id is no candidate. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, as do null ids; vectors only meet queries of their own length. Of rows with
    one id the least vector counts, shorter ones first. Copies of a vector past the ``k + 1`` least ids can't be among the
    nearest and are left out before the search. Scores that overflow are infinite.
    """
    spark = vectors.sparkSession
    single = all(isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) for df in (vectors, queries))
    kind = "array<float>" if single else "array<double>"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(kind)
        fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine).withColumn("dim", F.size("vector"))
        many, different = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
        return rows if many == different else rows.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.vector", "v.dim")

    base, asked = usable(vectors), usable(queries)
    copies = Window.partitionBy("vector").orderBy("vec_id")
    base = base.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    many = {r[0]: r[1] for r in base.groupBy("dim").count().collect()}
    plans = spark.sparkContext.broadcast(_plans(base, many))  # SAMPLE vectors and CELLS centres for each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_dim(batch):
                plan = plans.value.get(d)
                units, norm = directions(x)
                cell = plan.cells(units) if plan else np.zeros(len(x), np.int64)
                radius = np.linalg.norm(units - (plan.centres[cell] if plan else 0), axis=1)
                yield from part.append_column("cell", pa.array(cell.astype(np.int32))).append_column("radius", pa.array(radius)).append_column("norm", pa.array(norm)).combine_chunks().to_batches()

    placed = base.mapInArrow(place, f"vec_id long, vector {kind}, dim int, cell int, radius double, norm double")
    # CELLS rows for each length of vectors
    known = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius"), F.max("norm")).collect()
    sizes = {(r.dim, r.cell): (r[2], r[3], r[4]) for r in known}
    parts = {key: max(1, math.ceil(v[0] / BLOCK)) for key, v in sizes.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {d: np.array([(c, *v) for (e, c), v in sorted(sizes.items()) if e == d]) for d in {d for d, _ in sizes}}
        for batch in batches:
            for d, part, x in _by_dim(batch):
                if d not in table:
                    continue
                plan, cells = plans.value.get(d), table[d]
                units, _ = directions(x)
                ids = part.column("vec_id").to_numpy()
                floors = np.array([plan.floor(i, u, k) for i, u in zip(ids, units, strict=True)]) if plan else np.full(len(x), -np.inf)
                middle = units @ (plan.centres[cells[:, 0].astype(int)].T if plan else np.zeros((d, len(cells))))
                reach = np.minimum(middle + cells[:, 2] + 1e-9, 1 + 1e-9)
                # a negative product is greatest where the norm is least; 0 bounds it
                most = np.maximum(reach, 0) * cells[:, 3]
                row, at = np.nonzero(most >= floors[:, None] - 1e-300)
                split = [(r, int(cells[a, 0]), p) for r, a in zip(row.tolist(), at.tolist(), strict=True) for p in range(parts[d, int(cells[a, 0])])]
                if split:
                    r, c, p = (np.array(v) for v in zip(*split, strict=True))
                    out = part.take(pa.array(r)).append_column("floor", pa.array(floors[r])).append_column("cell", pa.array(c.astype(np.int32))).append_column("part", pa.array(p.astype(np.int32)))
                    yield from out.combine_chunks().to_batches(max_chunksize=4096)

    visiting = asked.mapInArrow(visits, f"vec_id long, vector {kind}, dim int, floor double, cell int, part int")
    split = F.create_map(*[F.lit(v) for (d, c), n in parts.items() if n > 1 for v in (f"{d}-{c}", n)]) if any(n > 1 for n in parts.values()) else None
    pieces = F.coalesce(split[F.concat_ws("-", "dim", "cell")], F.lit(1)) if split is not None else F.lit(1)
    blocks = placed.select("vec_id", "vector", "dim", "cell", F.pmod(F.xxhash64("vec_id"), pieces).cast("int").alias("part"))

    def pair(own: pa.Table, ask: pa.Table) -> pa.Table:
        out: list = []
        if own.num_rows and ask.num_rows:
            ids, x, d = own.column("vec_id").to_numpy(), _matrix(own.column("vector")), int(own.column("dim")[0].as_py())
            plan, turn = plans.value.get(d), rotation(d)
            centre = plan.centres[own.column("cell")[0].as_py()] if plan else np.zeros(d)
            codes = encode(x, centre, turn)
            for s in range(0, ask.num_rows, QUERIES):
                some = ask.slice(s, QUERIES)
                out += nearest(ids, x, codes, centre, turn, some.column("vec_id").to_numpy(), _matrix(some.column("vector")), some.column("floor").to_numpy(), k)
        q = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64) if out else []
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64()), "score": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.float64())})

    keys = ["dim", "cell", "part"]
    found = blocks.groupBy(*keys).cogroup(visiting.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plans(base: DataFrame, many: dict[int, int]) -> dict[int, Plan]:
    """Cells and samples by length of vectors. Lengths that the sample lacks have one cell and no floor."""
    total = sum(many.values())
    if not total:
        return {}
    picked = base.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, total // SAMPLE))) == 0).select("dim", "vec_id", "vector").limit(2 * SAMPLE).toArrow()
    plans = {}
    for batch in picked.combine_chunks().to_batches():
        for d, part, x in _by_dim(batch):
            units, norms = directions(x)
            wanted = min(CELLS, many[d] // CELL, len(units) // 8)
            plans[d] = Plan(centres(units, wanted), part.column("vec_id").to_numpy(), units, norms)
    return plans
