"""Operator 9: exact Jaccard join of word shingles as a join in a metric space.

Texts of unrelated documents are all at distance 1 from any pivot, so that windows around document pivots alone
would hold everything. A prefilter in another metric goes first: the symmetric difference adds up over the cells of a
partition of the shingles. Two sets within the threshold differ in at most D shingles; with D + 1 + g cells, g + 1 cells
at least hold the same of both. Each set enters the regions of all its cells but the g least ones, by (rare shingles,
size, cell): the greatest of the cells that agree is never among those, on either side. Which shingles count as rare
changes how many documents meet by chance, never the result. Documents that meet in a cell touch; those that touches
connect form a cluster.

A cluster of two is compared. Larger ones are joined by document pivots: each set goes to the Voronoi region of its
nearest pivot and, by the triangle inequality, to every region whose pivot is at most twice the threshold further away;
regions are joined the same way with pivots of their own, down to pairs. Clusters and regions too large for a task do so
as Spark jobs, a level at a time. What a pivot's ball holds is one component, so only pairs of different components are
still looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marigrid.llm.common import BROADCAST_IDS, cut, narrowed, small_batches
from marigrid.llm.graph import components
from marigrid.llm.passages import _edges, _equal, _groups, _packed, _whole
from marigrid.llm.text import mix, shingles, word_batches

K, PERCENT = 3, 90
#: Documents and shingles of a cluster that one task joins; larger ones are split.
GROUP_DOCS, GROUP_ITEMS = 3000, 2_000_000
#: Pivots of a region; levels of regions between tasks before what is left goes in pairs of blocks; node hashes a task remembers.
PIVOTS, LEVELS, SEEN = 8, 6, 1 << 20
#: Sets from which on a shingle is a column of the matrix.
DENSE = 16
#: Bytes of pivots that are broadcast, at most.
PIVOT_BYTES = 64 << 20
#: Common shingles that tasks are sent, at most, and shingles among which a task counts them.
COMMON, CHUNK = 200_000, 4_000_000
#: Keys of regions that a task deals out at once, and of a bucket (about); bytes of a key that are sent, the rest gives the
#: bucket. Keys that these can't tell apart only let more documents touch.
KEYS, BUCKET, BYTES = 1 << 19, 1 << 18, 5
#: Size classes grow by half.
_CLASSES = [1]
while _CLASSES[-1] < 2**40:
    _CLASSES.append(_CLASSES[-1] * 3 // 2 + 1)
_CLASSES = np.array(_CLASSES)


def doc_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer than ``k`` words are one shingle of their own kind."""
    for base, words, rows in word_batches(column):
        h, at = shingles(words, rows, k)
        cuts = np.searchsorted(at, rows)
        for i in range(len(rows) - 1):
            n = rows[i + 1] - rows[i]
            if n >= k:
                s = np.sort(h[cuts[i] : cuts[i + 1]])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif n:
                s = np.array([n], np.uint64)
                for w in words[rows[i] : rows[i + 1]]:
                    s = mix((s + w) * np.uint64(0x9FB21C651E98DF25))
            else:
                s = np.zeros(0, np.uint64)
            yield base + i, s


def set_hash(s: np.ndarray) -> int:
    return _finish(mix(s).sum(dtype=np.uint64), len(s))


def _finish(total: np.uint64, n: int) -> int:
    return int(mix(np.array([total], np.uint64) + np.uint64(n)).view(np.int64)[0])


@lru_cache(maxsize=200)
def _cells(cls: int, percent: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(cells that each set leaves out, the cells' inner edges, their salts) of a size class; None if only equal sets link."""
    differ = (100 - percent) * 2 * (int(_CLASSES[cls + 1]) - 1) // (100 + percent)
    if not differ:
        return None
    spare = differ // 2 + 1
    cells = differ + 1 + spare
    return spare, np.arange(1, cells, dtype=np.uint64) * np.uint64(2**64 // cells), mix(np.arange(cells, dtype=np.uint64) + np.uint64(cls << 40))


class Common:
    """Shingles that many documents have."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def rare(self, s: np.ndarray) -> np.ndarray:
        out = ~self.bits[(s >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(~out)
        if len(at):
            out[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, s[at]), len(self.hashes) - 1)] != s[at]
        return out


def cell_keys(s: np.ndarray, percent: int, common: Common) -> tuple[int, np.ndarray]:
    """The set's hash and the keys of its regions: its cells in its size class, and in the next class if a partner can be there.

    A pair meets in the class of its larger set, whose number of cells exceeds the differences it may have.
    """
    n = len(s)
    c = int(np.searchsorted(_CLASSES, n, "right")) - 1
    out = []
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(s))])
    rare = np.concatenate([[0], np.cumsum(common.rare(s))])
    for cls in (c, c + 1) if 100 * n >= percent * int(_CLASSES[c + 1]) else (c,):
        if plan := _cells(cls, percent):
            spare, inner, salts = plan
            edges = np.concatenate([[0], np.searchsorted(s, inner), [n]])
            rank = (rare[edges[1:]] - rare[edges[:-1]]) * (n + 1) + edges[1:] - edges[:-1]
            use = np.argsort(rank, kind="stable")[spare:]
            out.append(mix(mixed[edges[use + 1]] - mixed[edges[use]] + salts[use]))
    return _finish(mixed[-1], n), np.concatenate(out) if out else np.zeros(0, np.uint64)


class Group:
    """The sets of a cluster in memory; ``forest`` gets the links that join components."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.size)])
        self.values = np.concatenate(sets)
        self.percent, self.within = percent, 1 - percent / 100 + 1e-9
        self.root = np.arange(len(sets))
        self.forest: list[tuple[int, int]] = []
        #: Regions of each level of pivots.
        self.regions: dict[int, int] = {}

    def link(self, i: int, js: np.ndarray) -> None:
        for j in js:
            if self.root[i] != self.root[j]:
                self.forest.append((i, int(j)))
                a, b = sorted((self.root[i], self.root[j]))
                self.root[self.root == b] = a

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances of set i to ``others``; those within the threshold are linked."""
        own = self.values[self.starts[i] : self.starts[i + 1]]
        if len(others) * 4 >= len(self.size):
            hit = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, self.values), len(own) - 1)] == self.values)])
            common = (hit[self.starts[1:]] - hit[self.starts[:-1]])[others]
        else:
            common = np.array([np.isin(self.values[self.starts[j] : self.starts[j + 1]], own, assume_unique=True).sum() for j in others])
        union = len(own) + self.size[others] - common
        self.link(i, others[(100 * common >= self.percent * union) & (others != i)])
        return 1 - common / union

    def join(self, some: np.ndarray, least: int = 2, pivots: int = 6, level: int = 0) -> None:
        """Regions of the nearest pivot, with the window around them, recursively, down to pairs; dense ones are compared at once."""
        if len(np.unique(self.root[some])) < 2:
            return
        if len(some) > least:
            at = some[np.unique(np.linspace(0, len(some) - 1, min(pivots, len(some) // 2 + 1)).astype(int))]
            d = np.stack([self.distances(int(p), some) for p in at])
            home = d.min(0)
            regions = [some[r <= home + 2 * self.within] for r in d]
            self.regions[level] = self.regions.get(level, 0) + len(regions)
            if max(map(len, regions)) < len(some) and sum(len(r) ** 2 for r in regions) < 0.8 * len(some) ** 2:
                for region in regions:
                    self.join(region, least, pivots, level + 1)
                return
        if len(np.unique(self.root[some])) > 1:
            self.compare(some)

    def compare(self, some: np.ndarray) -> None:
        """All pairs at once: the intersections' sizes are a product of the membership matrix with itself.

        Shingles in many sets go through dense blocks of the matrix, the others add to their pairs.
        """
        m = len(some)
        values = np.concatenate([self.values[self.starts[i] : self.starts[i + 1]] for i in some])
        owner = np.repeat(np.arange(m), self.size[some])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        many = np.diff(np.concatenate([head, [len(values)]]))
        common = np.zeros((m, m), np.float32)
        thick = np.flatnonzero(many >= DENSE)
        for s in range(0, len(thick), 4096):
            block = np.zeros((m, min(4096, len(thick) - s)), np.float32)
            for c, j in enumerate(thick[s : s + 4096]):
                block[owner[head[j] : head[j] + many[j]], c] = 1
            common += block @ block.T
        thin = np.zeros((m, m), np.float32)
        for f in range(2, DENSE):
            at = head[many == f]
            for s in range(0, len(at), 500_000 // f):
                sets = owner[at[s : s + 500_000 // f, None] + np.arange(f)]
                for i in range(f):
                    for j in range(i + 1, f):
                        np.add.at(thin, (sets[:, i], sets[:, j]), 1)
        common += thin + thin.T
        size = self.size[some].astype(np.float64)
        for i in range(m):
            near = np.flatnonzero(100 * common[i].astype(np.float64) >= self.percent * (size[i] + size - common[i]))
            self.link(int(some[i]), some[near[near != i]])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _node_sets(k: int):
    """(node, items) of documents: the set's hash and its shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(set_hash(s), s.tobytes()) for _, s in doc_sets(batch.column(1), k) if len(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["node", "items"])

    return sets


TOUCH = "bucket int, key binary, node binary"


def _met(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the least node of each, the other nodes, the least node of the key of each of these)."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    edge = _edges(key)
    least = np.minimum.reduceat(node, edge[:-1])
    first = np.repeat(least, np.diff(edge))
    more = node != first
    return key[edge[:-1]], least, node[more], first[more]


def _touching(docs: DataFrame, hashes: np.ndarray, k: int, percent: int, buckets: int) -> DataFrame:
    """(a, b): members b of cells' regions with a member a of the same; they connect what meets in a region.

    A task joins what meets among the sets of a chunk and sends each key once, with its least node; the rest meets in the
    key's bucket. So keys are shuffled once, packed, and a hot one costs a bucket one node a chunk.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hashes)  # COMMON longs at most
    wide = np.uint64(1 << 8 * (8 - BYTES))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen, held, n = Common(sent.value), set(), [], 0
        for batch in batches:
            for _, s in doc_sets(batch.column(1), k):
                if len(s) and (node := set_hash(s)) not in seen:  # copies are one node
                    seen = seen if len(seen) < SEEN else set()
                    seen.add(node)
                    held.append(cell_keys(s, percent, common))
                    n += len(held[-1][1])
                    if n >= KEYS:
                        yield from dealt(held)
                        held, n = [], 0
        if n:
            yield from dealt(held)

    def dealt(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        node = np.repeat(np.array([v for v, _ in held], np.int64), [len(f) for _, f in held])
        key, least, b, a = _met(np.concatenate([f for _, f in held]), node)
        yield from _packed(((key % wide) % np.uint64(buckets)).astype(np.int32), [(key, 8 - BYTES), (least, 0)], TOUCH)
        if len(b):  # what has met goes along, in buckets under 0
            yield from _packed((-1 - a % buckets).astype(np.int32), [(a, 0), (b, 0)], TOUCH)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, key, node in _groups(batches, 1):
            for s, e in _equal(bucket):
                a, b = _whole(key[s:e], np.uint64, 0 if bucket[s] < 0 else 8 - BYTES), _whole(node[s:e], np.int64)
                if bucket[s] < 0:
                    a = a.view(np.int64)
                else:
                    _, _, b, a = _met(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    regions = docs.mapInArrow(keys, TOUCH)
    return cut(regions.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, "a long, b long").distinct())


def _roots(docs: DataFrame, digest: DataFrame, hashes: np.ndarray, k: int, percent: int) -> DataFrame:
    """(node, root) of set hashes with a link: the least hash of their component."""
    shingled = digest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, shingled * (100 - percent) // 40 // BUCKET)  # about a half of the shingles' number are keys at 80 %
    clusters = cut(components(_touching(docs, hashes, k, percent, buckets)))
    nodes = digest.join(clusters, digest.node == clusters.node, "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    nodes = cut(nodes.join(clusters, "node"))
    few = nodes.count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda df: df
    named = narrowed(docs, nodes.select("doc_id").dropna().distinct(), "doc_id").mapInArrow(_node_sets(k), "node long, items binary")
    # a set that only rows without an id have
    nameless = docs.filter("doc_id is null").mapInArrow(_node_sets(k), "node long, items binary").join(near(nodes.filter("doc_id is null").select("node")), "node", "left_semi").dropDuplicates(["node"])
    chosen = named.unionByName(nameless).join(near(nodes.select("node", "root")), "node")
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("items"))
    large = cut(sizes.filter(_too_large()).select("root"))
    small = chosen.join(large, "root", "left_anti").select("root", "node", "items")
    found = small.groupBy("root").applyInArrow(_grouped(percent, True), "node long, root long")
    if large.limit(1).count():
        found = found.unionByName(components(_large(chosen.join(large, "root", "left_semi").select(F.col("root").cast("string").alias("region"), "node", "items"), percent)))
    return found


def _too_large():
    return (F.col("docs") > GROUP_DOCS) | (F.col("items") > GROUP_ITEMS)


def _grouped(percent: int, whole: bool):
    """Links (a, b) of a part of a cluster; of a ``whole`` one, (node, root) of the linked."""

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, order = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows count once
        items = group.column("items")
        g = Group([np.frombuffer(items[int(i)].as_buffer(), np.uint64) for i in order], percent)
        g.join(np.arange(len(ids)))
        if whole:
            # ids are in order, so the least place of a component is its least id
            linked = np.flatnonzero(np.bincount(g.root, minlength=len(ids))[g.root] > 1)
            return pa.table({"node": ids[linked], "root": ids[g.root[linked]]})
        return pa.table({"a": pa.array([ids[i] for i, _ in g.forest], pa.int64()), "b": pa.array([ids[j] for _, j in g.forest], pa.int64())})

    return work


def _large(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of regions too large for a task, a level of pivots at a time.

    Each region's pivots are the sets of least hash; a set goes to its nearest pivot's region and to those within the
    triangle inequality's window, and is linked to the pivots in whose ball it is. Regions that fit a task are joined
    there; those that one ball holds whole are done. Regions that no longer shrink (sets all alike) and those left
    after ``LEVELS`` levels are joined in pairs of blocks, which is as exact.
    """
    within = 1 - percent / 100 + 1e-9
    links, level = [], 0
    while True:
        rows = cut(rows.dropDuplicates(["region", "node"]))
        order = F.xxhash64("node", F.lit(level))
        least = rows.groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(order.alias("o"), "node")).alias("p"))
        chosen = cut(least.select("region", F.col("p.node").alias("node")))
        pivots = rows.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, ["region", "node"]).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "items"))).alias("pivots"))  # PIVOTS sets

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for region, node, items, near in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    own = np.frombuffer(items, np.uint64)
                    d = []
                    for p in near:
                        other = np.frombuffer(p["items"], np.uint64)
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        d.append(1 - common / max(1, len(own) + len(other) - common))
                    out += [(f"{region}/{j}", node, items, near[j]["node"], x <= within) for j, x in enumerate(d) if x <= min(d) + 2 * within]
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["region", "node", "items", "pivot", "ball"])

        few = pivots.agg(F.coalesce(F.sum(F.expr("aggregate(pivots, 0L, (a, p) -> a + length(p.items))")), F.lit(0))).first()[0] <= PIVOT_BYTES
        placed = cut(rows.join(F.broadcast(pivots) if few else pivots, "region").select("region", "node", "items", "pivots").mapInArrow(seen, "region string, node long, items binary, pivot long, ball boolean"))
        links.append(placed.filter("ball and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("items") / 8).alias("items"), F.min("ball").alias("whole"))
        before = rows.groupBy("region").agg(F.count(F.lit(1)).alias("before"))
        parts = F.ceil(F.greatest(F.col("docs") / (GROUP_DOCS // 2), F.col("items") / (GROUP_ITEMS // 2))).cast("int")
        sizes = sizes.withColumn("parent", F.regexp_replace("region", "/[0-9]+$", "")).join(before.withColumnRenamed("region", "parent"), "parent")
        todo = cut(sizes.filter(~F.col("whole") & (F.col("docs") > 1)).select("region", (F.col("docs") > 0.8 * F.col("before")).alias("stuck"), _too_large().alias("large"), parts.alias("parts")))
        of = lambda condition, placed=placed, todo=todo: placed.select("region", "node", "items").join(F.broadcast(todo.filter(condition)) if todo.count() <= BROADCAST_IDS else todo.filter(condition), "region")
        links.append(of("not large").select("region", "node", "items").groupBy("region").applyInArrow(_grouped(percent, False), "a long, b long"))
        level += 1
        rest = "large and stuck" if level < LEVELS else "large"
        block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.concat_ws("-", "region", F.least(block, j), F.greatest(block, j)))
        links.append(of(rest).select(F.explode(pair).alias("region"), "node", "items").groupBy("region").applyInArrow(_grouped(percent, False), "a long, b long"))
        if level == LEVELS or not todo.filter("large and not stuck").limit(1).count():
            break
        rows = of("large and not stuck").select("region", "node", "items")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Texts are lower-cased in A-Z and split at ASCII white space; a set holds the distinct runs of ``k`` words, or
    the whole sequence if it is shorter. Texts link when 100 * intersection >= ``percent`` * union. The component's
    id is the least doc_id that links reach. Null and empty texts have 0 shingles and are their own component.
    Rows with a null id take part in links; they get the component's id (null if all of it have none). Repeated rows
    each give a row. Very long texts are read whole. Shingles and sets are compared by 64-bit hashes.
    """
    return _classes(_named(docs, id_col, text_col), k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, node, component_id) of every row; ``node`` is the hash of its set."""
    small_batches(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, items = set(), [], 0
        for batch in batches:
            out = []
            for _, s in doc_sets(batch.column(1), k):
                out.append((len(s), set_hash(s)))
                if out[-1][1] not in seen:
                    seen.add(out[-1][1])
                    held.append(s)
                    items += len(s)
            yield rows(batch.column(0), [n for n, _ in out], [h for _, h in out], False)
            if items > CHUNK:
                yield repeated(held)
                seen, held, items = set(), [], 0
        if held:
            yield repeated(held)

    def rows(ids, n, node, common: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([common] * len(ids), pa.bool_())], names=["doc_id", "n", "node", "common"])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= 3
        return rows(pa.nulls(int(some.sum()), pa.int64()), n[some], values[some].view(np.int64), True)

    both = cut(docs.mapInArrow(digests, "doc_id long, n long, node long, common boolean"))
    digest = both.filter("not common").drop("common")
    often = both.filter("common").groupBy("node").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "node").limit(COMMON)
    hashes = np.array([r[0] for r in often.select("node").collect()], np.int64).view(np.uint64)
    full = digest.filter("n > 0")
    roots = cut(_roots(docs, full, hashes, k, percent))
    # by node, so that copies are combined before anything is shuffled; only what differs from the row's own id is joined back
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    rooted = nodes.join(roots, "node", "left").select("node", "least", "rows", "root")
    first = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    changed = rooted.filter("root is not null or rows > 1").join(first, "root", "left").select("node", F.coalesce("first", "least").alias("component_id"))
    changed = cut(changed)
    changed = F.broadcast(changed) if changed.count() <= BROADCAST_IDS else changed
    return digest.join(changed, "node", "left").select("doc_id", "n", "node", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates: the one with the least doc_id; columns stay, whatever their names.

    Rows without words and rows without an id stay. If an id is there more than once, each of its texts is decided on by
    itself, and of rows with equal id and text one stays. Null, empty and very long texts are as in ``near_duplicates``.
    """
    found = cut(_classes(_named(docs, "doc_id", "text"), k, percent).filter("doc_id is not null"))
    many, different = found.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    gone = found.filter("doc_id <> component_id")
    if many == different:
        ids = gone.select("doc_id")
        return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs.doc_id == ids.doc_id, "left_anti")

    @F.pandas_udf("long")
    def node_of(texts):
        import pandas as pd

        return pd.Series([set_hash(s) for _, s in doc_sets(pa.array(texts, pa.string()), k)])

    name = "".join(["_", *docs.columns])
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).withColumn(name, node_of("text"))
    gone = gone.select("doc_id", "node").distinct()
    return once.join(gone, (once.doc_id == gone.doc_id) & (once[name] == gone.node), "left_anti").drop(name).unionByName(docs.filter("doc_id is null"))
