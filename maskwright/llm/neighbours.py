"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits along a random direction at
the sample's median. Every vector is indexed: each tree files it under one leaf. A
query visits leaves of all trees in one order: by the sum of the squared distances to
the splits that the path has crossed. What the leaves hold is then ranked by exact
inner products. How many leaves are visited is measured: as many as find TARGET of the
nearest rows, by brute force over all rows, of at most ASKED queries.

Subtrees of up to 64 leaves are groups of rows: large ones are dealt out over several
tasks, and so are the queries that visit them; each carries the leaves that it visits
as bits. Groups take turns if their rows would fill the shuffle's disk. Nothing but the
two samples, the trees and the leaves' sizes reaches the driver; all are bounded by the
parameters below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES = 4
#: Rows that a leaf holds on average, at least; the sample bounds the depth too.
LEAF = 500
#: Bound of the sample that the trees are fitted on (in expectation).
SAMPLE = 20_000
#: Queries (in expectation) on which the number of visited leaves is measured, and the recall that it has to reach there.
ASKED, TARGET = 256, 0.93
#: Levels of a subtree whose leaves are one group.
BITS = 6
#: Members, and queries, that one task takes of a group (in expectation).
MEMBERS, QUERIES = 1 << 15, 1 << 15
#: Bytes that the groups of one turn may move, or twice the vectors' size, if that is more.
TURN = 1 << 30
#: Neighbours that one task merges at once.
MERGED = 1 << 19
#: Queries, and members, in one matrix product.
ROWS, COLUMNS = 256, 4096


class Forest(NamedTuple):
    depth: int
    normals: np.ndarray  # trees x nodes x dimensions
    splits: np.ndarray  # trees x nodes

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    @property
    def bits(self) -> int:
        return min(BITS, self.depth)

    @property
    def groups(self) -> int:
        """Of each tree."""
        return 1 << (self.depth - self.bits)

    def leaf_of(self, tree: int, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            beyond = np.einsum("ij,ij->i", vectors, self.normals[tree, node]) > self.splits[tree, node]
            node = 2 * node + 1 + beyond
        return node - (self.leaves - 1)

    def far(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x (trees x leaves): what the path to each leaf has crossed."""
        out = []
        for normals, splits in zip(self.normals, self.splits, strict=True):
            sums = np.zeros((len(vectors), 1))
            for level in range(self.depth):
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                margins = vectors.astype(np.float64) @ normals[nodes].T.astype(np.float64) - splits[nodes]
                crossed = margins * margins
                sums = np.stack([sums + np.where(margins > 0, crossed, 0), sums + np.where(margins > 0, 0, crossed)], axis=2).reshape(len(vectors), -1)
            out.append(sums)
        return np.concatenate(out, axis=1)

    def visited(self, vectors: np.ndarray, wanted: int) -> np.ndarray:
        """vectors x (trees x leaves), boolean: the wanted leaves that are nearest."""
        far = self.far(vectors)
        found = np.zeros(far.shape, bool)
        np.put_along_axis(found, np.argpartition(far, wanted - 1, axis=1)[:, :wanted], True, axis=1)
        return found


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 20) -> Forest:
    depth = max(0, min(int(math.log2(max(1, rows / leaf))), int(math.log2(max(1, len(sample) / 8)))))
    dim, nodes = sample.shape[1], (1 << depth) - 1
    rnd = np.random.default_rng(seed)
    normals = rnd.standard_normal((trees, nodes, dim)).astype(np.float32)
    normals /= np.maximum(np.linalg.norm(normals, axis=2, keepdims=True), 1e-30)
    splits = np.zeros((trees, nodes), np.float32)
    for tree in range(trees):
        parts = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = parts.pop(node)
            along = sample[own] @ normals[tree, node]
            splits[tree, node] = np.median(along) if len(own) else 0
            parts[2 * node + 1], parts[2 * node + 2] = own[along <= splits[tree, node]], own[along > splits[tree, node]]
    return Forest(depth, normals, splits)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<float>, or of double where the table has other numbers) of the rows that take part."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("embedding")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _like(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y as their products can be taken: of numbers near float's ends in double."""
    tops = [float(np.abs(m).max(initial=0)) for m in (x, y)]
    return (x, y) if max(tops) < 1e15 and min(tops) > 1e-10 else (x.astype(np.float64), y.astype(np.float64))


def _product(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times y transposed, in their own precision, and by how much each row of it may be off."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(x).max(axis=1, initial=0).astype(np.float64) * float(np.abs(y).max(initial=0)) * x.shape[1]
        off = 4 * (x.shape[1] + 4) * float(np.finfo(x.dtype).eps) * most + 1e-30
        out = x @ y.T
    out[~np.isfinite(out)] = -np.inf
    return out, off


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: by row, the largest score, the smallest id."""
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _ranked(asked: np.ndarray, asked_ids: np.ndarray, bits: np.ndarray, floor: np.ndarray, held: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of asked, score and id of the k best of each row among the held vectors of its leaves; those below floor may be missing.

    Matrix products only leave out what cannot be among the k best: their order of
    additions depends on a row's place, while equal vectors must score alike.
    """
    by_leaf = np.argsort(leaf, kind="stable")
    held, ids, leaf = held[by_leaf], ids[by_leaf], leaf[by_leaf]
    rough_asked, rough_held = _like(asked, held)
    floor = floor.copy()
    pool = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    waiting = 0

    def settle() -> None:
        rows, scores, near = (np.concatenate(c) for c in zip(*pool, strict=True))
        best = _best(rows, scores, near, k)
        pool[:] = [(rows[best], scores[best], near[best])]
        rows, scores, _ = pool[0]
        full = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == k - 1)
        floor[rows[full]] = np.maximum(floor[rows[full]], scores[full])

    for own in np.unique(leaf):
        start, stop = np.searchsorted(leaf, (own, own + 1))
        asking = np.flatnonzero((bits >> np.uint64(own)) & np.uint64(1))
        for at in range(0, len(asking), ROWS):
            some = asking[at : at + ROWS]
            for low in range(start, stop, COLUMNS):
                rough, off = _product(rough_asked[some], rough_held[low : min(stop, low + COLUMNS)])
                if rough.shape[1] > k + 1 and (open_ := np.isneginf(floor[some])).any():  # one more, as the query itself may be among them
                    floor[some[open_]] = np.partition(rough[open_], rough.shape[1] - k - 1, axis=1)[:, -k - 1] - off[open_]
                row, column = np.nonzero((rough >= (floor[some] - off)[:, None]) & np.isfinite(rough))
                for part in range(0, len(row), 1 << 16):
                    r, c = some[row[part : part + (1 << 16)]], low + column[part : part + (1 << 16)]
                    r, c = r[other := asked_ids[r] != ids[c]], c[other]
                    exact = (held[c].astype(np.float64) * asked[r].astype(np.float64)).sum(axis=1)
                    pool.append((r, exact, ids[c]))
                    waiting += len(r)
                    if waiting > 1 << 18:
                        settle()
                        waiting = 0
    settle()
    return pool[0]


def wanted_leaves(forest: Forest, nearest_of: list[tuple[np.ndarray, list[list[int]]]]) -> int:
    """How many leaves have to be visited to find TARGET of the nearest rows: for each vector the leaves of those rows, one a tree."""
    place = []
    for vector, rows in nearest_of:
        order = np.argsort(np.argsort(forest.far(vector[None])[0], kind="stable"))
        place += [min(order[tree * forest.leaves + leaf] for tree, leaf in enumerate(leaves)) for leaves in rows]
    return int(np.sort(place)[min(len(place) - 1, math.ceil(TARGET * len(place)))]) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int, share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row among all rows but its own.

    Nearness is the inner product in double precision; ties go to the smaller vec_id.
    Rows with a null id, a null or zero vector, or null or non-finite components take
    no part; nor do those whose length is not the most frequent one. Rows that repeat
    an id and vector count once. Other columns are not read. share: of all leaves, that
    a query visits; measured unless given.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors)
    real = np.float32 if usable.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    lengths = usable.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, rows, n_queries = lengths[0] if lengths else (1, 0, 0)
    usable = usable.where(F.size("embedding") == dim)
    queries = usable.where(is_query)

    def drawn(of: DataFrame, n: int, most: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of most rows in expectation, each id once."""
        some = of.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(max(1, n))) < most).orderBy("vec_id").collect()
        ids, at = np.unique(np.array([r["vec_id"] for r in some], np.int64), return_index=True)
        return ids, np.array([some[i]["embedding"] for i in at], real).reshape(len(at), dim)

    sample_ids, sample = drawn(usable, rows, SAMPLE, "forest")
    forest = fit(sample, rows, TREES, LEAF)
    total, groups, bits = TREES * forest.leaves, forest.groups, forest.bits
    test = drawn(queries, n_queries, ASKED, "asked")
    shared = spark.sparkContext.broadcast((forest.depth, forest.normals, forest.splits, test))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each leaf (query null); and the nearest rows of the test's queries, with their leaves."""
        own, (asked_ids, asked) = Forest(*shared.value[:3]), shared.value[3]
        sums = np.zeros((len(own.normals), own.leaves), np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, len(own.normals)), np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, ids = _matrix(batch), batch.column("vec_id").to_numpy()
            leaf = np.stack([own.leaf_of(tree, matrix) for tree in range(len(own.normals))], axis=1)
            for tree in range(len(own.normals)):
                sums[tree] += np.bincount(leaf[:, tree], minlength=own.leaves)
            if share is None and len(asked):
                last = np.full(len(asked), -np.inf)
                full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                last[best[0][full]] = best[1][full]
                q, scores, at = _ranked(asked, np.full(len(asked), -1), np.ones(len(asked), np.uint64), last, matrix, np.arange(len(ids)), np.zeros(len(ids), np.int64), k + 1)  # places in the batch, for their leaves
                q, scores, at = (c[asked_ids[q] != ids[at]] for c in (q, scores, at))
                best = [np.concatenate(c) for c in zip(best, (q, scores, ids[at], leaf[at]), strict=True)]
                best = [c[kept] for kept in [_best(*best[:3], k)] for c in best]
        tree, leaf = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(tree), pa.int32()), pa.nulls(len(tree), pa.float64()), pa.array(tree * own.leaves + leaf, pa.int64()), pa.array(sums[tree, leaf][:, None].tolist(), pa.list_(pa.int64()))], ["query", "far", "id", "leaves"])
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int32()), pa.array(-best[1]), pa.array(best[2]), pa.array(best[3].tolist(), pa.list_(pa.int64()))], ["query", "far", "id", "leaves"])

    surveyed = usable.mapInArrow(survey, "query int, far double, id bigint, leaves array<bigint>")
    nearby = F.slice(F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("query").isNotNull(), F.struct("far", "id", "leaves"))))), 1, k)
    key = F.when(F.col("query").isNull(), F.col("id"))
    told = surveyed.groupBy("query", key.alias("leaf")).agg(F.sum(F.when(F.col("query").isNull(), F.get("leaves", F.lit(0)))).alias("n"), nearby.alias("near")).collect()  # one row for each leaf, and for each query of the test
    sizes = np.zeros(total, np.int64)
    for r in told:
        if r["query"] is None:
            sizes[r["leaf"]] = r["n"]
    wanted = max(1, math.ceil((1.0 if share is None else share) * total))
    if share is None and (of := [r for r in told if r["query"] is not None and r["near"]]):
        wanted = wanted_leaves(forest, [(test[1][r["query"]], [x["leaves"] for x in r["near"]]) for r in of])
    parts = np.maximum(1, -(-sizes.reshape(-1, 1 << bits).sum(axis=1) // MEMBERS))
    blocks = max(1, math.ceil(n_queries / QUERIES))
    moved = (rows * TREES * blocks + n_queries * int(parts.sum())) * (dim * np.dtype(real).itemsize + 40)
    turns = min(len(parts), max(1, math.ceil(moved / max(TURN, 2 * rows * dim * np.dtype(real).itemsize))))
    filed = np.stack([forest.leaf_of(tree, sample) + tree * forest.leaves for tree in range(TREES)]) if len(sample) else np.zeros((TREES, 0), np.int64)
    rest = spark.sparkContext.broadcast((parts, sample_ids, sample, filed))

    def members(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, parts = Forest(*shared.value[:3]), rest.value[0]
            for batch in batches:
                if not batch.num_rows:
                    continue
                matrix, ids = _matrix(batch), batch.column("vec_id").to_numpy()
                raw = pa.array([row.tobytes() for row in matrix], pa.binary())
                salt = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for tree in range(len(own.normals)):
                    leaf = own.leaf_of(tree, matrix)
                    group = tree * groups + (leaf >> bits)
                    chosen = np.flatnonzero(group % turns == turn)
                    part = salt[chosen] % parts[group[chosen]].astype(np.uint64)
                    for block in range(blocks):
                        yield _rows(group[chosen], part, np.full(len(chosen), block), ids[chosen], leaf[chosen] & ((1 << bits) - 1), np.zeros(len(chosen)), raw.take(pa.array(chosen)))

        return run

    def asked(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (parts, sample_ids, sample, filed) = Forest(*shared.value[:3]), rest.value
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    some = batch.slice(start, ROWS)
                    matrix, ids = _matrix(some), some.column("vec_id").to_numpy()
                    raw = pa.array([row.tobytes() for row in matrix], pa.binary())
                    visited = own.visited(matrix, wanted)
                    floor = np.full(len(ids), -np.inf)
                    if len(sample) > k:  # the sample's rows in visited leaves are found, too
                        rough, off = _product(*_like(matrix, sample))
                        by_leaf = np.ascontiguousarray(visited.T)
                        rough[~reduce(np.logical_or, [by_leaf[leaf] for leaf in filed]).T | (ids[:, None] == sample_ids[None, :])] = -np.inf
                        floor = np.partition(rough, len(sample) - k, axis=1)[:, len(sample) - k] - off
                    wide = np.zeros((len(ids), len(parts), 64), bool)
                    wide[:, :, : 1 << bits] = visited.reshape(len(ids), len(parts), 1 << bits)
                    mask = np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]
                    mask[:, np.arange(len(parts)) % turns != turn] = 0
                    row, group = np.nonzero(mask)
                    times = parts[group]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, group = np.repeat(row, times), np.repeat(group, times)
                    for at in range(0, len(row), 20_000):
                        r, g = row[at : at + 20_000], group[at : at + 20_000]
                        yield _rows(g, part[at : at + 20_000], (ids[r] // 20) % blocks, ids[r], mask[r, g].view(np.int64), floor[r], raw.take(pa.array(r)))

        return run

    def rank(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], _NEAR)], ["query_id", "near"])
        if held.num_rows > len(np.unique(held.column("vec_id").to_numpy())):
            first = {pair: at for at, pair in reversed([*enumerate(zip(held.column("vec_id").to_pylist(), held.column("vector").to_pylist(), strict=True))])}
            held = held.take(pa.array(sorted(first.values())))
        of = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), real).reshape(t.num_rows, dim)
        column = lambda t, c: t.column(c).to_numpy()
        ids = column(asking, "vec_id")
        row, scores, near = _ranked(of(asking), ids, column(asking, "leaf").view(np.uint64), column(asking, "floor"), of(held), column(held, "vec_id"), column(held, "leaf"), k)
        some, starts = np.unique(row, return_index=True)
        found = pa.StructArray.from_arrays([pa.array(-scores), pa.array(near)], ["far", "vec_id"])
        return pa.table([pa.array(ids[some]), pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), found)], ["query_id", "near"])

    keys = ["cell", "part", "block"]
    found = []
    for turn in range(turns):
        pairs = queries.mapInArrow(asked(turn), _SCHEMA).groupBy(*keys).cogroup(usable.mapInArrow(members(turn), _SCHEMA).groupBy(*keys))
        found.append(pairs.applyInArrow(rank, "query_id bigint, near array<struct<far:double,vec_id:bigint>>"))
        if turns > 1:
            found[-1] = common.written(found[-1], "near")
            common.swept(spark)
    def merge(group: pa.Table) -> pa.Table:
        lists = group.column("near").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        query = np.repeat(group.column("query_id").to_numpy(), np.diff(lists.offsets.to_numpy()))
        far, ids = (c.to_numpy() for c in lists.flatten().flatten())
        order = np.lexsort((ids, far, query))
        query, far, ids = query[order], far[order], ids[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (far[1:] != far[:-1]) | (ids[1:] != ids[:-1])
        query, far, ids = query[new], far[new], ids[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.table([pa.array(c[rank <= k]) for c in (query, rank.astype(np.int32), ids, -far)], ["query_id", "rank", "vec_id", "score"])

    # A row for a query and group, not for each neighbour; some queries at a time, MERGED neighbours at most in expectation.
    some = max(1, n_queries * k * len(parts) // MERGED)
    every = reduce(DataFrame.union, found).withColumn("some", F.pmod(F.xxhash64("query_id"), F.lit(some)))
    return every.groupBy("some").applyInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def _rows(cell: np.ndarray, part: np.ndarray, block: np.ndarray, ids: np.ndarray, leaf: np.ndarray, floor: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
    """leaf: of a member its leaf in the cell, of a query the bits of those that it visits."""
    numbers = [pa.array(c.astype(np.int32)) for c in (cell, part, block)] + [pa.array(c.astype(np.int64)) for c in (ids, leaf)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(floor, pa.float64()), raw], ["cell", "part", "block", "vec_id", "leaf", "floor", "vector"])


_NEAR = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
_SCHEMA = "cell int, part int, block int, vec_id bigint, leaf bigint, floor double, vector binary"


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
