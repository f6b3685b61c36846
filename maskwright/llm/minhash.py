"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Words are what lies between ASCII white space, A-Z in lower case; a document's set
holds its distinct five-word shingles (all its words as one, if fewer). The first
permutation scatters the shingles' hashes over 32 bits; the second, shifted
circularly by k, gives coordinate k of the signature. Bands of ROWS coordinates
are hashed into buckets.

Sets that are equal are one node from the start, under their smallest doc_id. The
buckets' pairs are then verified on full sets without writing all pairs of a bucket:
first each node against two hubs (the members of its buckets that share most places
with others), then what is still apart against the hub of every bucket, and last all
pairs of a bucket that no verified link has joined: those of a large bucket block by
block, as matrix products. A bucket of copies is mostly one component after the first
step; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
#: Bands of ROWS coordinates: a pair of similarity 0.75 shares none with probability 2e-5.
BANDS, ROWS = 40, 5
#: A link needs NUMERATOR / DENOMINATOR at least.
NUMERATOR, DENOMINATOR = 75, 100
CACHED_WORDS = 500_000
#: Members up to which a bucket's last pairs are rows; nodes in a block of larger ones; columns of a matrix product.
FEW, BLOCK, COLUMNS = 32, 512, 8192

_U32 = np.uint32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([_hashes[w] for w in words], np.int64).view(np.uint64)
    size = min(size, len(own))
    found = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(found)]
        found ^= found >> np.uint64(32)
    return np.unique(_mixed(found))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys, one row for each set (none may be empty)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    first = (_mixed(np.concatenate(sets)) >> np.uint64(32)).astype(_U32)  # the first permutation
    keys = np.zeros((len(sets), bands), np.uint64)
    place = np.empty_like(first)
    shifted = np.empty_like(first)
    for k in range(bands * rows):
        np.add(first, _U32(k), out=place)  # shifted by k, circularly over 32 bits
        np.right_shift(place, _U32(16), out=shifted)
        place ^= shifted
        place *= _U32(0x7FEB352D)
        np.right_shift(place, _U32(15), out=shifted)
        place ^= shifted
        place *= _U32(0x846CA68B)
        np.right_shift(place, _U32(16), out=shifted)
        place ^= shifted
        band = keys[:, k // rows]
        if k % rows == 0:
            band += np.uint64(k + 1)
        band *= np.uint64(0x9E3779B97F4A7C15)
        band += np.minimum.reduceat(place, starts).astype(np.uint64)
        band ^= band >> np.uint64(29)
    return _mixed(keys)


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.slices(batches, "text", 1 << 20):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            keys = signatures(full).view(np.int64) if full else np.zeros((0, BANDS), np.int64)
            counts = np.array([len(s) for s in sets])
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, members of the documents in wanted (digest, node), whose rows are found by doc_id."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(wanted, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.slices(batches, "text", 1 << 20):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "digest", "members"],
            )

    found = chosen.mapInArrow(run, "node bigint, digest binary, members array<bigint>")
    return found.join(wanted, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: set numbers) whose Jaccard similarity reaches the threshold, on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    na, nb = F.size("of_a"), F.size("of_b")
    fits = F.least(na, nb) * DENOMINATOR >= F.greatest(na, nb) * NUMERATOR
    shared = F.size(F.array_intersect("of_a", "of_b"))
    close = F.when(fits, shared * DENOMINATOR >= (na + nb - shared) * NUMERATOR).otherwise(False)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")


def _blocked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of large buckets: members has key, node, component and held, the bucket's size.

    A bucket is cut into blocks of BLOCK nodes in expectation, and each pair of blocks
    is a group of its own, whose pairs are compared as a matrix product. No row is
    made for a pair; only links that join two components come out.
    """
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = members.select("key", "node", "component", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"))

    def links(group: pa.Table) -> pa.Table:
        node, component, own = (group.column(c).to_numpy() for c in ("node", "component", "own"))
        column = group.column("members").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        number, times = np.unique(values, return_inverse=True, return_counts=True)[1:]
        shared = times[number] > 1
        row, number = row[shared], np.unique(number[shared], return_inverse=True)[1]
        common_of = np.zeros((len(sizes), len(sizes)), np.float32)
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            part = slice(*np.searchsorted(number, (at, at + COLUMNS)))
            has = np.zeros((len(sizes), COLUMNS), np.float32)
            has[row[part], number[part] - at] = 1
            common_of += has @ has.T
        inter = common_of.astype(np.int64)
        close = DENOMINATOR * inter >= NUMERATOR * (sizes[:, None] + sizes[None, :] - inter)
        close &= component[:, None] < component[None, :]
        if group.column("i")[0].as_py() != group.column("k")[0].as_py():
            close &= own[:, None] != own[None, :]
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                c = up
            return c

        found = []
        for p, q in zip(*(z.tolist() for z in np.nonzero(close)), strict=True):
            c, d = find(int(component[p])), find(int(component[q]))
            if c != d:
                top[max(c, d)] = min(c, d)
                found.append(sorted((int(node[p]), int(node[q])), reverse=True))
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return dealt.join(sets.select("node", "members"), "node").groupBy("key", "i", "k").applyInArrow(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Null, empty or white-space texts have no shingles and are linked with nothing. Each
    row is judged by its own text; rows that repeat a doc_id are copies if their texts
    are. A null doc_id keeps its row, with a null component unless it has copies.
    """
    rows = common.written(_signed(docs), "signatures")
    # One node for each distinct set, named by its smallest doc_id.
    nodes = common.written(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = common.written(keyed.join(shared, "key"), "places")
    weight = places.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = places.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("hub"), F.col("h.weight").alias("hub_weight"))
    hubs = common.written(heavy, "hubs")
    sets = common.written(_sets(docs, nodes.join(weight, "node", "left_semi").select("node", "digest")), "sets")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    near = places.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"), F.max("hub_weight").alias("hub_weight"))
    best = near.groupBy("node").agg(F.max_by("hub", F.struct("hub_weight", -F.col("hub"))).alias("p"), F.max_by("hub", F.struct("times", "hub_weight", -F.col("hub"))).alias("q"))
    tested = common.written(ordered(best.select(F.col("node").alias("x"), F.explode(F.array("p", "q")).alias("y"))), "pairs")
    links = common.written(_verified(tested, sets), "links")

    def apart(label: DataFrame) -> DataFrame:
        """Places of the buckets that hold several components, with their component."""
        named = places.join(label.select(F.col("node"), "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        return named.join(mixed.select("key"), "key")

    first_label = components(links)
    rest = apart(first_label)
    top = first_label.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    more = rest.join(hubs, "key").join(top, "hub", "left").where("component <> coalesce(hub_component, hub)")
    more = common.written(ordered(more.select(F.col("node").alias("x"), F.col("hub").alias("y"))).join(tested, ["a", "b"], "left_anti"), "pairs")
    first_links, links = links, common.written(links.union(_verified(more, sets)), "links")
    label = components(links)
    common.dropped(first_label, first_links)

    rest = common.written(apart(label), "apart")
    counted = rest.join(rest.groupBy("key").agg(F.count("*").alias("held")), "key")
    few = counted.where(F.col("held") <= FEW)
    x = few.select("key", F.col("node").alias("x"), F.col("component").alias("cx"))
    y = few.select("key", F.col("node").alias("y"), F.col("component").alias("cy"))
    last = ordered(x.join(y, "key").where("cx < cy").select("x", "y"))
    last = common.written(last.join(tested.union(more), ["a", "b"], "left_anti"), "pairs")
    every = common.written(links.union(_verified(last, sets)).union(_blocked(counted.where(F.col("held") > FEW), sets)), "links")
    second_label, label = label, components(every)
    common.dropped(second_label, links, every, last, more, tested, rest, sets, hubs, places)

    named = rows.select("doc_id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest", "left").join(label, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component; other columns don't matter."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("__mw_gone"))
    return docs.join(gone.distinct(), docs["doc_id"] == F.col("__mw_gone"), "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
