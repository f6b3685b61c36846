"""Repeated byte strings by longest-previous-factor arrays over suffix order, distributed by anchors.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document with a smaller doc_id, or in the same one further left. The suffixes of a
corpus cannot be sorted in one place, so they are dealt out by content: each window of
LENGTH bytes is filed under its anchor, the GRAM bytes in it with the least hash, the
leftmost among equals. Equal windows have the same anchor at the same place, so each
set of equal windows meets under one key; and neighbouring windows mostly share an
anchor, so a key needs one row for about LENGTH / 3 bytes.

1. Windows with one anchor form a context. Equal contexts hold equal windows: all but
   the earliest are removed whole. Those that one batch sees twice never travel.
2. The several different contexts of an anchor are compared by their suffix array: all
   their suffixes are ranked by prefix doubling to the contexts' ends; for each window,
   the nearest suffixes before and after it in that order that start earlier in the
   corpus (previous and next smaller positions) give its longest previous factor, the
   larger of the two common prefixes. It goes if that reaches LENGTH.
3. An anchor with more than HOT contexts is dealt out further, one row for a window,
   and compared with the row before it in order; no task holds such a group.

A start is compared as (doc_id, place): place holds 31 bits of the text's hash above the
offset, so that different texts under one doc_id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 32
#: Contexts under one anchor that a task compares at once.
HOT = 20_000
#: Bytes of text worked on at once; of contexts sorted at once.
PIECE, SORTED = 1 << 20, 3 << 19

_BASE = 0x9E3779B97F4A7C15
_INDEX = np.uint64((1 << 23) - 1)
_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, PIECE + 4 * LENGTH)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size bytes."""
    n = len(data) - size + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _geometric(_BASE, len(data)), out=sums[1:])
    return _mixed((sums[size:] - sums[:n]) * _geometric(pow(_BASE, -1, 1 << 64), n))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together up to PIECE bytes, long ones cut so that each window is whole in one piece: bytes, rows, begins, offsets in the row's text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        sizes = np.array([len(x[2]) for x in held], np.int64)
        return b"".join(x[2] for x in held), np.array([x[0] for x in held], np.int64), np.append(np.cumsum(sizes) - sizes, sizes.sum()), np.array([x[1] for x in held], np.int64)

    for row, text in enumerate(texts):
        if text is None or len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE + LENGTH:
                yield out()
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield out()


def contexts(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """row, first window, last window, anchor's hash and context's hash of each run of windows with one anchor."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for data, rows, begins, offsets in pieces(texts):
        flat = np.frombuffer(data, np.uint8)
        hashes = grams(flat, GRAM)
        anchor = (least(hashes & ~_INDEX | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1) & _INDEX).astype(np.int64)
        piece = np.searchsorted(begins, np.arange(len(anchor)), side="right") - 1
        whole = np.arange(len(anchor)) + LENGTH <= begins[piece + 1]
        first = whole.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (piece[1:] != piece[:-1])
        at = np.flatnonzero(whole)
        heads = np.flatnonzero(first[at])
        lo, hi = at[heads], at[np.append(heads[1:], len(at)) - 1]
        content = np.fromiter((digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)), np.uint64, len(lo))
        shift = offsets[piece[lo]] - begins[piece[lo]]
        yield rows[piece[lo]], lo + shift, hi + shift, hashes[anchor[lo]].view(np.int64), content.view(np.int64)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _anchored(docs: DataFrame) -> DataFrame:
    """A row for each context: anchor, content, doc_id, place of its first window, span to the last; later: an equal one of its batch comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", PIECE):
            ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
            for row, lo, hi, anchor, content in contexts(batch.column("text").cast(pa.binary()).to_pylist()):
                doc, place, span = ids[row], versions[row] << 32 | lo, hi - lo
                order = np.lexsort((place, doc, content, anchor))
                doc, place, span, anchor, content = (x[order] for x in (doc, place, span, anchor, content))
                head = np.ones(len(doc), bool)
                head[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
                at = np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))
                later = (doc != doc[at]) | (place != place[at])
                salt = np.where(later, _mixed((doc * 1_000_003 + place).view(np.uint64)).view(np.int64), anchor)
                once = head | later  # not the same row again
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (salt, content, doc, place, span.astype(np.int32), later)], ["anchor", "content", "doc_id", "place", "span", "later"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "anchor bigint, content bigint, doc_id bigint, place bigint, span int, later boolean")


def _told_apart(anchored: DataFrame) -> DataFrame:
    """doc_id, place, span, anchor: contexts that an equal earlier one removes (anchor null), and the earliest of each of an anchor's several contexts."""
    dealt = anchored.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "place")
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("span", pa.int32()), ("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # anchor, content, doc_id, place of the context's earliest row so far
        waiting = None  # the last earliest row, if its anchor has no other content yet
        for batch in batches:
            anchor, content, doc, place, span, later = _numbers(batch, "anchor", "content", "doc_id", "place", "span", "later")
            if later.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(place[later]), pa.array(span[later]), pa.nulls(int(later.sum()), pa.int64())], schema=schema)
                anchor, content, doc, place, span = (x[~later] for x in (anchor, content, doc, place, span))
            if not len(anchor):
                continue
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
            first_doc, first_place = doc[at].copy(), place[at].copy()
            if head and head[:2] == (anchor[0], content[0]):
                new[0] = False
                first_doc[at == 0], first_place[at == 0] = head[2:]
            gone = (doc != first_doc) | (place != first_place)
            head = (anchor[-1], content[-1], first_doc[-1], first_place[-1])
            heads = np.flatnonzero(new)
            own = [np.concatenate([[w], x[heads]]) if waiting else x[heads] for w, x in zip((waiting or (None,) * 4)[:4], (doc, place, span, anchor), strict=True)]
            sent = bool(waiting and waiting[4])
            several = np.zeros(len(own[3]), bool)
            same = own[3][1:] == own[3][:-1]
            several[1:] |= same
            several[:-1] |= same
            if len(own[3]):
                told = several[-1] or (sent and len(own[3]) == 1)
                waiting = (*(x[-1] for x in own), bool(told))
                if sent:
                    several[0] = False
            keep = np.flatnonzero(several)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([doc[gone], own[0][keep]]).astype(np.int64)), pa.array(np.concatenate([place[gone], own[1][keep]]).astype(np.int64)), pa.array(np.concatenate([span[gone], own[2][keep]]).astype(np.int32)), pa.concat_arrays([pa.nulls(int(gone.sum()), pa.int64()), pa.array(own[3][keep].astype(np.int64))])],
                schema=schema,
            )

    return dealt.mapInArrow(run, "doc_id bigint, place bigint, span int, anchor bigint")


_PARTS = "key bigint, second bigint, doc_id bigint, place bigint, context binary, spans binary"
_PARTS_ARROW = pa.schema([("key", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("context", pa.binary()), ("spans", pa.binary())])
_OFFSET = (1 << 32) - 1


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows of start, end: sorted, overlapping and touching ones as one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(head)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def _parts(docs: DataFrame, told: DataFrame) -> DataFrame:
    """For each document with something to remove or compare: its removed spans, the contexts to compare, or (hot anchors) the windows."""
    listed = told.groupBy("doc_id", F.shiftright("place", 32).alias("version")).agg(F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(_OFFSET)).cast("int").alias("lo"), "span", "anchor", "hot")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last = None
        for batch in common.slices(batches, "text", PIECE):
            rows: list[tuple] = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            lists = batch.column("own")
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            lo = flat.field(0).to_numpy().astype(np.int64)
            hi = lo + flat.field(1).to_numpy()
            anchor, hot = flat.field(2), flat.field(3).to_numpy(zero_copy_only=False)
            to_compare = anchor.is_valid().to_numpy(zero_copy_only=False)
            anchor = anchor.fill_null(0).to_numpy()
            bounds = bounds - bounds[0]
            for k, (doc, version, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), texts, strict=True)):
                if last == (doc, version):  # the same row again
                    continue
                last, base = (doc, version), version << 32
                here = slice(bounds[k], bounds[k + 1])
                gone = ~to_compare[here]
                later = [np.stack([lo[here][gone], hi[here][gone] + LENGTH], axis=1)]
                for j in bounds[k] + np.flatnonzero(~gone):
                    if not hot[j]:
                        rows.append((int(anchor[j]), 0, doc, base | int(lo[j]), text[lo[j] : hi[j] + LENGTH], None))
                        continue
                    for p in range(lo[j], hi[j] + 1):
                        both = xxhash.xxh3_128_intdigest(text[p : p + LENGTH])
                        two = ((both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63))
                        rows.append((*two, doc, base | int(p), None, None))
                spans = _merged(np.concatenate(later))
                if len(spans):
                    rows.append((hash((doc, version)), 0, doc, base, None, spans.astype(np.int64).tobytes()))
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000], strict=True), _PARTS_ARROW, strict=True)], schema=_PARTS_ARROW)

    return docs.join(listed, ["doc_id", "version"]).select("doc_id", "version", "text", "own").mapInArrow(run, _PARTS)


class Suffixes:
    """The suffix array of several strings: every suffix ends where its string ends, and a suffix that is a prefix of another comes first."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(data)
        left = np.repeat(self.begins + sizes, sizes) - np.arange(n)  # bytes to the string's end
        # Ranks of the first 4 bytes (a byte counts from 1, what lies beyond the end is 0), then of twice as many each time.
        words = np.zeros(n, np.uint64)
        for k in range(4):
            own = np.zeros(n, np.uint64)
            own[: n - k] = data[k:].astype(np.uint64) + np.uint64(1)
            words = words << np.uint64(9) | np.where(left > k, own, np.uint64(0))
        self.levels = [(4, np.unique(words, return_inverse=True)[1].astype(np.int64) + 1)]
        longest = int(sizes.max(initial=0))
        while self.levels[-1][0] < longest:
            covered, rank = self.levels[-1]
            beyond = np.zeros(n, np.int64)
            beyond[: max(0, n - covered)] = rank[covered:]
            pair = rank * np.int64(n + 2) + np.where(left > covered, beyond, 0)
            self.levels.append((2 * covered, np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1))
        self.left = left
        self.data = data

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b."""
        found = np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for covered, rank in reversed(self.levels):
            # Equal ranks of suffixes that both reach so far mean that many equal bytes.
            fits = found + covered <= most
            same = fits & (rank[np.where(fits, a + found, 0)] == rank[np.where(fits, b + found, 0)])
            found += covered * same
        for _ in range(3):
            fits = found < most
            found += fits & (self.data[np.where(fits, a + found, 0)] == self.data[np.where(fits, b + found, 0)])
        return found


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it that holds less, or -1. Unsettled places jump along what is known, all at once."""
    known = np.arange(len(values)) - 1
    active = np.arange(len(values))
    while len(active):
        active = active[(known[active] >= 0) & (values[np.maximum(known[active], 0)] >= values[active])]
        known[active] = known[known[active]]
    return known


def longest_previous_factors(strings: list[bytes], doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each string and each of its windows of LENGTH bytes: the longest prefix of the suffix there that also starts earlier in some string.

    doc and place: where each string starts; starts are compared as (doc, place).
    """
    suffixes = Suffixes(strings)
    counts = np.array([len(s) for s in strings], np.int64) - LENGTH + 1
    of = np.repeat(np.arange(len(strings)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = suffixes.begins[of] + inner
    # A window's number in the corpus' order; the same start may be there twice.
    by_start = np.lexsort((place[of] + inner, doc[of]))
    d, p = doc[of][by_start], (place[of] + inner)[by_start]
    fresh = np.ones(len(of), np.int64)
    fresh[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    number = np.empty(len(of), np.int64)
    number[by_start] = np.cumsum(fresh)
    order = np.argsort(suffixes.levels[-1][1][at], kind="stable")  # the windows in suffix order
    in_order = number[order]
    factor = np.zeros(len(of), np.int64)
    before = previous_smaller(in_order)
    after = len(order) - 1 - previous_smaller(in_order[::-1])[::-1]
    for near, there in ((before, before >= 0), (after, after < len(order))):
        mine = order[there]
        factor[mine] = np.maximum(factor[mine], suffixes.common_prefix(at[mine], at[order[near[there]]]))
    return np.split(factor, np.cumsum(counts)[:-1])


def _compared(parts: DataFrame) -> DataFrame:
    """doc_id and removed spans, from parts dealt out by key."""
    dealt = parts.repartition("key").sortWithinPartitions("key", "second", "doc_id", "place")
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("spans", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        window = None

        def sort_out() -> list[tuple]:
            doc, place = (np.array([h[k] for h in held], np.int64) for k in (1, 2))
            found = []
            for (_, d, start, context), factors in zip(held, longest_previous_factors([h[3] for h in held], doc, place), strict=True):
                at = (start & _OFFSET) + np.flatnonzero(factors >= LENGTH)
                if len(at):
                    found.append((d, start >> 32, _merged(np.stack([at, at + LENGTH], axis=1)).astype(np.int64).tobytes()))
            return found

        for batch in batches:
            out: list[tuple] = []
            for key, second, doc, place, context, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans is not None:
                    out.append((doc, place >> 32, spans))
                elif context is not None:
                    if size > SORTED and key != held[-1][0]:
                        out += sort_out()
                        held, size = [], 0
                    held.append((key, doc, place, context))
                    size += len(context)
                else:
                    if window and window[:2] == (key, second):
                        if window[2:] != (doc, place):
                            at = place & _OFFSET
                            out.append((doc, place >> 32, np.array([at, at + LENGTH], np.int64).tobytes()))
                    else:
                        window = (key, second, doc, place)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held and (out := sort_out()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "doc_id bigint, version bigint, spans binary")


def without_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) kept, the remaining bytes, of every row of docs.

    A null text counts as empty. A null doc_id's row is left whole and removes nothing
    elsewhere. Rows that repeat a doc_id and text are one document: they do not remove
    each other. Different texts under one doc_id are documents in the order of their
    hashes. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("version"), "text")
    told = common.written(_told_apart(_anchored(docs)), "told")
    common.swept(docs.sparkSession)  # the contexts' shuffle is the largest; it must not stand beside the next ones
    hot = told.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
    compared = told.where("anchor is not null").join(hot, "anchor", "left").select("doc_id", "place", "span", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    every = compared.union(told.where("anchor is null").withColumn("hot", F.lit(False)))
    removed = common.written(_compared(_parts(docs, every)), "removed")
    common.dropped(told)
    listed = removed.groupBy("doc_id", "version").agg(F.collect_list("spans").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", PIECE):
            rows = []
            for data, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = data or b""
                gone = _merged(np.frombuffer(b"".join(spans or []), np.int64).reshape(-1, 2))
                parts, at = [], 0
                for a, b in gone.tolist():
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text)

    return docs.join(listed, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * text)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents", "doc_id", "text"), text=False)
