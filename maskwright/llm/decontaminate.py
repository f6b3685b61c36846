"""Benchmark decontamination by pigeonhole edit matching.

An item of n normalised characters may differ from a passage by k = floor(n * rate)
edits. Cut into k + 1 pieces, one piece at least lies unchanged in any such passage;
so an automaton over all pieces finds every candidate place, and Myers' bit-parallel
distance of the whole item against the text around it confirms or refutes it.
Normalised: lower case, runs of white space as one space, none at the ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Edits allowed per character of an item.
RATE = 0.06
#: Bound of what is broadcast: normalised characters of all items together.
MOST_ITEM_CHARS = 50_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): floor(n * rate) + 1 pieces, of lengths that differ by one at most."""
    count = int(len(item) * rate) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text, the first end among equals; None beyond most."""
    m = len(pattern)
    if masks is None:
        masks = letter_masks(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = full, 0, m, most + 1, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, where = score, j + 1
                if not best:
                    break
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return (best, where) if best <= most else None


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = {i: text for i, text in items if text}
        self.most = {i: int(len(text) * rate) for i, text in self.items.items()}
        self.masks = {i: letter_masks(text) for i, text in self.items.items()}
        of: dict[str, list[tuple[int, int]]] = {}
        for i, text in self.items.items():
            for offset, piece in pieces(text, rate):
                of.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in of.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if of:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text), one for each item found, at its best place."""
        if not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for i, offset in uses:
                start = last + 1 - size - offset
                windows.setdefault(i, []).append((start - self.most[i], start + len(self.items[i]) + self.most[i]))
        found = []
        for i, spans in windows.items():
            best = None
            for a, b in merged(spans):
                a = max(0, a)
                got = myers(self.items[i], text[a:b], self.most[i], self.masks[i])
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
                    if not best[0]:
                        break
            if best:
                found.append((i, *best))
        return sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping windows as one; sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def _items(benchmark: DataFrame) -> tuple[tuple[int, str], ...]:
    """The normalised items on the driver; refused where they exceed the stated bound."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_ITEM_CHARS:
        raise ValueError(f"{size} characters of benchmark items; at most {MOST_ITEM_CHARS} are broadcast: match them in parts")
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").toLocalIterator()
    return tuple(sorted({(r[0], normalised(r[1])) for r in rows}))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, end_at: each benchmark item that a document's whole text holds within its edit budget.

    end_at is the end in the normalised text. Null or empty texts and items match
    nothing; a repeated document row gives its matches again; of items with the same
    id and different texts the last in order counts. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _matcher(shared.value, rate)
        for batch in common.slices(batches, "text", 4 << 20):
            ids, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                got = own.matches(normalised(text))
                rows += got
                ids += [k] * len(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["doc_id", "item_id", "distance", "end_at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id bigint, distance int, end_at bigint")


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows whose whole text holds no benchmark item within its edit budget, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark))

    @F.pandas_udf("boolean")
    def clean(texts):
        own = _matcher(shared.value, rate)
        return texts.map(lambda t: not own.matches(normalised(t)))

    return docs.where(clean("text"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))
