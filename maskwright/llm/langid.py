"""Language spans of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Model: counts of hashed letter trigrams (words padded by one mark at each end) and of
scripts per language, summed by Spark over a bounded sample of labelled rows. Its
size is fixed: BUCKETS numbers a language, whatever the corpus.

Prediction: each maximal run of letters is a word. Its scripts leave those languages
that use them in training (all, if none does); its score in each is the sum of its
trigrams' log-probabilities. Viterbi over the words of a whole text, with a penalty
for each change of language, labels the words; equal neighbours form spans. The
document's language is the one with most letters, the first by name among equals.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Bound of the training sample, in rows (in expectation: rows are drawn by a hash of doc_id).
TRAIN_ROWS = 20_000
#: Log-probability that a change of language costs.
SWITCH = 12.0
UNDETERMINED = "und"

#: First code points of script ranges, and the script from there on.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "ethiopic", "latin", "greek", "other", "kana", "kana", "other", "han", "other", "hangul", "other", "han", "other", "han", "other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32
    uses: np.ndarray  # scripts x languages, bool


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, is it a mark (part of a word that has letters), and its script's number."""
    letter, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for cp in range(0x32000):
        kind = unicodedata.category(chr(cp))[0]
        letter[cp], mark[cp] = kind == "L", kind == "M"
    script = np.zeros(0x110000, np.int8)
    for start, name in zip(SCRIPT_STARTS, SCRIPT_NAMES, strict=True):
        script[start:] = SCRIPTS.index(name)
    return letter, mark, script


def has_letter(text: str) -> bool:
    return bool(_letters()[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class Words(NamedTuple):
    """The words of several texts put one after another."""

    doc: np.ndarray  # of each word
    start: np.ndarray  # in its text
    size: np.ndarray
    grams: np.ndarray  # bucket of each letter's trigram
    first: np.ndarray  # where each word's trigrams begin
    script: np.ndarray  # of each word's first letter


def split(texts: list[str]) -> Words:
    letter, mark, script = _letters()
    lowered = [t if len(low := t.lower()) != len(t) else low for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    begins = np.cumsum(sizes + 1) - sizes  # one mark before each text
    flat = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le"), np.uint32)
    inside = letter[flat] | mark[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    marked = np.where(inside, flat, 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    mixed = marked[at - 1] * np.uint64(0x9E3779B97F4A7C15) + marked[at] * np.uint64(0xC2B2AE3D27D4EB4F) + marked[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    size = last - first
    lettered = np.add.reduceat(letter[flat[at]].astype(np.int64), np.cumsum(size) - size) > 0 if len(size) else np.zeros(0, bool)
    mixed, first, size = mixed[np.repeat(lettered, size)], first[lettered], size[lettered]  # marks alone are no word
    doc = np.searchsorted(begins, first, side="right") - 1
    return Words(doc, first - begins[doc] if len(begins) else first, size, (mixed >> np.uint64(48)).astype(np.int64), np.cumsum(size) - size, script[flat[first]])


def counts_of(texts: list[str]) -> np.ndarray:
    """Trigram counts, then letters by script."""
    words = split(texts)
    return np.concatenate([np.bincount(words.grams, minlength=BUCKETS), np.bincount(words.script, weights=words.size, minlength=len(SCRIPTS)).astype(np.int64)])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """labelled: doc_id, text, lang. Rows with a null text or language teach nothing; with none left, the model has no language."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = max(1, usable.count())
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(total)) < F.lit(rows)) if total > rows else usable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, "text", 4 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                own = counts_of([texts[i] for i in np.flatnonzero(langs == lang)])
                sums[lang] = sums.get(lang, 0) + own
        for lang, total_of in sums.items():
            at = np.flatnonzero(total_of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total_of[at], pa.int64())], ["lang", "feature", "n"])

    parts = sample.select("lang", "text").mapInArrow(run, "lang string, feature int, n bigint")
    found = parts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most languages x (BUCKETS + scripts) rows
    langs = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    if langs:
        counts[found["feature"].to_numpy(), np.searchsorted(langs, found["lang"])] = found["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, logp, scripts > 0.01 * scripts.sum(axis=0))


def label(model: Model, texts: list[str], switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    """The words of the texts, and the number of each word's language."""
    words = split(texts)
    n = len(words.doc)
    if not n:
        return words, np.zeros(0, np.int16)
    scores = np.add.reduceat(model.logp[words.grams], words.first, axis=0).astype(np.float32)
    allowed = model.uses[words.script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    scores = np.where(allowed, scores, np.float32(-1e6))
    # All texts step through their words together, those with most words first.
    lengths = np.bincount(words.doc, minlength=len(texts))
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths[order[0]])
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    best = np.zeros((len(texts), len(model.langs)), np.float32)
    back = np.zeros((n, len(model.langs)), np.int16)
    own = np.arange(len(model.langs), dtype=np.int16)
    for step in range(longest):
        m = active[step]
        rows = begins[:m] + step
        reached = best[:m]
        if step:
            top = reached.argmax(axis=1)
            changed = reached[np.arange(m), top] - np.float32(switch)
            stay = reached >= changed[:, None]
            back[rows] = np.where(stay, own, top[:, None])
            best[:m] = np.where(stay, reached, changed[:, None]) + scores[rows]
        else:
            best[:m] = scores[rows]
    path = np.zeros(n, np.int16)
    now = best.argmax(axis=1)
    for step in range(longest - 1, -1, -1):
        m = active[step]
        rows = begins[:m] + step
        path[rows] = now[:m]
        now[:m] = back[rows, now[:m]]
    return words, path


def predict(model: Model, texts: list[str | None], spans: bool = False) -> list[tuple[str, float, list | None]]:
    """(language, share of the letters that it has, spans as (start, end, language)) of each text."""
    given = [t or "" for t in texts]
    if not model.langs:
        return [(UNDETERMINED, 0.0, [])] * len(given)
    words, path = label(model, given)
    weights = np.zeros((len(given), len(model.langs)))
    np.add.at(weights, (words.doc, path), words.size)
    total = weights.sum(axis=1)
    found: list[tuple[str, float, list | None]] = []
    bounds = np.searchsorted(words.doc, np.arange(len(given) + 1)) if spans else None
    for k, row in enumerate(weights):
        own: list | None = None
        if spans:
            a, b = bounds[k], bounds[k + 1]
            heads = a + np.flatnonzero(np.diff(path[a:b], prepend=-1))
            tails = np.append(heads[1:], b) - 1
            own = [(int(words.start[i]), int(words.start[j] + words.size[j]), model.langs[path[i]]) for i, j in zip(heads, tails, strict=True)] if b > a else []
        found.append((model.langs[int(row.argmax())], float(row.max() / total[k]), own) if total[k] else (UNDETERMINED, 0.0, own))
    return found


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans (array of start, end, lang) of every whole text.

    Null, empty or letterless texts: `und`, score 0, no spans. Only text is looked at.
    Repeated rows give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # BUCKETS x languages x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in common.slices(batches, "text", 1 << 20):
            got = predict(own, batch.column("text").to_pylist(), spans)
            columns = [batch.column("doc_id"), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())]
            if spans:
                columns.append(pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in g[2]] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows whose text has a language, unchanged; null and letterless texts go. The table's order and other columns don't matter."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("string")
    def language(texts):
        import pandas as pd

        own, found, held, size = Model(*shared.value), [], [], 0
        for text in [*texts, None]:
            held.append(text)
            size += len(text or "")
            if size > 1 << 20 or len(found) + len(held) > len(texts):
                found += [g[0] for g in predict(own, held)]
                held, size = [], 0
        return pd.Series(found[: len(texts)], dtype=object)

    return docs.where(language("text") != UNDETERMINED)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs, model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
