"""Personal identifiers: fixed shapes as seeds, and bootstrapped contexts that find more.

Seeds are what the fixed rules match: the four base kinds, and secrets of well-known
form (long hexadecimal strings, keys with a public prefix). The words around them are
lexical patterns; an identifier-like string of looser shape is a candidate. Spark scores the graph of
patterns and values in rounds: a pattern by the share of all its occurrences in the
corpus that are followed by values known so far, a value by its patterns. Candidates
whose score reaches ACCEPT are found, and support further patterns as seeds do, until
nothing changes; seeds always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Found besides the base kinds.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)

#: A pattern needs that many distinct seeds or accepted values, and that share of its occurrences to be identifiers.
SEEDS, CONFIDENCE = 3, 0.5
#: Score from which a candidate is one; rise of scores that asks for another round.
ACCEPT, SETTLED = 0.6, 1e-6
#: Bits of the sieve of pattern hashes that is broadcast. What it lets through is joined with the patterns themselves.
SIEVE_BITS = 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36,}|xox[abps]-[0-9A-Za-z-]{20,}|sk-[0-9A-Za-z_-]{20,})(?![0-9A-Za-z])")
_WORD = re.compile(r"\S+")

#: Looser shapes of candidates.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z](?:[0-9A-Za-z_+/=~.-]{6,}[0-9A-Za-z=])(?![0-9A-Za-z])"),
}


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(map(int, digits[-1::-2])) + sum(double[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then by kind as in KINDS."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def secret_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of secrets of well-known form: hexadecimal ones have digits and letters."""
    if not _DIGIT.search(text):
        return []
    return [(m.start(), SECRET, m.end()) for m in _SECRET.finditer(text) if _mixed(m[0])]


def _mixed(text: str) -> bool:
    return bool(_DIGIT.search(text)) and any(c.isalpha() for c in text)


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Strings of looser shapes that overlap none of the seeds given; of those that overlap each other, the first by start, then kind."""
    found: list[tuple[int, int, int]] = []
    digits = _DIGIT.search(text)
    for k, kind in enumerate(ALL_KINDS):
        if digits if kind != "email" else ("at" in text and ("(at" in text or "[at" in text or "{at" in text or " at " in text)):
            for m in _LOOSE[kind].finditer(text):
                if _mixed(m[0]) if kind == SECRET else kind != "phone" or 7 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), k, m.end()))
    taken = sorted((a, b) for a, _, b in base)
    out: list[tuple[int, str, int]] = []
    end = -1
    for a, k, b in sorted(found):
        if a >= end and not any(x < b and a < y for x, y in taken):
            out.append((a, ALL_KINDS[k], b))
            end = b
    return out


def value_of(kind: str, text: str) -> str:
    if kind == SECRET:
        return text
    return re.sub(r"\s+", "", text.lower()) if kind in ("email", "ip") else "".join(_DIGIT.findall(text))


class Words:
    """The words of a text: what white space parts, as _occurrences counts them, however long."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def at(self, k: int) -> str | None:
        if not 0 <= k < len(self.spans):
            return None
        a, b = self.spans[k]
        return self.text[a:b].lower()

    def contexts(self, start: int, end: int) -> list[str]:
        """The lexical patterns around a span: the word before that in which it starts, and the one before or the one after that in which it ends."""
        first = bisect_right(self.starts, start) - 1
        near, far, after = self.at(first - 1), self.at(first - 2), self.at(bisect_right(self.starts, end - 1))
        if near is None:
            return []
        return [f"1 {near}", *([f"2 {far} {near}"] if far else []), *([f"3 {near} {after}"] if after else [])]


_OCCURRENCE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def _extracted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                seeds = base_spans(text) + secret_spans(text)
                more = candidates(text, seeds)
                words = Words(text) if seeds or more else None
                own = [(k, a, b, known, value_of(k, text[a:b]), words.contexts(a, b)) for spans, known in ((seeds, True), (more, False)) for a, k, b in spans]
                rows.append((f"{doc_id}:{xxhash.xxh3_128_hexdigest(text)}" if more else None, [dict(zip(("kind", "start", "end", "base", "value", "patterns"), o, strict=True)) for o in own]))
            keys, lists = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(lists, pa.list_(_OCCURRENCE))], ["doc_id", "key", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key string, own array<struct<kind:string,start:int,end:int,base:boolean,value:string,patterns:array<string>>>")


def _bits(form: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in the sieve of patterns of one form (1, 2 or 3), by the hashes of their words."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(form)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _hashes(words: Iterable[str]) -> np.ndarray:
    """Hashes of words; 0 for the empty one, which stands for none."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in words], np.uint64)


def _sieve(patterns: DataFrame) -> np.ndarray:
    """A bitmap in which the place of each pattern is set; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [p.split(" ") for p in batch.column("pattern").to_pylist()]
            for form in (1, 2, 3):
                own = [c for c in cut if c[0] == str(form)]
                bits = _bits(form, _hashes(c[1] for c in own), _hashes(c[2] if form > 1 else "" for c in own))
                yield pa.RecordBatch.from_arrays([pa.array(bits + 1, pa.int64())], ["bit"])

    parts = patterns.select("pattern").mapInArrow(run, "bit bigint").groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toLocalIterator():
        sieve[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return sieve


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each of the patterns (and some others) occurs in the corpus, whatever follows it."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(patterns))

    def sent(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["pattern", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, sums = shared.value, Counter()
        for batch in common.slices(batches, "text", 2 << 20):
            flat: list[str] = []
            for text in batch.column("text").to_pylist():
                flat += text.lower().split() if text else []
                flat += [""] * 4  # no pattern reaches over these
            places = {w: k for k, w in enumerate(dict.fromkeys(["", *flat]))}
            words, hashes = list(places), _hashes(places)
            ids = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
            for form, step in ((1, 0), (2, 1), (3, 2), (3, 3), (3, 4)):
                first, second = ids[: len(ids) - step], ids[step:]
                if form == 1:
                    second = np.zeros_like(first)
                bits = _bits(form, hashes[first], hashes[second])
                hit = (sieve[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool) & (first > 0) & ((second > 0) | (form == 1))
                pairs, counts = np.unique(first[hit] * len(words) + second[hit], return_counts=True)
                for pair, n in zip(pairs.tolist(), counts.tolist(), strict=True):
                    a, b = divmod(pair, len(words))
                    sums[f"{form} {words[a]} {words[b]}" if b else f"{form} {words[a]}"] += n
            if len(sums) > 200_000:
                yield sent(sums)
                sums.clear()
        yield sent(sums)

    return docs.select("text").mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("total"))


def found_values(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """kind, value, score of the candidates' values, by rounds over the graph of patterns and values.

    Each round induces patterns from the seeds and the values accepted so far. Scores
    only rise from round to round; the rounds end when none rises by more than SETTLED.
    """
    occurrences = extracted.select(F.explode("own").alias("o")).select("o.kind", "o.value", "o.base", F.explode("o.patterns").alias("pattern"))
    edges = occurrences.groupBy("kind", "pattern", "value", "base").agg(F.count("*").alias("n"))
    most = edges.groupBy("kind", "pattern").agg(F.count("*").alias("values"), F.count_if(~F.col("base")).alias("others"))
    kept = common.written(most.where((F.col("values") >= SEEDS) & (F.col("others") > 0)).select("kind", "pattern"), "patterns")
    graph = common.written(edges.join(kept, ["kind", "pattern"]).join(_occurrences(docs, kept), "pattern"), "graph")
    score = F.when(F.col("base"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    values = docs.sparkSession.createDataFrame([], "kind string, value string, score double")
    risen = not graph.isEmpty()
    while risen:
        known = graph.join(values, ["kind", "value"], "left").withColumn("score", score)
        trust = (F.sum(F.col("score") * F.col("n")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence")
        patterns = known.groupBy("kind", "pattern").agg(trust, F.count_distinct(F.when(F.col("score") >= ACCEPT, F.col("value"))).alias("support")).where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SEEDS))
        reached = graph.where("not base").join(patterns, ["kind", "pattern"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        last, values = values, common.written(reached.groupBy("kind", "value").agg((1 - doubt).alias("score")), "values")
        before = last.withColumnRenamed("score", "before")
        risen = not values.join(before, ["kind", "value"], "left").where(F.col("score") > F.coalesce("before", F.lit(0.0)) + SETTLED).isEmpty()
    return values


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, base (of the four base kinds) and all (with secrets and what contexts reveal; arrays of kind, start, end, by start and then kind) of every whole text.

    Offsets are code points, ends exclusive. Null texts are empty. Each row is judged by
    its own text; repeated rows give repeated rows; other columns are not read.
    """
    extracted = common.written(_extracted(docs), "identifiers")
    values = found_values(docs, extracted).where(F.col("score") >= ACCEPT).select("kind", "value")
    loose = extracted.where("key is not null").select("key", F.explode("own").alias("o")).where("not o.base").select("key", F.col("o.kind").alias("kind"), "o.value", "o.start", "o.end").distinct()
    more = loose.join(values, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    spans = lambda kept: F.transform(F.filter("own", kept), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    base = spans(lambda o: o["base"] & (o["kind"] != SECRET)).alias("base")
    seeds = spans(lambda o: o["base"]).alias("seeds")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    # Most rows have no candidate and no key: they take no part in the join.
    asked = extracted.where("key is not null").join(more, "key", "left").select("doc_id", base, seeds, F.coalesce("more", none).alias("more"))
    joined = asked.union(extracted.where("key is null").select("doc_id", base, seeds, none.alias("more")))
    return joined.select("doc_id", "base", F.expr(f"array_sort(concat(seeds, more), (l, r) -> cast(case when l.start <> r.start then l.start - r.start else {_rank('l')} - {_rank('r')} end as int))").alias("all"))


def _rank(side: str) -> str:
    return f"array_position(array({', '.join(map(repr, ALL_KINDS))}), {side}.kind)"


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_personal_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 are of the base spans; spans, n_spans and n_secret of all."""
    found = identifiers(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    more = F.size("all").cast("bigint").alias("n_spans"), F.expr(f"cast(size(filter(all, s -> s.kind = '{SECRET}')) as bigint)").alias(f"n_{SECRET}")
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), *more)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span as its kind in angle brackets; of overlapping ones, the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])

