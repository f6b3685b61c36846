"""Exact set-similarity join of lines, and removal of lines that match an earlier one.

links() returns the whole join: every two near sets, and which lines have which set;
counted() each line's set and the number of sets near it, without making all pairs.
matches() and without_repeated_lines() name one earlier match of each line, which is all
that removal needs; step 5 below is theirs alone.

DataFrame functions only. A line's tokens are its distinct words in lower case, as
56-bit hashes. Two lines match if the Jaccard similarity of their token sets is 0.75
or more; order among lines is (doc_id, digest of the text, line number), so that
different texts under one doc_id are told apart.

1. Each text is split once; a table keeps every line's tokens and a digest of them.
2. Tokens are counted over all lines in BUCKETS counters; their logarithms, one byte
   each, give one order of all tokens, the rarest first. Any common order keeps the
   join exact; this one has a fixed size, whatever the corpus.
3. Equal sets are one from the start: all lines of a set but the first are removed.
4. A set's prefix is its rarest n - ceil(0.75 n) + 1 tokens; sets that match share one
   there. Length, positional and bitmap filters leave the candidates. The bitmap is the
   parity of the tokens in 128 places: two sets differ in as many tokens at least as
   their bitmaps in places.
5. To be removed, a set needs one earlier match, not all: it is first verified against
   the likeliest of the earliest and of the last few sets under its prefix tokens, one for
   each share of the tokens, and only what that has not matched meets every earlier candidate. SHARES shares of the tokens take turns at the shuffle's disk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 21
#: Steps of the rarity scale for each doubling of the count.
STEPS = 3
#: Places of the sieve that finds the lines to verify; what it lets through besides is joined away.
SIEVE = 1 << 21

#: Shares of all tokens that are joined one after another; each takes its share of the shuffle's disk.
SHARES = 3
#: Rows under one token that one task may take when it looks for the earliest.
PART_ROWS = 1 << 20
#: Lines of a token from which on near sets under it are gathered about a centre.
HOT = 512
#: Sets of each hot token, beside the earliest, that others may gather about: that one may be far from most.
PIVOTS = 2
#: Sets that gather at least where a centre is made.
FEW = 8
#: Tokens in which a set may differ from its centre; farther ones are paired as all others are.
FAR = 128
#: Shares of all tokens for the counted join, of which each token has rows of two kinds.
COUNT_SHARES = 5
#: Ratio of the sizes at which a class begins and ends: above 4 / 3, so that near sets are of one class or of two neighbours.
RISE = 1.34
#: Places before a set under each of its tokens, whose sets are tried beside the earliest: in a wide group of near sets many are far from that one.
BACK = (1, 2, 4)
#: Longs in the bitmaps of lines to verify.
WIDE = 4

_AT = ["doc_id", "place"]
_BITS = ["even", "odd"]


def _version(text: str = "text") -> Column:
    """31 bits that tell texts under one doc_id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def _tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, place (version and line number), tokens (sorted, distinct) and digest d1, d2 of the lines that have words."""
    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), _version().alias("version"), F.lower("text").alias("text"))  # once a text, not once a line
    split = rows.select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    odd = [F.contains("words", F.lit(c)) for c in "\t\r\x0b\x0c"]
    spaced = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate("words", "\t\r\x0b\x0c", "    ")).otherwise(F.col("words"))  # one space needs no regular expression
    hashes = F.transform(F.array_remove(F.split(spaced, " ", -1), ""), lambda w: F.shiftrightunsigned(F.xxhash64(w), 8))
    place = F.shiftleft("version", 32).bitwiseOR(F.col("line").cast("bigint"))
    worded = split.where(F.length(F.trim(spaced)) > 0)  # a filter of the tokens would make them twice
    tokens = worded.select("doc_id", place.alias("place"), F.sort_array(F.array_distinct(hashes)).alias("tokens"))
    return tokens.select("doc_id", "place", "tokens", F.xxhash64("tokens").alias("d1"), F.xxhash64(F.lit(7), "tokens").alias("d2"))


def _rarity(lines: DataFrame) -> DataFrame:
    """One row, written: scale, an array with a number for each bucket of tokens: its count on a logarithmic scale, from 1."""
    counts = lines.select(F.explode("tokens").alias("token")).groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    code = (1 + F.least(F.lit(120), F.floor(STEPS * F.log2(F.col("n") + 1)))).cast("tinyint")
    every = counts.select("bucket", code.alias("code")).union(lines.sparkSession.range(BUCKETS).select("id", F.lit(1).cast("tinyint")))
    dense = every.groupBy("bucket").agg(F.max("code").alias("code"))
    codes = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "code"))), lambda b: b["code"])
    parts = dense.groupBy(F.shiftright("bucket", 10).alias("part")).agg(codes.alias("codes"))  # one task gathers arrays, not counters
    return common.written(parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "codes"))), lambda p: p["codes"])).alias("scale")), "rarity")


def _sets(lines: DataFrame, rarity: DataFrame) -> DataFrame:
    """One row for each distinct set: its first line, size n, bitmap and prefix (token keys, the rarest first; null below three tokens)."""
    n = F.size("tokens")
    lines = lines.withColumn("scale", rarity.select("scale").scalar())  # a subquery: as a literal it would fill each plan's description
    # Never null, so that they are sorted as plain longs.
    keys = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.coalesce(F.get(F.col("scale"), t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(1).cast("tinyint")).cast("bigint"), 56).bitwiseOR(t)))
    bits = [F.expr(f"aggregate(tokens, 0L, (parity, t) -> if(t & 64 = {half}, parity ^ shiftleft(1L, cast(t & 63 as int)), parity))").alias(name) for name, half in zip(_BITS, (0, 64), strict=True)]
    prefix = F.slice(keys, F.lit(1), n - F.expr("(3 * size(tokens) + 3) div 4").cast("int") + 1)
    rows = lines.select("d1", "d2", F.struct(*_AT).alias("at"), n.alias("n"), *bits, F.when(n >= 3, prefix).alias("prefix"))
    first = rows.groupBy("d1", "d2").agg(F.min("at").alias("at"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in _BITS], F.first("prefix").alias("prefix"))
    return first.select("d1", "d2", "at.doc_id", "at.place", "n", *_BITS, "prefix", F.lit(True).alias("open"))


def _places(sets: DataFrame) -> DataFrame:
    """A row for each token of a prefix: token, doc_id, place, the bitmap and ni, which packs n, the token's position and whether the set is still unmatched."""
    rows = sets.where("prefix is not null").select(*_AT, "n", *_BITS, "open", F.posexplode("prefix").alias("i", "token"))
    rows = rows.where(F.shiftrightunsigned("token", 56) > 1 + STEPS)  # a token counted once is in no other line
    return rows.select("token", *_AT, *_BITS, F.expr("shiftleft(cast(n as bigint), 32) | shiftleft(cast(i as bigint), 1) | cast(open as bigint)").alias("ni"))


def _candidate(x: str, y: str) -> Column:
    """Whether y is earlier than x, x unmatched, and the filters let both pass. One expression of both sides: both read one shuffle."""
    return F.expr(f"({x}.ni & 1) > if({_earlier(x, y)}, 0, 1) and {_passing(x, y)}")


def _earlier(x: str, y: str) -> str:
    return f"({y}.doc_id < {x}.doc_id or ({y}.doc_id = {x}.doc_id and {y}.place < {x}.place))"


def _passing(x: str, y: str) -> str:
    """Length, bitmap and positional filters."""
    n, m = f"shiftright({x}.ni, 32)", f"shiftright({y}.ni, 32)"
    i, j = (f"shiftright({s}.ni & 4294967295, 1)" for s in (x, y))
    return f"{_alike(x, y)} and 7 * least({n} - {i}, {m} - {j}) >= 3 * ({n} + {m})"


def _alike(x: str, y: str) -> str:
    """Length and bitmap filters."""
    n, m = f"shiftright({x}.ni, 32)", f"shiftright({y}.ni, 32)"
    differ = " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in _BITS)
    return f"4 * least({n}, {m}) >= 3 * greatest({n}, {m}) and 7 * ({differ}) <= {n} + {m}"


def _pairs(rows: DataFrame, others: DataFrame, also: str = "true") -> DataFrame:
    joined = rows.alias("x").join(others.alias("y"), (F.col("x.token") == F.col("y.token")) & _candidate("x", "y") & F.expr(also))
    return joined.select(F.col("x.doc_id").alias("doc_id"), F.col("x.place").alias("place"), F.col("y.doc_id").alias("other_doc"), F.col("y.place").alias("other_place")).distinct()


def _hubs(rows: DataFrame) -> DataFrame:
    """One candidate pair at most for each row's set: of the earliest sets under its tokens, and of those BACK places before it there, the one of the nearest bitmap.

    A token that may have more than PART_ROWS rows, by its count in the key, has several
    parts with an earliest each, so that no task takes a hot token whole.
    """
    doublings = F.greatest(F.lit(0), F.floor((F.shiftrightunsigned("token", 56) - 1) / STEPS) - (PART_ROWS.bit_length() - 1)).cast("int")
    part = F.xxhash64(*_AT).bitwiseAND(F.expr("shiftleft(1L, doublings)") - 1)
    dealt = rows.withColumn("doublings", doublings).withColumn("part", part).drop("doublings")
    window = Window.partitionBy("token", "part").orderBy(*_AT)
    names = rows.columns[1:]
    taken = {"y0": lambda c: F.first(c).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))} | {f"y{k}": lambda c, k=k: F.lag(c, k).over(window) for k in BACK}
    # Column by column: a struct would be shuffled beside them.
    with_others = dealt.select(*names, *[of(c).alias(f"{y}_{c}") for y, of in taken.items() for c in names])
    sides = with_others.select(F.struct(*names).alias("x"), *[F.struct(*[F.col(f"{y}_{c}").alias(c) for c in names]).alias(y) for y in taken])
    differ = {y: F.expr(" + ".join(f"bit_count(x.{b} ^ {y}.{b})" for b in _BITS)) for y in taken}
    hub = F.least(*[F.when(_candidate("x", y), F.struct(differ[y].alias("differ"), F.col(f"{y}.doc_id").alias("doc_id"), F.col(f"{y}.place").alias("place"))) for y in taken])
    tried = sides.select("x.doc_id", "x.place", hub.alias("hub")).where("hub is not null")
    nearest = tried.groupBy(*_AT).agg(F.min("hub").alias("hub"))
    return nearest.select(*_AT, F.col("hub.doc_id").alias("other_doc"), F.col("hub.place").alias("other_place"))


def _sieve(wanted: DataFrame) -> DataFrame:
    """One row, written: words, the bitmap in which the place of each wanted line is set, as SIEVE / 64 longs."""
    word = F.shiftright(_slot(), 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = wanted.select(_slot().alias("slot"), word).select("word", bit.alias("bit"))
    every = found.union(wanted.sparkSession.range(SIEVE >> 6).select("id", F.lit(0).cast("bigint")))
    dense = every.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return common.written(dense.agg(words.alias("words")), "sieve")


def _slot() -> Column:
    return F.xxhash64(*_AT).bitwiseAND(F.lit(SIEVE - 1))


def _sieved(lines: DataFrame, sieve: DataFrame) -> DataFrame:
    """lines (with doc_id, place) that the sieve lets through."""
    word = F.get(sieve.select("words").scalar(), F.shiftright(_slot(), 6).cast("int"))
    return lines.where(F.getbit(word, _slot().bitwiseAND(F.lit(63)).cast("int")) == 1)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of pairs whose Jaccard similarity, on all tokens, reaches the threshold; differ: in how many tokens.

    Wider bitmaps, of WIDE times 64 places, go first: they are small, and what passes is mostly near.
    """
    ends = _ends(pairs)
    parity = [F.expr(f"aggregate(tokens, 0L, (parity, t) -> parity ^ if(shiftright(t, 6) % {WIDE} = {k}, shiftleft(1L, cast(t & 63 as int)), 0L))").alias(f"b{k}") for k in range(WIDE)]
    sieve = _sieve(ends)
    held = _sieved(lines.select(*_AT, "tokens"), sieve).join(ends, _AT, "left_semi").dropDuplicates(_AT)
    held = common.written(held.select("*", F.size("tokens").alias("n"), *parity), "members")
    small = held.drop("tokens")
    far = small.select(F.col("doc_id").alias("other_doc"), F.col("place").alias("other_place"), *[F.col(c).alias(f"o{c}") for c in small.columns[2:]])
    differ = " + ".join(f"bit_count(b{k} ^ ob{k})" for k in range(WIDE))
    near = pairs.join(small, _AT).join(far, ["other_doc", "other_place"]).where(f"7 * ({differ}) <= n + on").select(*pairs.columns)
    near = common.written(near, "pairs")
    common.swept(near.sparkSession)
    narrow = _sieve(_ends(near))
    held_near = _sieved(held.select(*_AT, "tokens"), narrow)
    other = held_near.select(F.col("doc_id").alias("other_doc"), F.col("place").alias("other_place"), F.col("tokens").alias("other_tokens"))
    both = near.join(held_near, _AT).join(other, ["other_doc", "other_place"])
    shared, sizes = F.size(F.array_intersect("tokens", "other_tokens")), F.size("tokens") + F.size("other_tokens")
    found = common.written(both.where(7 * shared >= 3 * sizes).select(*pairs.columns, (sizes - 2 * shared).alias("differ")), "found")
    common.dropped(sieve, narrow, held, near)
    return found


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(*_AT).union(pairs.select("other_doc", "other_place")).distinct()


def _shared(sets: DataFrame, pairs: Callable[[DataFrame], DataFrame], places: Column | None = None, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """What pairs finds among the rows (those of places, if given) of each share of the tokens, and more, written."""
    found = list(more)
    for share in range(SHARES):
        own = F.pmod("token", F.lit(SHARES)) == share
        found.append(common.written(pairs(_places(sets).where(own if places is None else own & places)), "pairs"))
        common.swept(sets.sparkSession)
    every = common.written(reduce(DataFrame.union, found).distinct(), "pairs")
    common.dropped(*found)
    return every


def _near(lines: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, place, other_doc, other_place: sets that have an earlier near one, and some of those; and sets anew, marked by what the first step matched."""
    pairs = _shared(sets, _hubs)
    first = _verified(pairs, lines)
    common.dropped(pairs)
    matched = first.select(*_AT).distinct().withColumn("done", F.lit(True))
    marked = common.written(sets.join(matched, _AT, "left").select(*sets.columns[:-1], F.col("done").isNull().alias("open")), "marked")
    common.dropped(sets)
    pairs = _shared(marked, lambda rows: _pairs(rows, rows))
    second = _verified(pairs, lines)
    common.dropped(pairs)
    near = common.written(first.union(second), "near")
    common.dropped(first, second)
    return near, marked


def _repeated(docs: DataFrame) -> DataFrame:
    """doc_id, place, match_doc, match_place of every line that matches an earlier one (of several, one is named)."""
    lines = common.written(_tokenised(docs.select("doc_id", "text")), "tokens")
    rarity = _rarity(lines)
    sets = common.written(_sets(lines, rarity), "sets")
    common.dropped(rarity)
    near, sets = _near(lines, sets)
    other = near.groupBy(*_AT).agg(F.min(F.struct("other_doc", "other_place")).alias("near"))
    first = sets.select("d1", "d2", *_AT).join(other, _AT, "left").select("d1", "d2", F.struct(*_AT).alias("at"), "near")
    own = F.struct("doc_id", "place") == F.col("at")
    told = lines.select(*_AT, "d1", "d2").join(first, ["d1", "d2"]).select(*_AT, F.when(own, F.col("near")).otherwise(F.coalesce("near", F.expr("named_struct('other_doc', at.doc_id, 'other_place', at.place)"))).alias("match"))
    told = common.written(told.where("match is not null").select(*_AT, F.col("match.other_doc").alias("match_doc"), F.col("match.other_place").alias("match_place")).distinct(), "repeated")
    common.dropped(lines, sets, near)
    return told


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, place, match_doc, match_place, same: each line with the first line of its words, if another; and each two first lines whose sets are near."""
    lines = common.written(_tokenised(docs.select("doc_id", "text")), "tokens")
    rarity = _rarity(lines)
    sets = common.written(_sets(lines, rarity), "sets")
    common.dropped(rarity)
    pairs = _shared(sets, lambda rows: _pairs(rows, rows))
    near = _verified(pairs, lines)
    common.dropped(pairs)
    first = sets.select("d1", "d2", F.struct(*_AT).alias("at"))
    members = lines.select(*_AT, "d1", "d2").join(first, ["d1", "d2"]).where(F.struct(*_AT) != F.col("at"))
    told = members.select(*_AT, F.col("at.doc_id").alias("match_doc"), F.col("at.place").alias("match_place"), F.lit(True).alias("same")).distinct()
    told = common.written(told.union(near.select(*_AT, "other_doc", "other_place", F.lit(False))), "links")
    common.dropped(lines, sets, near)
    return told


def _hot(rarity: DataFrame) -> Column:
    """Whether a token may be in HOT lines or more, by its count in the key; that is 8 times the median counter at least, as words share counters in a large corpus."""
    middle = rarity.select(F.get(F.sort_array("scale"), F.lit(BUCKETS // 2)).cast("int")).first()[0]
    return F.shiftrightunsigned("token", 56) > max(int(STEPS * math.log2(HOT)), middle + 3 * STEPS)


def _rising(larger: DataFrame, smaller: DataFrame, also: str = "true") -> DataFrame:
    """Candidate pairs of rows of _sides(): doc_id, place of the larger set (of two as large, the later one), other_doc, other_place of the other."""
    n, m = "shiftright(x.ni, 32)", "shiftright(y.ni, 32)"
    passing = F.expr(f"({m} < {n} or ({m} = {n} and {_earlier('x', 'y')})) and {_passing('x', 'y')} and {also}")
    joined = larger.alias("x").join(smaller.alias("y"), (F.col("x.key") == F.col("y.key")) & passing)
    return joined.select("x.doc_id", "x.place", F.col("y.doc_id").alias("other_doc"), F.col("y.place").alias("other_place")).distinct()


def _sides(sets: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the sets under the tokens that own chooses, as the larger and as the smaller of two.

    The larger set, of n tokens, shares at least 3 (n + m) / 7 of them with one of m: with
    all its prefix it meets those tokens of the smaller one among which 6 m / 7 leave one
    out, m div 7 + 1. The key has the class of the larger set's size; a smaller one is of that
    class or the next below. Under the next above, whose sizes begin at b, it needs
    only as many tokens as 3 (b + m) / 7 leave.
    """
    level = F.floor(F.log("n") / math.log(RISE)).cast("int")
    held = sets.where("prefix is not null").select(*_AT, "n", *_BITS, "prefix", level.alias("level"))
    seen = (F.shiftrightunsigned("token", 56) > 1 + STEPS) & own  # a token counted once is in no other line
    ni = F.expr("shiftleft(cast(n as bigint), 32) | shiftleft(cast(i as bigint), 1) | 1").alias("ni")
    larger = held.select(*_AT, "n", *_BITS, "level", F.posexplode("prefix").alias("i", "token")).where(seen)
    larger = larger.select(F.xxhash64("token", "level").alias("key"), *_AT, *_BITS, ni)
    above = F.expr(f"n - (3 * (cast(floor(power({RISE}D, level + 1)) as int) + n) + 6) div 7 + 1")
    smaller = held.select(*_AT, "n", *_BITS, "level", above.alias("above"), F.posexplode(F.slice("prefix", F.lit(1), F.expr("cast(n div 7 as int) + 1"))).alias("i", "token")).where(seen)
    levels = F.when(F.col("i") < F.col("above"), F.array(F.col("level"), F.col("level") + 1)).otherwise(F.array("level"))
    smaller = smaller.select("token", *_AT, *_BITS, ni, F.explode(levels).alias("under"))
    return larger, smaller.select(F.xxhash64("token", "under").alias("key"), *_AT, *_BITS, "ni")


def _centred(sets: DataFrame, lines: DataFrame, hot: Column) -> DataFrame:
    """doc_id, place, c1, c2, n, spare, apart of sets about a centre: the digest of its tokens, in which tokens the set differs from it, and n less 7 times their number.

    Sets under hot tokens gather about the earliest set there that passes the filters or, if
    none does, about one of PIVOTS sets there that their digests choose. The centre is what
    most of those gathered hold, no line of its own; equal centres are one. Any set may be
    about any centre: what follows is exact for all.
    """
    rows = _places(sets).where(hot)
    names = rows.columns[1:]
    chosen = [F.min(F.struct(*names)).alias("y0")] + [F.min(F.struct(F.xxhash64(F.lit(k), *_AT).alias("h"), *names)).alias(f"y{k}") for k in range(1, PIVOTS + 1)]
    sides = rows.join(rows.groupBy("token").agg(*chosen), "token").select(F.struct(*names).alias("x"), *[f"y{k}" for k in range(PIVOTS + 1)])
    passing = [_candidate("x", "y0")] + [F.expr(f"(x.doc_id != y{k}.doc_id or x.place != y{k}.place) and {_alike('x', f'y{k}')}") for k in range(1, PIVOTS + 1)]
    pivot = ["pivot_doc", "pivot_place"]
    tried = [F.when(passes, F.struct(F.lit(k).alias("k"), F.col(f"y{k}.doc_id").alias("pivot_doc"), F.col(f"y{k}.place").alias("pivot_place"))) for k, passes in enumerate(passing)]
    gathered = sides.select("x.doc_id", "x.place", F.coalesce(*tried).alias("to")).where("to is not null").groupBy(*_AT).agg(F.min("to").alias("to"))
    own = common.written(gathered.select(*_AT, *[f"to.{c}" for c in pivot]), "own")
    alone = own.select(F.col("pivot_doc").alias("doc_id"), F.col("pivot_place").alias("place")).distinct().join(own, _AT, "left_anti")
    every = own.union(alone.select(*_AT, F.col("doc_id").alias("pivot_doc"), F.col("place").alias("pivot_place")))
    every = every.join(every.groupBy(*pivot).agg(F.count("*").alias("gathered")).where(f"gathered >= {FEW}").select(*pivot), pivot)  # fewer are paired as all others are
    sieve = _sieve(every.select(*_AT))
    held = common.written(_sieved(lines.select(*_AT, "tokens"), sieve).join(every, _AT).dropDuplicates(_AT), "members")
    counts = held.select(*pivot, F.explode("tokens").alias("token")).groupBy(*pivot, "token").agg(F.count("*").alias("c"))
    most = counts.join(held.groupBy(*pivot).agg(F.count("*").alias("gathered")), pivot).where("2 * c > gathered")
    centres = most.groupBy(*pivot).agg(F.sort_array(F.collect_list("token")).alias("centre"))
    apart = F.concat(F.array_except("tokens", "centre"), F.array_except("centre", "tokens"))
    near = held.join(centres, pivot).select(*_AT, F.xxhash64("centre").alias("c1"), F.xxhash64(F.lit(7), "centre").alias("c2"), F.size("tokens").alias("n"), apart.alias("apart"))
    near = near.select("*", (F.col("n") - 7 * F.size("apart")).alias("spare"))
    members = common.written(near.where(f"spare >= -3 * n and size(apart) <= {FAR}"), "centred")
    common.dropped(own, sieve, held)
    return members


def _unsure(members: DataFrame) -> DataFrame:
    """Every two sets about one centre that are near though their distances from it do not prove it: those differ in common tokens, under the least of which they meet."""
    rows = members.select(*_AT, "c1", "c2", "spare", "apart", F.explode("apart").alias("token"))
    both = "array_intersect(x.apart, y.apart)"
    near = F.expr(f"x.c1 = y.c1 and x.c2 = y.c2 and x.token = y.token and {_earlier('x', 'y')} and x.spare + y.spare < 0 and x.spare + y.spare + 14 * size({both}) >= 0 and array_min({both}) = x.token")
    joined = rows.alias("x").join(rows.alias("y"), near)
    return joined.select("x.doc_id", "x.place", F.col("y.doc_id").alias("other_doc"), F.col("y.place").alias("other_place"))


def _sure(members: DataFrame) -> DataFrame:
    """doc_id, place, links: how many others about its centre a set is surely near, by the centre's counts of each spare."""
    counts = members.groupBy("c1", "c2", "spare").agg(F.count("*").alias("c"))
    every = counts.groupBy("c1", "c2").agg(F.collect_list(F.struct("spare", "c")).alias("all"))
    each = every.select("c1", "c2", "all", F.explode("all").alias("own"))
    links = F.expr("aggregate(all, 0L, (sum, o) -> if(o.spare + own.spare >= 0, sum + o.c, sum)) - if(own.spare >= 0, 1, 0)")
    return members.join(each.select("c1", "c2", "own.spare", links.alias("links")), ["c1", "c2", "spare"]).select(*_AT, "links")


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, place, class_doc, class_place, n_links of every line with words.

    Two sets that differ from a centre in a and b tokens, c of them in both, differ in
    a + b - 2 c. Where 7 (a + b) <= n + m they are near, and are counted without being
    paired; else they are near only if they share such a token, and are paired by it. So
    pairs do not grow with the square of a wide group of near sets; all others are
    verified as in _linked.
    """
    lines = common.written(_tokenised(docs.select("doc_id", "text")), "tokens")
    rarity = _rarity(lines)
    sets = common.written(_sets(lines, rarity), "sets")
    hot = _hot(rarity)
    common.dropped(rarity)
    members = _centred(sets, lines, hot)
    unsure = common.written(_unsure(members), "unsure")
    mine = members.select(*_AT, "c1", "c2")
    larger, smaller = (side.join(mine, _AT, "left") for side in _sides(sets, hot))
    found = [common.written(_rising(larger, smaller, "not coalesce(x.c1 = y.c1 and x.c2 = y.c2, false)"), "pairs")]
    for share in range(COUNT_SHARES):
        common.swept(sets.sparkSession)
        found.append(common.written(_rising(*_sides(sets, ~hot & (F.pmod("token", F.lit(COUNT_SHARES)) == share))), "pairs"))
    common.swept(sets.sparkSession)
    # Two about one centre, met under a token that is not hot, are counted already.
    theirs = mine.toDF("other_doc", "other_place", "o1", "o2")
    apart = reduce(DataFrame.union, found).distinct().join(mine, _AT, "left").join(theirs, ["other_doc", "other_place"], "left")
    pairs = common.written(apart.where("not coalesce(c1 = o1 and c2 = o2, false)").select(*_AT, "other_doc", "other_place"), "pairs")
    common.dropped(*found)
    near = _verified(pairs, lines)
    common.dropped(pairs)
    linked = near.select(*_AT, "other_doc", "other_place").union(unsure)
    ends = linked.select(*_AT, F.lit(1).cast("bigint").alias("links")).union(linked.select("other_doc", "other_place", F.lit(1).cast("bigint")))
    links = ends.union(_sure(members)).groupBy(*_AT).agg(F.sum("links").alias("links"))
    classes = sets.select("d1", "d2", *_AT).join(links, _AT, "left").select("d1", "d2", F.col("doc_id").alias("class_doc"), F.col("place").alias("class_place"), F.coalesce("links", F.lit(0)).alias("n_links"))
    told = common.written(lines.select(*_AT, "d1", "d2").join(classes, ["d1", "d2"]).select(*_AT, "class_doc", "class_place", "n_links").distinct(), "classes")
    common.dropped(lines, sets, members, near, unsure)
    return told


def _line(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, line, match_doc_id, match_line of every line that matches an earlier one (of several, one is named).

    docs: doc_id, text; other columns are not read. Lines end at a line feed and are
    numbered from 0. Lines without words, null texts and rows with a null doc_id match
    nothing. Rows that repeat a doc_id and text are one document: the same line of both
    isn't earlier. Different texts under one doc_id are documents of their own, in the
    order of their digests; lines of both may then have the same number.
    """
    return _repeated(docs).select("doc_id", _line("place").alias("line"), F.col("match_doc").alias("match_doc_id"), _line("match_place").alias("match_line"))


def links(docs: DataFrame) -> DataFrame:
    """doc_id, line, match_doc_id, match_line, same: the whole similarity join, classes of equal sets not expanded.

    Lines of the same words are one class; its representative is the earliest of them.
    Where same, the line belongs to the class of match (a row for each line but the
    representatives). Elsewhere both are representatives, match the earlier one, and
    their sets differ but reach the threshold: a row for every such two classes. Rows,
    lines and their order are those of matches().
    """
    return _linked(docs).select("doc_id", _line("place").alias("line"), F.col("match_doc").alias("match_doc_id"), _line("match_place").alias("match_line"), "same")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, line, class_doc_id, class_line, n_links: the whole similarity join, its links counted.

    A row for every line that has words: the class of its words, by the earliest of
    their lines, and how many other classes are near that one. Classes and links are
    those of links(), whose pairs are not all made for it. Lines are those of matches().
    """
    return _counted(docs).select("doc_id", _line("place").alias("line"), F.col("class_doc").alias("class_doc_id"), _line("class_place").alias("class_line"), "n_links")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the text of each row less the lines that match an earlier one; other lines and columns as they are.

    A text of which no line is removed stays as it is, null ones too; one of which all
    are removed becomes empty.
    """
    found = _repeated(docs).groupBy(F.col("doc_id").alias("__mw_doc"), F.shiftrightunsigned("place", 32).alias("__mw_version")).agg(F.collect_list(_line("place")).alias("__mw_gone"))
    joined = docs.join(found, (docs["doc_id"].cast("bigint") == F.col("__mw_doc")) & (_version(docs["text"]) == F.col("__mw_version")), "left")
    parted = joined.withColumn("__mw_lines", F.when(F.col("__mw_gone").isNotNull(), F.split("text", "\n", -1)))
    parted = parted.withColumn("__mw_kept", F.array_except(F.sequence(F.lit(0), F.size("__mw_lines") - 1), "__mw_gone"))
    # The generator keeps the split from being done anew for each line.
    held = parted.select(*[F.col(f"`{c}`") for c in docs.columns], "__mw_gone", F.explode(F.array(F.struct("__mw_lines", "__mw_kept"))).alias("__mw"))
    kept = F.array_join(F.transform("__mw.__mw_kept", lambda i: F.get(F.col("__mw.__mw_lines"), i)), "\n")
    return held.withColumn("text", F.when(F.col("__mw_gone").isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(common.table(spark, sf_dir, "documents", "doc_id", "text"))
