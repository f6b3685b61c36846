"""Replacing spans in texts and in the runs that texts are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rewritten_text(text: Column, replacements: Column) -> Column:
    """text with each (start, end, replacement) put in place, from the right."""
    return F.aggregate(F.sort_array(replacements, False), text, lambda acc, r: F.concat(F.substr(acc, F.lit(1), r["start"]), r["replacement"], F.substr(acc, r["end"] + 1)))


def run_starts(run_texts: Column) -> Column:
    """Runs with their index, start and end in the joined text; empty ones too."""
    zero = F.array().cast("array<struct<run_index:int,start:int,end:int,text:string>>")

    def add(acc: Column, text: Column) -> Column:
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.array_append(acc, F.struct(F.size(acc).alias("run_index"), start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text")))

    return F.aggregate(run_texts, zero, add)


def mapped_span(run_texts: Column, start: Column, end: Column) -> Column:
    """The part of each run that a span covers: run_index, start and end within the run."""
    hit = F.filter(run_starts(run_texts), lambda r: (r["start"] < end) & (start < r["end"]))
    return F.transform(hit, lambda r: F.struct(r["run_index"].alias("run_index"), (F.greatest(start, r["start"]) - r["start"]).alias("start_in_run"), (F.least(end, r["end"]) - r["start"]).alias("end_in_run")))


def affected_runs(run_texts: Column, start: Column, end: Column) -> Column:
    return F.size(mapped_span(run_texts, start, end))


def rewritten_runs(run_texts: Column, replacements: Column) -> Column:
    """Run texts after replacing: a replacement goes into the first run that it touches, what it covers in later ones goes."""

    def one(run: Column) -> Column:
        touching = F.filter(F.sort_array(replacements, False), lambda r: (run["start"] < r["end"]) & (r["start"] < run["end"]))

        def put(acc: Column, r: Column) -> Column:
            before = F.substr(acc, F.lit(1), F.greatest(r["start"] - run["start"], F.lit(0)))
            inside = F.when(r["start"] >= run["start"], r["replacement"]).otherwise("")
            return F.concat(before, inside, F.substr(acc, F.least(r["end"], run["end"]) - run["start"] + 1))

        return F.aggregate(touching, run["text"], put)

    return F.transform(run_starts(run_texts), one)


def changed_runs(run_texts: Column, new_runs: Column) -> Column:
    """Indexes of the runs whose text changes."""
    pairs = F.transform(F.arrays_zip(run_texts.alias("a"), new_runs.alias("b")), lambda p, i: F.when(p["a"] != p["b"], i))
    return F.filter(pairs, lambda i: i.isNotNull())


def unsafe(rewrite_safe: Column, unsafe_runs: Column, changed: Column) -> Column:
    """The container may not be rewritten, or a run that changes holds more than text."""
    return ~rewrite_safe | F.arrays_overlap(unsafe_runs, changed)


def invalid_replacements(text: Column, replacements: Column) -> Column:
    """A span is empty or outside the text, or two overlap."""
    ordered = F.sort_array(replacements)
    outside = F.exists(ordered, lambda r: (r["start"] < 0) | (r["end"] <= r["start"]) | (r["end"] > F.length(text)))
    follows = F.exists(F.transform(ordered, lambda r, i: (i > 0) & (r["start"] < F.get(ordered, i - 1)["end"])), lambda x: x)
    return outside | follows
