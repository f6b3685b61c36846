"""Detection: candidates of all detectors in one Arrow pass, then conflicts resolved natively."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors
from ..functions.types import CANDIDATES, is_structured, priority


def candidates(text: Column, ner: Column, names: tuple[str, ...] = detectors.NAMES, today: dt.date | None = None) -> Column:
    """Candidate spans (array of structs) of the named detectors. today bounds dates of birth; the driver's date by default."""
    unknown = set(names) - set(detectors.NAMES)
    if unknown:
        raise ValueError(f"no such detectors: {sorted(unknown)}")
    until = today or dt.date.today()

    @F.pandas_udf(CANDIDATES)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            found = []
            for t, own in zip(texts, spans, strict=True):
                named = [(s["label"], s["start"], s["end"]) for s in own] if own is not None else []
                found.append([c._asdict() for c in detectors.scan(t, named, until, names)] if t else [])
            yield pd.Series(found, dtype=object)

    return scan(text, ner)


def tier(c: Column) -> Column:
    """Evidence: 3 a validated structured value, 2 strong context, 1 anything else."""
    return F.when(is_structured(c["entity_type"]) & c["validated"], 3).when(c["strong_context"], 2).otherwise(1)


def resolved(found: Column) -> Column:
    """The best candidates of which no two overlap, by start: a greedy choice in order of evidence, confidence, length and priority."""
    ranked = F.sort_array(
        F.transform(
            found,
            lambda c: F.struct(
                (-tier(c)).alias("t"), (-c["confidence"]).alias("k"), (c["start"] - c["end"]).alias("n"), (-priority(c["entity_type"])).alias("p"),
                c["start"].alias("start"), c["end"].alias("end"), c["recognizer"].alias("recognizer"), c["entity_type"].alias("entity_type"), c.alias("c"),
            ),
        )
    )
    chosen = F.aggregate(
        F.transform(ranked, lambda r: r["c"]),
        F.array().cast(CANDIDATES),
        lambda kept, c: F.when(F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), kept).otherwise(F.array_append(kept, c)),
    )
    placed = F.sort_array(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["entity_type"].alias("entity_type"), c["recognizer"].alias("recognizer"), c.alias("c"))))
    return F.transform(placed, lambda p: p["c"])


def detect(containers: DataFrame, names: tuple[str, ...] = detectors.NAMES, today: dt.date | None = None, resolve: bool = True) -> DataFrame:
    """One row for each entity: the containers' doc_id, container_id, seq and story_type with the candidate's fields.

    Texts are read whole; null and empty ones hold nothing. A container's candidates
    are resolved within its row, so nothing is shuffled.
    """
    found = candidates(F.col("text"), F.col("ner"), names, today)
    own = containers.withColumn("__found", found).where(F.size("__found") > 0)
    spans = resolved(F.col("__found")) if resolve else F.col("__found")
    return own.select("doc_id", "container_id", "seq", "story_type", F.explode(spans).alias("e")).select("doc_id", "container_id", "seq", "story_type", "e.*")


def invalid_spans(containers: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that are not what stands at their place; none, unless a plan is stale."""
    there = containers.select("doc_id", "container_id", F.col("text").alias("__text"))
    same = F.substr("__text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return entities.join(there, ["doc_id", "container_id"], "left").where(~F.coalesce(same, F.lit(False))).drop("__text")


