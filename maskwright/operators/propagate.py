"""Exact repeats: values found in a container are found at their other places there too."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import CANDIDATE
from ..functions.values import normalized_value

REPEAT = "exact_repeat_propagation"


def with_value(entities: DataFrame) -> DataFrame:
    """entities with `value`, the normal form under which repeats are the same."""
    value = normalized_value(F.col("entity_type"), F.col("text"), F.col("normalized"))
    return entities.select(*[c for c in entities.columns if c != "value"], F.explode(F.array(value)).alias("value"))  # once: later steps refer to it often


def propagate(containers: DataFrame, entities: DataFrame) -> DataFrame:
    """entities, and their repeats in the containers that hold the same value already.

    For each value of a document the detection with most confidence, the first among
    equals, gives the text to look for (white space and case don't matter, words stay
    whole). Places that are taken stay so; values that appear first go first.
    """
    order = (F.col("seq"), F.col("start"), F.col("end"))
    keyed = with_value(entities)
    by_value = Window.partitionBy("doc_id", "entity_type", "value")
    exemplar = keyed.withColumn("__n", F.row_number().over(by_value.orderBy(F.desc("confidence"), *order))).withColumn("__first", F.min(F.struct(*order)).over(by_value))
    exemplar = exemplar.where("__n = 1").select("doc_id", "entity_type", "value", F.col("text").alias("__text"), F.col("confidence").alias("__confidence"), "__first")
    wanted = keyed.select("doc_id", "container_id", "entity_type", "value").distinct().join(exemplar, ["doc_id", "entity_type", "value"])
    looked_for = F.sort_array(F.collect_list(F.struct("__first", F.col("entity_type").alias("type"), F.col("__text").alias("text"), F.col("__confidence").alias("confidence"))))
    by_container = wanted.groupBy("doc_id", "container_id").agg(looked_for.alias("__wanted"))
    taken = entities.groupBy("doc_id", "container_id").agg(F.collect_list(F.struct("start", "end")).alias("__taken"))
    own = containers.select("doc_id", "container_id", "seq", "story_type", F.col("text").alias("__whole")).join(by_container, ["doc_id", "container_id"]).join(taken, ["doc_id", "container_id"])
    repeats = own.select("doc_id", "container_id", "seq", "story_type", F.explode(_repeats(F.col("__whole"), F.col("__wanted"), F.col("__taken"))).alias("e"))
    return entities.unionByName(repeats.select("doc_id", "container_id", "seq", "story_type", "e.*"))


def _repeats(text: Column, wanted: Column, taken: Column) -> Column:
    @F.pandas_udf(f"array<{CANDIDATE}>")
    def find(texts: pd.Series, values: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([repeats_in(t, [(w["type"], w["text"], w["confidence"]) for w in v], [(s["start"], s["end"]) for s in o]) for t, v, o in zip(texts, values, spans, strict=True)], dtype=object)

    return find(text, wanted, taken)


def repeats_in(text: str, wanted: list[tuple[str, str, float]], taken: list[tuple[int, int]]) -> list[dict]:
    found, taken = [], list(taken)
    for kind, value, confidence in wanted:
        words = r"\s+".join(map(re.escape, value.split()))
        for m in re.finditer(rf"(?<!\w){words}(?!\w)", text, re.IGNORECASE) if words else ():
            if any(m.start() < b and a < m.end() for a, b in taken):
                continue
            taken.append(m.span())
            found.append(
                {"entity_type": kind, "start": m.start(), "end": m.end(), "text": m[0], "confidence": confidence, "recognizer": REPEAT, "normalized": None, "validated": False,
                 "strong_context": False, "signals": ["EXACT_REPEAT_OF_HIGH_CONFIDENCE_ENTITY"], "version": None, "ner_label": None}
            )
    return found
