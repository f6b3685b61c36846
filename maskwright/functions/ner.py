"""Providers of named-entity spans for the `ner` column. Detection works with any, or with none."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import NER


def gazetteer(text: Column, names: dict[str, list[str]]) -> Column:
    """Spans of listed names (label: names), whole words, case as given; of names that start together the longest."""
    by_name = {name: label for label, own in names.items() for name in own if name}
    longest_first = sorted(by_name, key=lambda n: (-len(n), n))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, longest_first)) + r")(?!\w)") if by_name else None

    @F.pandas_udf(NER)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"label": by_name[m[0]], "start": m.start(), "end": m.end()} for m in pattern.finditer(t)] if pattern and t else [] for t in texts], dtype=object)

    return spans(text)


def spacy_spans(text: Column, model: str) -> Column:
    """Spans of a local spaCy model, loaded once for each worker. spaCy isn't required otherwise."""

    @F.pandas_udf(NER)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import spacy

        pipeline = spacy.load(model)
        for texts in batches:
            found = pipeline.pipe(texts.fillna("").tolist(), batch_size=64)
            yield pd.Series([[{"label": e.label_, "start": e.start_char, "end": e.end_char} for e in d.ents] for d in found], dtype=object)

    return spans(text)


def with_ner(containers: DataFrame, spans: Column) -> DataFrame:
    """containers with their ner column filled."""
    return containers.withColumn("ner", spans)
