"""Labelled spans from a manifest and its annotations, checked before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import compressed_ip, digits_of
from ..functions.types import TYPES
from ..functions.values import normalized_value

MANIFEST = "schema_version string, document_sha256 string, extraction_version string, annotation_status string, containers array<struct<container_id:string,review_complete:boolean,sample_stratum:string>>"
ANNOTATION = "container_id string, entity_type string, start int, end int"


def load(spark: SparkSession, folder: str, document_sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(containers, annotations) of a folder's manifest.json and annotations.jsonl; every check must hold."""
    manifest = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/manifest.json")
    head = manifest.select("document_sha256", "annotation_status").first()
    if head is None or head["annotation_status"] != "complete":
        raise ValueError("the annotation isn't complete")
    if document_sha256 and head["document_sha256"] != document_sha256:
        raise ValueError("the labels are of another document")
    containers = manifest.select(F.explode("containers").alias("c")).select("c.*")
    annotations = spark.read.schema(ANNOTATION).json(f"{folder}/annotations.jsonl")
    checks = {
        "container without id or review": containers.where("container_id is null or trim(container_id) = '' or not coalesce(review_complete, false)"),
        "container listed twice": containers.groupBy("container_id").count().where("count > 1"),
        "unknown type or empty span": annotations.where(~F.coalesce(F.col("entity_type").isin([t for t, _, _ in TYPES]), F.lit(False)) | F.expr("not coalesce(start >= 0 and end > start, false)")),
        "annotation listed twice": annotations.groupBy(*annotations.columns).count().where("count > 1"),
        "annotation of no listed container": annotations.join(containers, "container_id", "left_anti"),
    }
    for what, rows in checks.items():
        if not rows.isEmpty():
            raise ValueError(what)
    return containers, annotations


def distribution(containers: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    return containers.groupBy("sample_stratum").agg(F.count("*").alias("n")), annotations.groupBy("entity_type").agg(F.count("*").alias("n"))


def plain_value(entity_type: str, text: str) -> str:
    """The normal form of one value, as the column function gives it."""
    text = text.strip()
    if entity_type in ("PHONE", "CREDIT_CARD", "SSN"):
        return digits_of(text)
    if entity_type == "IP_ADDRESS":
        return (compressed_ip(text) or (text.casefold(),))[0]
    return text.casefold() if entity_type == "EMAIL" else " ".join(text.casefold().split())


def distinct_values(planned: DataFrame) -> set[tuple[str, str]]:
    """Of one file's plan: the normal forms of its replacements."""
    rows = planned.select("entity_type", normalized_value(F.col("entity_type"), F.col("replacement")).alias("v")).distinct().collect()
    return {(r["entity_type"], r["v"]) for r in rows}
