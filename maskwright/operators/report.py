"""Reports that hold counts and no values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import story_dimension, type_dimension
from ..functions.values import masked, shown_signals
from .plan import Plan
from .propagate import REPEAT, with_value
from .rewrite import affected_runs

REVIEW = ("BROAD_OVERLAP_REVIEW", "UNCLASSIFIED")


def containers_by_story(containers: DataFrame) -> DataFrame:
    counts = containers.groupBy("story_type").agg(F.count("*").alias("containers"))
    return story_dimension(containers.sparkSession).join(counts, "story_type", "left").na.fill(0, ["containers"])


def replacements_by_story(replacements: DataFrame) -> DataFrame:
    """story_type, replacements of the stories that have some."""
    counts = replacements.groupBy("story_type").agg(F.count("*").alias("replacements"))
    return story_dimension(replacements.sparkSession).join(counts, "story_type").orderBy("ord").select("story_type", "replacements")


def with_affected_runs(containers: DataFrame, entities: DataFrame) -> DataFrame:
    runs = containers.select("doc_id", "container_id", "run_texts")
    joined = entities.join(runs, ["doc_id", "container_id"])
    return joined.withColumn("affected_run_count", affected_runs(F.col("run_texts"), F.col("start"), F.col("end"))).drop("run_texts")


def detections_by_type(entities: DataFrame, digits: int = 4) -> DataFrame:
    """accepted, cross_run (where affected_run_count is known) and average_confidence of every type."""
    cross = F.count_if(F.col("affected_run_count") > 1) if "affected_run_count" in entities.columns else F.lit(0).cast("bigint")
    counts = entities.groupBy("entity_type").agg(F.count("*").alias("accepted"), cross.alias("cross_run"), F.round(F.avg("confidence"), digits).alias("average_confidence"))
    return type_dimension(entities.sparkSession).select("entity_type", "ord").join(counts, "entity_type", "left").na.fill(0, ["accepted", "cross_run"])


def top_types(entities: DataFrame, n: int = 5) -> DataFrame:
    return detections_by_type(entities).where("accepted > 0").orderBy(F.desc("accepted"), "ord").limit(n).select("entity_type", "accepted")


def with_repeats(entities: DataFrame) -> DataFrame:
    """occurrences of each value in its document, and whether it is repeated."""
    n = F.count("*").over(Window.partitionBy("doc_id", "entity_type", "value"))
    return with_value(entities).withColumn("occurrences", n).withColumn("repeated", n > 1)


def preview(entities: DataFrame, types: list[str] | None = None, rows: int = 100) -> DataFrame:
    """The first rows of a plan, values masked."""
    wanted = entities.where(F.col("entity_type").isin(types)) if types else entities
    shown = wanted.orderBy("doc_id", "seq", "start").limit(rows)
    return shown.select("doc_id", "container_id", "entity_type", masked(F.col("entity_type"), F.col("text")).alias("masked"), "confidence", shown_signals(F.col("signals")).alias("evidence"))


def safe(entities: DataFrame, with_text: bool = False) -> DataFrame:
    """Without values, unless asked for."""
    columns = ["doc_id", "container_id", "story_type", "entity_type", "start", "end", "confidence", "recognizer"]
    return entities.select(*columns, *(["text"] if with_text else []))


def plan_summary(plan: Plan) -> dict:
    """Counts of a plan and its conflicts, and the gate that they leave it."""
    by_type = {r["entity_type"]: r["accepted"] for r in detections_by_type(plan.replacements).orderBy("ord").collect()}
    sums = plan.replacements.agg(
        F.count("*").alias("planned_replacement_count"), F.count_if(F.col("recognizer") == REPEAT).alias("exact_repeat_propagation_count"),
        F.count_if(F.col("affected_run_count") > 1).alias("cross_run_replacement_count"), F.count_if(F.col("story_type") == "TEXT_BOX_PARAGRAPH").alias("text_box_replacement_count"),
        F.coalesce(F.sum("mirror_count"), F.lit(0)).alias("mirrored_representation_update_count"),
    ).first().asDict()
    linked = plan.entities.where("identity_key is not null").agg(F.count_distinct("doc_id", "identity_key").alias("i"), F.count("*").alias("e")).first()
    reasons = {r["reason"]: r["n"] for r in plan.conflicts.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()}
    return {
        **sums, "planned_replacements_by_type": by_type, "linked_identity_count": linked["i"], "linked_entity_count": linked["e"],
        "conflict_count": sum(reasons.values()), "conflicts_by_reason": reasons, "quality_gate": "BLOCKED_BY_STRUCTURAL_CONFLICTS" if reasons else "CONFLICT_FREE_PLAN",
    }


def leak_summary(residuals: DataFrame) -> dict:
    """Counts of residual detections by class and by type."""
    rows = residuals.groupBy("classification", "entity_type").agg(F.count("*").alias("n")).collect()
    by = lambda *kinds: sum(r["n"] for r in rows if r["classification"] in kinds)

    def types(*kinds: str) -> dict:
        names = sorted({r["entity_type"] for r in rows if not kinds or r["classification"] in kinds})
        return {t: sum(r["n"] for r in rows if r["entity_type"] == t and (not kinds or r["classification"] in kinds)) for t in names}

    exact, inside, broad, other = (by(k) for k in ("EXACT_KNOWN_SYNTHETIC", "CONTAINED_IN_SYNTHETIC_REPLACEMENT", *REVIEW))
    return {
        "high_confidence_detection_count": by(*{r["classification"] for r in rows}), "known_synthetic_detection_count": exact + inside, "exact_known_synthetic_detection_count": exact,
        "synthetic_contained_detection_count": inside, "broad_overlap_review_count": broad, "unclassified_residual_count": other, "review_required_count": broad + other,
        "detections_by_type": types(), "review_required_by_type": types(*REVIEW), "unclassified_by_type": types("UNCLASSIFIED"),
    }


def quality_gate(leaks: dict, unclassified_relationships: int = 0) -> str:
    return "WRITE_COMPLETED_WITH_RESIDUAL_REVIEW" if leaks["review_required_count"] or unclassified_relationships else "WRITE_COMPLETED_SUPPORTED_TEXT_SCAN_CLEAR"
