"""The replacement plan: detect, propagate, link, replace, check; and what follows from it."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors
from ..functions.values import normalized_value
from .detect import detect, invalid_spans
from .link import link
from .propagate import propagate, with_value
from .pseudonymize import digest, replacements, settled
from .rewrite import affected_runs, changed_runs, invalid_replacements, rewritten_runs, rewritten_text, unsafe
from .store import stored

OVERLAPPING, INCONSISTENT, UNSAFE = "OVERLAPPING_DETECTIONS", "INCONSISTENT_REPEATED_ENTITY", "UNSAFE_DOCX_REWRITE"
BY_CONTAINER = ["doc_id", "container_id"]


class Plan(NamedTuple):
    replacements: DataFrame
    conflicts: DataFrame
    entities: DataFrame


def overlap_conflicts(entities: DataFrame) -> DataFrame:
    """doc_id, container_id, reason, entity_types, spans of neighbours that overlap."""
    before = Window.partitionBy(*BY_CONTAINER).orderBy("start", "end", "entity_type")
    seen = entities.withColumn("__end", F.lag("end").over(before)).withColumn("__start", F.lag("start").over(before)).withColumn("__type", F.lag("entity_type").over(before))
    return seen.where("start < __end").select(
        *BY_CONTAINER, F.lit(OVERLAPPING).alias("reason"), F.array("__type", "entity_type").alias("entity_types"),
        F.array(F.struct(F.col("__start").alias("start"), F.col("__end").alias("end")), F.struct("start", "end")).alias("spans"),
    )


def with_odd(named: DataFrame) -> DataFrame:
    """named with odd: whether a value's replacement differs from that at its first place in the document."""
    first = F.first_value("replacement").over(Window.partitionBy("doc_id", "entity_type", "value").orderBy("seq", "start", "end"))
    return named.withColumn("odd", ~F.col("replacement").eqNullSafe(first))


def plan_from_entities(containers: DataFrame, entities: DataFrame, secret: bytes) -> Plan:
    """The plan for entities that are linked already (identity_key and link_scope)."""
    overlapping = stored(overlap_conflicts(entities), "overlaps")
    clear = entities.join(overlapping.select(*BY_CONTAINER).distinct(), BY_CONTAINER, "left_anti")
    keyed = settled(with_value(clear), "digest", digest(secret))
    originals = with_value(entities).select("doc_id", "entity_type", "value")
    named = keyed.join(replacements(clear, secret, originals), ["doc_id", "entity_type", "digest"], "left")
    named = stored(with_odd(named).withColumnRenamed("odd", "__odd"), "named")
    inconsistent = named.where("__odd").select(*BY_CONTAINER, F.lit(INCONSISTENT).alias("reason"), F.array("entity_type").alias("entity_types"), F.array(F.struct("start", "end")).alias("spans"))
    consistent = named.join(inconsistent.select(*BY_CONTAINER).distinct(), BY_CONTAINER, "left_anti").drop("__odd")

    runs = containers.select(*BY_CONTAINER, "run_texts", "mirrors", "rewrite_safe", "unsafe_runs")
    own = F.sort_array(F.collect_list(F.struct("start", "end", "replacement", "entity_type")))
    grouped = consistent.groupBy(*BY_CONTAINER).agg(own.alias("__own")).join(runs, BY_CONTAINER)
    changed = changed_runs(F.col("run_texts"), rewritten_runs(F.col("run_texts"), F.col("__own")))
    grouped = stored(grouped, "grouped")
    risky = grouped.where(unsafe(F.col("rewrite_safe"), F.col("unsafe_runs"), changed))
    risky = risky.select(*BY_CONTAINER, F.lit(UNSAFE).alias("reason"), F.transform("__own", lambda r: r["entity_type"]).alias("entity_types"), F.transform("__own", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))
    planned = consistent.join(risky.select(*BY_CONTAINER), BY_CONTAINER, "left_anti").join(runs.select(*BY_CONTAINER, "run_texts", F.size("mirrors").alias("mirror_count")), BY_CONTAINER)
    planned = planned.withColumn("affected_run_count", affected_runs(F.col("run_texts"), F.col("start"), F.col("end"))).drop("run_texts", "digest")
    planned = stored(planned, "plan")
    return Plan(planned, overlapping.unionByName(inconsistent).unionByName(risky), entities)


def build_plan(containers: DataFrame, secret: bytes, names: tuple[str, ...] = detectors.NAMES, today: dt.date | None = None, linking: bool = True) -> Plan:
    """All steps, document by document: what holds for one document never depends on another."""
    entities = stored(propagate(containers, stored(detect(containers, names, today), "detected")), "entities")
    linked = stored(link(entities, secret), "linked") if linking else entities.withColumn("identity_key", F.lit(None).cast("string")).withColumn("link_scope", F.lit(None).cast("string"))
    return plan_from_entities(containers, linked, secret)


def applied(containers: DataFrame, plan: Plan) -> DataFrame:
    """containers with texts, runs and mirrors rewritten. Refuses a plan with conflicts, or one made for other texts, before anything is written."""
    if not plan.conflicts.isEmpty():
        raise ValueError("the plan has conflicts; nothing is rewritten")
    if not invalid_spans(containers, plan.replacements).isEmpty():
        raise ValueError("the plan is stale: a text is not what was planned for; nothing is rewritten")
    own = plan.replacements.groupBy(*BY_CONTAINER).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("__own"))
    if not containers.join(own, BY_CONTAINER).where(invalid_replacements(F.col("text"), F.col("__own"))).isEmpty():
        raise ValueError("replacements overlap or leave their text; nothing is rewritten")
    return rewritten(containers, plan.replacements)


def rewritten(containers: DataFrame, planned: DataFrame) -> DataFrame:
    own = planned.groupBy(*BY_CONTAINER).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("__own"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    joined = containers.join(own, BY_CONTAINER, "left").withColumn("__own", F.coalesce("__own", none))
    return (
        joined.withColumn("text", rewritten_text(F.col("text"), F.col("__own")))
        .withColumn("run_texts", rewritten_runs(F.col("run_texts"), F.col("__own")))
        .withColumn("mirrors", F.transform("mirrors", lambda m: rewritten_runs(m, F.col("__own"))))
        .select(*containers.columns)
    )


def synthetic_spans(planned: DataFrame) -> DataFrame:
    """doc_id, container_id, start, end of each replacement in the rewritten text."""
    before = Window.partitionBy(*BY_CONTAINER).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(before), F.lit(0)).cast("int")
    return planned.select(*BY_CONTAINER, (F.col("start") + moved).alias("start"), F.length("replacement").alias("size")).select(*BY_CONTAINER, "start", (F.col("start") + F.col("size")).alias("end"))


def residuals(found: DataFrame, planned: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Detections in the rewritten containers with their class: a known fake, within a fake, overlapping one, or none of these."""
    sure = found.where(F.col("confidence") >= minimum).withColumn("value", normalized_value(F.col("entity_type"), F.col("text"), F.col("normalized")))
    keys = planned.select("doc_id", "entity_type", normalized_value(F.col("entity_type"), F.col("replacement")).alias("value")).distinct().withColumn("__known", F.lit(True))
    spans = synthetic_spans(planned).groupBy(*BY_CONTAINER).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    marked = sure.join(keys, ["doc_id", "entity_type", "value"], "left").join(spans, BY_CONTAINER, "left")
    inside = F.exists("__spans", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]))
    across = F.exists("__spans", lambda s: (F.col("start") < s["end"]) & (s["start"] < F.col("end")))
    kind = F.when(F.col("__known"), "EXACT_KNOWN_SYNTHETIC").when(inside, "CONTAINED_IN_SYNTHETIC_REPLACEMENT").when(across, "BROAD_OVERLAP_REVIEW").otherwise("UNCLASSIFIED")
    return marked.withColumn("classification", kind).drop("__known", "__spans")


def plain_residuals(found: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Sure detections in texts for which no plan is at hand: none can be told from a leak."""
    return found.where(F.col("confidence") >= minimum).withColumn("classification", F.lit("UNCLASSIFIED"))
