"""Scanning and redacting one Word file, with reports that hold no values."""

from __future__ import annotations

import datetime as dt
import os
import secrets

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import NAMES, scan
from ..functions.types import STORIES
from ..operators import detect, plan, report
from ..operators.propagate import with_value
from ..sources import docx
from .ground_truth import distinct_values

KEY_VARIABLE = "MASKWRIGHT_KEY"


def secret_from_environment(variable: str = KEY_VARIABLE, required: bool = False) -> tuple[bytes, str]:
    """The key and where it came from; a passing one for dry runs where the variable isn't set."""
    value = os.environ.get(variable)
    if value is None:
        if required:
            raise ValueError(f"{variable} is required to write a redacted file")
        return secrets.token_bytes(32), "ephemeral_dry_run"
    if len(value.encode()) < 16:
        raise ValueError(f"{variable} must have 16 bytes at least")
    return value.encode(), f"environment:{variable}"


def _opened(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        content = f.read()
    packages = spark.createDataFrame([(docx.file_sha256(path), bytearray(content))], "doc_id string, content binary")
    return content, packages, docx.text_containers(packages)


def scan_report(spark: SparkSession, path: str, names: tuple[str, ...] = NAMES, today: dt.date | None = None) -> dict:
    _, _, containers = _opened(spark, path)
    found = report.with_affected_runs(containers, detect.detect(containers, names, today))
    stories = {r["story_type"]: r["containers"] for r in report.containers_by_story(containers).collect()}
    types = {r["entity_type"]: {k: r[k] for k in ("accepted", "cross_run", "average_confidence")} for r in report.detections_by_type(found).orderBy("ord").collect()}
    return {
        "report_schema_version": "1.0", "source_name": os.path.basename(path), "source_sha256": docx.file_sha256(path), "privacy_safe": True, "container_count": sum(stories.values()),
        "containers_by_story": {s: stories[s] for s in STORIES}, "accepted_detection_count": sum(t["accepted"] for t in types.values()), "detections_by_type": types,
    }


def dry_run(spark: SparkSession, path: str, secret: bytes, names: tuple[str, ...] = NAMES, today: dt.date | None = None) -> dict:
    _, _, containers = _opened(spark, path)
    made = plan.build_plan(containers, secret, names, today)
    return {"dry_run": True, "document_mutated": False, "source_sha256": docx.file_sha256(path), **report.plan_summary(made)}


def relationship_targets(content: bytes, replaced: dict[tuple[str, str], str]) -> dict[str, str]:
    """New targets of mailto: and tel: links whose address or number is replaced."""
    from urllib.parse import unquote

    out = {}
    for target in docx.external_targets(content):
        scheme, _, rest = target.partition(":")
        if scheme.lower() == "mailto":
            address, mark, query = rest.partition("?")
            new = replaced.get(("EMAIL", unquote(address).strip().casefold()))
            found = new and f"mailto:{new}{mark}{query}"
        elif scheme.lower() == "tel":
            new = replaced.get(("PHONE", "".join(c for c in unquote(rest) if c.isdecimal())))
            found = new and "tel:" + ("+" if new.strip().startswith("+") else "") + "".join(c for c in new if c.isdecimal())
        else:
            found = None
        if found and found != target:
            out[target] = found
    return out


def redact(spark: SparkSession, path: str, output: str, secret: bytes, names: tuple[str, ...] = NAMES, today: dt.date | None = None) -> dict:
    """Plan, rewrite, save under another name and look again; any conflict stops before anything is written."""
    before = docx.file_sha256(path)
    content, packages, containers = _opened(spark, path)
    made = plan.build_plan(containers, secret, names, today)
    summary = report.plan_summary(made)
    if summary["conflict_count"]:
        raise docx.PackageError(f"nothing is written: {summary['conflicts_by_reason']}")
    changed = plan.rewritten(containers.join(made.replacements.select("doc_id", "container_id").distinct(), ["doc_id", "container_id"], "left_semi"), made.replacements)
    runs = {r["container_id"]: (list(r["run_texts"]), [list(m) for m in r["mirrors"]]) for r in changed.collect()}  # one file's
    last = with_value(made.replacements).where("entity_type in ('EMAIL', 'PHONE')").groupBy("entity_type", "value").agg(F.max_by("replacement", F.struct("seq", "start")).alias("new"))
    targets = relationship_targets(content, {(r["entity_type"], r["value"]): r["new"] for r in last.collect()})
    new = docx.rewritten(content, runs, targets)
    again = docx.text_containers(spark.createDataFrame([(before, bytearray(new))], "doc_id string, content binary"))
    leaks = report.leak_summary(plan.residuals(detect.detect(again, names, today), made.replacements))
    if docx.file_sha256(path) != before:
        raise docx.PackageError("the source changed meanwhile")
    docx.write_atomically(new, path, output)
    known = distinct_values(made.replacements)
    links = relationship_scan(new, known, today)
    return {
        **summary, "dry_run": False, "source_sha256": before, "output_sha256": docx.file_sha256(output), "applied_replacement_count": summary["planned_replacement_count"],
        "external_relationship_update_count": len(targets), "package_validation": docx.validated(new), "residual_supported_text_scan": leaks, "residual_external_relationship_scan": links,
        "unsupported_content": docx.unsupported_content(new), "shape_metadata_audit": shape_audit(new, today), "quality_gate": report.quality_gate(leaks, links["unclassified_residual_count"]),
    }


def relationship_scan(content: bytes, known: set[tuple[str, str]], today: dt.date | None = None, minimum: float = 0.85) -> dict:
    from urllib.parse import unquote

    from .ground_truth import plain_value

    targets = docx.external_targets(content)
    found = [c for t in targets for c in scan(unquote(t), [], today or dt.date.today()) if c.confidence >= minimum]
    unknown = [c for c in found if (c.entity_type, plain_value(c.entity_type, c.text)) not in known]
    return {"external_relationship_count": len(targets), "high_confidence_detection_count": len(found), "known_synthetic_detection_count": len(found) - len(unknown), "unclassified_residual_count": len(unknown)}


def shape_audit(content: bytes, today: dt.date | None = None) -> dict:
    rows = docx.shape_metadata(content)
    kinds = [a for _, a, _ in rows]
    found = [c.entity_type for _, _, v in rows for c in scan(v, [], today or dt.date.today())]
    return {
        "parts_with_shape_metadata": len({p for p, _, _ in rows}), "attributes_by_kind": {k: kinds.count(k) for k in sorted(set(kinds))},
        "unique_value_count": len({v for _, _, v in rows}), "potential_pii_by_type": {t: found.count(t) for t in sorted(set(found))},
    }
