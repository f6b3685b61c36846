"""Plans over containers: repeats, links, conflicts, retries, leaks, scoring."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from maskwright.functions.types import CONTAINERS
from maskwright.operators import plan, pseudonymize, report, score

KEY, TODAY = b"0123456789abcdef", dt.date(2026, 1, 1)


def containers(spark, rows):
    full = [(doc, cid, k, "BODY_PARAGRAPH", "".join(runs), runs, [runs] if mirrored else [], safe, unsafe, []) for k, (doc, cid, runs, mirrored, safe, unsafe) in enumerate(rows)]
    return spark.createDataFrame(full, CONTAINERS)


def row(doc, cid, *runs, mirrored=False, safe=True, unsafe=()):
    return doc, cid, list(runs), mirrored, safe, list(unsafe)


def test_a_plan_from_end_to_end(spark):
    c = containers(
        spark,
        [
            row("d", "body/t0000/r0000/c0000/p0000", "Contact Person: Ma", "ya Stone", mirrored=True),
            row("d", "body/t0000/r0000/c0001/p0000", "maya.stone@corp.example.org"),
            row("d", "body/p0001", "CEO: Bob Lee. Later Bob Lee and BOB  LEE spoke"),
            row("d", "body/p0002", "Bob Lee stays here"),
            row("e", "body/p0000", "CEO: Bob Lee, SSN 123-45-6789"),
            row("e", "body/p0001", ""),
        ],
    )
    made = plan.build_plan(c, KEY, today=TODAY)
    summary = report.plan_summary(made)
    assert summary["conflict_count"] == 0 and summary["linked_identity_count"] == 1 and summary["linked_entity_count"] == 2
    assert summary["exact_repeat_propagation_count"] == 2 and summary["cross_run_replacement_count"] == 1 and summary["mirrored_representation_update_count"] == 1
    rows = made.replacements.collect()
    names = {(r["doc_id"], r["text"].upper().split()[0]): r["replacement"] for r in rows if r["entity_type"] == "PERSON"}
    assert len({r["replacement"] for r in rows if r["doc_id"] == "d" and r["text"].upper().startswith("BOB")}) == 1
    first, last = names["d", "MAYA"].split(" ")[0], names["d", "MAYA"].split(" ")[-1]
    assert [r["replacement"] for r in rows if r["entity_type"] == "EMAIL"] == [f"{first}.{last}@example.com".lower()]
    assert all(pseudonymize.revalidate(r["entity_type"], r["replacement"]) for r in rows)
    new = {(r["doc_id"], r["container_id"]): r for r in plan.applied(c, made).collect()}
    top = new["d", "body/t0000/r0000/c0000/p0000"]
    assert top["run_texts"] == [f"Contact Person: {names['d', 'MAYA']}", ""] and top["mirrors"] == [top["run_texts"]]
    assert new["d", "body/p0002"]["text"] == "Bob Lee stays here"
    again = plan.detect(plan.applied(c, made), today=TODAY)
    assert report.leak_summary(plan.residuals(again, made.replacements))["review_required_count"] == 0
    assert {(r["doc_id"], r["text"], r["replacement"]) for r in plan.build_plan(c.repartition(7), KEY, today=TODAY).replacements.collect()} == {(r["doc_id"], r["text"], r["replacement"]) for r in rows}


def test_conflicts_stop_the_rewrite(spark):
    c = containers(spark, [row("d", "body/p0000", "SSN 123-45-6789", safe=False), row("d", "body/p0001", "ip ", "10.0.0.1", unsafe=[1]), row("d", "body/p0002", "ip ", "10.0.0.2", unsafe=[0])])
    made = plan.build_plan(c, KEY, today=TODAY)
    assert sorted((r["container_id"], r["reason"]) for r in made.conflicts.collect()) == [("body/p0000", plan.UNSAFE), ("body/p0001", plan.UNSAFE)]
    with pytest.raises(ValueError):
        plan.applied(c, made)


def test_fakes_avoid_originals_of_the_document(spark):
    c = containers(spark, [row("d", "body/p0000", "SSN 123-45-6789")])
    made = plan.build_plan(c, KEY, today=TODAY)
    entities, fake = made.entities, made.replacements.first()["replacement"]
    plain = fake.replace("-", "")
    other = pseudonymize.replacements(entities, KEY, spark.createDataFrame([("d", "SSN", plain), ("x", "SSN", "1")], "doc_id string, entity_type string, value string")).first()["replacement"]
    assert other and other != fake
    with pytest.raises(ValueError):
        pseudonymize.replacements(entities, b"short")


def test_scores(spark):
    schema = "container_id string, entity_type string, start int, end int"
    truth = spark.createDataFrame([("a", "EMAIL", 0, 5), ("a", "ADDRESS", 10, 30), ("b", "ADDRESS", 0, 10)], schema)
    made = spark.createDataFrame([("a", "EMAIL", 0, 5), ("a", "EMAIL", 0, 5), ("a", "ADDRESS", 10, 26), ("a", "ADDRESS", 12, 30), ("b", "PHONE", 0, 10)], schema)
    got = score.evaluation_report(made, truth)
    assert [got["exact"]["micro"][k] for k in ("tp", "fp", "fn")] == [1, 3, 2]
    assert got["exact"]["macro_ground_truth_types"]["included_types"] == 2 and got["exact"]["by_type"]["DOB"]["accuracy"] is None
    assert [got["address_relaxed"][k] for k in ("tp", "fp", "fn")] == [1, 1, 1]
    match = score.relaxed_matches(made, truth).first()
    assert tuple(match["p"]) == (12, 30)
    with pytest.raises(ValueError):
        score.evaluation_report(made, truth.limit(0))
    assert made.where(F.col("start") > 99).count() == 0


def test_a_stale_plan_and_overlapping_replacements_stop_the_rewrite(spark):
    c = containers(spark, [row("d", "body/p0000", "SSN 123-45-6789"), row("d", "body/p0001", "ip 10.0.0.1")])
    made = plan.build_plan(c, KEY, today=TODAY)
    assert plan.applied(c, made).count() == 2
    with pytest.raises(ValueError, match="stale"):
        plan.applied(c.withColumn("text", F.concat(F.lit("x"), "text")), made)
    twice = made._replace(replacements=made.replacements.union(made.replacements))
    with pytest.raises(ValueError, match="overlap"):
        plan.applied(c, twice)
