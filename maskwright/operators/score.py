"""Scoring of detections against labelled spans: exact, relaxed, by type, micro and macro."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import type_dimension
from ..functions.values import overlap_ratio

KEYS = ["container_id", "entity_type", "start", "end"]


def outcomes(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """The distinct spans of both, each tp, fp or fn."""
    p = predictions.select(*KEYS).distinct().withColumn("__p", F.lit(True))
    t = truth.select(*KEYS).distinct().withColumn("__t", F.lit(True))
    both = p.join(t, KEYS, "full_outer")
    return both.select(*KEYS, F.when(F.col("__p") & F.col("__t"), "tp").when(F.col("__p"), "fp").otherwise("fn").alias("outcome"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == kind).alias(kind) for kind in ("tp", "fp", "fn")]


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 (0 where undefined) and accuracy (null where undefined) from tp, fp and fn."""
    ratio = lambda a, b: F.try_divide(F.col(a), b)
    zero = F.lit(0.0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(
        "*", F.coalesce(ratio("tp", tp + fp), zero).alias("precision"), F.coalesce(ratio("tp", tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"), ratio("tp", tp + fp + fn).alias("accuracy"),
    )


def exact_by_type(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn and ratios of every type, in report order (ord)."""
    counts = outcomes(predictions, truth).groupBy("entity_type").agg(*_counts())
    every = type_dimension(predictions.sparkSession).select("entity_type", "ord").join(counts, "entity_type", "left").na.fill(0, ["tp", "fp", "fn"])
    return with_ratios(every)


def micro(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return with_ratios(outcomes(predictions, truth).agg(*_counts()))


def macro(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Means over the types that the truth holds; no row if it holds none."""
    present = exact_by_type(predictions, truth).join(truth.select("entity_type").distinct(), "entity_type", "left_semi")
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    return present.agg(F.count("*").alias("included_types"), *means).where("included_types > 0")


def errors_by_type(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """kind (fp or fn), entity_type, n: those that occur."""
    wrong = outcomes(predictions, truth).where("outcome <> 'tp'")
    return wrong.groupBy(F.col("outcome").alias("kind"), "entity_type").agg(F.count("*").alias("n"))


def relaxed_matches(predictions: DataFrame, truth: DataFrame, entity_type: str = "ADDRESS", minimum: float = 0.5) -> DataFrame:
    """One-to-one pairs within a container whose overlap covers the minimum of the shorter span.

    Greedy: largest overlap first, then smallest error at the ends, then by places
    (prediction, then truth).
    """
    if not 0 < minimum <= 1:
        raise ValueError("the minimum overlap must be above 0 and at most 1")
    one = lambda df, name: df.where(F.col("entity_type") == entity_type).select("container_id", F.struct("start", "end").alias(name)).distinct()
    pairs = one(predictions, "p").join(one(truth, "t"), "container_id")
    share = overlap_ratio(F.col("p.start"), F.col("p.end"), F.col("t.start"), F.col("t.end"))
    error = F.abs(F.col("p.start") - F.col("t.start")) + F.abs(F.col("p.end") - F.col("t.end"))
    ranked = F.sort_array(F.collect_list(F.struct((-share).alias("share"), error.alias("error"), "p", "t")))
    own = pairs.where(share >= minimum).groupBy("container_id").agg(ranked.alias("ranked"))
    none = F.array().cast("array<struct<share:double,error:int,p:struct<start:int,end:int>,t:struct<start:int,end:int>>>")
    taken = lambda kept, c: F.exists(kept, lambda k: (k["p"] == c["p"]) | (k["t"] == c["t"]))
    chosen = F.aggregate("ranked", none, lambda kept, c: F.when(taken(kept, c), kept).otherwise(F.array_append(kept, c)))
    return own.select("container_id", F.explode(chosen).alias("m")).select("container_id", "m.p", "m.t")


def relaxed(predictions: DataFrame, truth: DataFrame, entity_type: str = "ADDRESS", minimum: float = 0.5) -> DataFrame:
    matched = relaxed_matches(predictions, truth, entity_type, minimum).agg(F.count("*").alias("tp"))
    size = lambda df, name: df.where(F.col("entity_type") == entity_type).select(*KEYS).distinct().agg(F.count("*").alias(name))
    # Three single rows side by side.
    both = matched.withColumn("__k", F.lit(1)).join(size(predictions, "p").withColumn("__k", F.lit(1)), "__k").join(size(truth, "t").withColumn("__k", F.lit(1)), "__k")
    return with_ratios(both.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn")))


def evaluation_report(predictions: DataFrame, truth: DataFrame, minimum: float = 0.5) -> dict:
    """All metrics as a plain dictionary; refuses an empty truth."""
    row = lambda df: (lambda r: r.asDict() if r else None)(df.first())
    means = row(macro(predictions, truth))
    if means is None:
        raise ValueError("macro metrics need at least one labelled entity")
    by_type = {r["entity_type"]: {k: v for k, v in r.asDict().items() if k not in ("entity_type", "ord")} for r in exact_by_type(predictions, truth).orderBy("ord").collect()}
    return {"exact": {"micro": row(micro(predictions, truth)), "macro_ground_truth_types": means, "by_type": by_type}, "address_relaxed": row(relaxed(predictions, truth, minimum=minimum)), "address_relaxed_minimum_overlap": minimum}
