"""Entity types, their ranks, and the schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity types in report order, with their priority in conflicts and whether a validated one is structured evidence.
TYPES = (
    ("PERSON", 40, False),
    ("EMAIL", 80, True),
    ("PHONE", 70, True),
    ("COMPANY", 30, False),
    ("ADDRESS", 50, False),
    ("SSN", 90, True),
    ("CREDIT_CARD", 90, True),
    ("DOB", 60, False),
    ("IP_ADDRESS", 80, True),
)

#: Kinds of stories in report order.
STORIES = ("BODY_PARAGRAPH", "TABLE_CELL_PARAGRAPH", "HEADER_PARAGRAPH", "FOOTER_PARAGRAPH", "TEXT_BOX_PARAGRAPH")

NER = "array<struct<label:string,start:int,end:int>>"

CANDIDATE = (
    "struct<entity_type:string,start:int,end:int,text:string,confidence:double,recognizer:string,normalized:string,"
    "validated:boolean,strong_context:boolean,signals:array<string>,version:int,ner_label:string>"
)
CANDIDATES = f"array<{CANDIDATE}>"

CONTAINERS = (
    "doc_id string, container_id string, seq int, story_type string, text string, run_texts array<string>, "
    f"mirrors array<array<string>>, rewrite_safe boolean, unsafe_runs array<int>, ner {NER}"
)


def type_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k, p, s) for k, (t, p, s) in enumerate(TYPES)], "entity_type string, ord int, priority int, is_structured boolean")


def story_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, s in enumerate(STORIES)], "story_type string, ord int")


def priority(entity_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for t, p, _ in TYPES for x in (t, p)]), entity_type)


def is_structured(entity_type: Column) -> Column:
    return entity_type.isin([t for t, _, s in TYPES if s])


def containers_of(df: DataFrame, doc_id: Column, text: Column, container_id: Column | None = None, ner: Column | None = None) -> DataFrame:
    """Any table of texts as containers of one run each. A null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    return df.select(
        doc_id.cast("string").alias("doc_id"),
        (container_id if container_id is not None else F.lit("body/p0000")).alias("container_id"),
        F.lit(0).alias("seq"),
        F.lit(STORIES[0]).alias("story_type"),
        whole.alias("text"),
        F.array(whole).alias("run_texts"),
        F.array().cast("array<array<string>>").alias("mirrors"),
        F.lit(True).alias("rewrite_safe"),
        F.array().cast("array<int>").alias("unsafe_runs"),
        (ner if ner is not None else F.array().cast(NER)).alias("ner"),
    )
