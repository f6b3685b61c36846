"""From raw documents to token identifiers in five stages, each one an operator of maskwright.llm.

Each stage works on all that its predecessor kept, and its decisions take effect:
documents without a language go, lines that match an earlier one go and with them the
documents of which no word is left, one document of each group of near copies stays,
documents that hold a benchmark item go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, common, decontaminate, langid, lines, minhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null, empty and letterless texts go."""
    return langid.keep_identified(docs, langid.train(docs.select("doc_id", "text", "lang")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, their texts without the lines that match an earlier one; n_chars follows the text. Rows without a word left go."""
    out = lines.without_repeated_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id."""
    return minhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item within its edit budget."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("byte_bpe", encode),
]

#: Trained scores, shared permutations and subword merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
