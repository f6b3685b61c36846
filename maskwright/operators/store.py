"""Intermediate tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the folder that the session names in spark.checkpoint.dir, and read from there.

    Detection runs once, however many steps use its result, and neither plans nor
    recomputation after lost executors grow with the number of steps. Only a session
    that names no folder (as in tests) gets a local one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/maskwright/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
