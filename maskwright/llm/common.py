"""Reading tables, cutting lineage in the shared folder, and small Arrow helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees. Only where the session names none (as in tests), a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: later jobs reread it instead of recomputing, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/maskwright/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame, sweep: bool = True) -> None:
    """Deletes tables of written(); call it once no later job reads them. Unless told otherwise, it sweeps too."""
    for table in tables:
        jvm = table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if tables and sweep:
        swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Lets go of ended jobs' shuffle files: Spark deletes them once the driver's JVM has found their plans unused.

    Twice: after one pass they all still stood; what holds a plan is itself let go in the first.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about most_bytes of a string column (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size + 1
        if start < batch.num_rows:
            yield batch.slice(start)
