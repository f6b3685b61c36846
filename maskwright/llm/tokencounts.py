"""Documents' token counts from flat token streams that have no index.

A stream is a sequence of token identifiers in which one separator ends each document;
it is cut into blocks of fixed size with no regard to documents. Each block is searched
at once; what begins in one block and ends in another is put together by a prefix scan
over the blocks' sums, first over chunks of blocks and then within each chunk, so that
no task needs all blocks of a long stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Two-byte little-endian identifiers; 50256 is free in the vocabulary of 50k ranks.
WIDTH, SEPARATOR = "<u2", 50_256
#: Tokens in a block.
BLOCK = 1 << 19
#: Blocks that the second scan takes together; document ids in a row of the order.
CHUNK, IDS = 1024, 4096


def streams(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Token streams of docs, one for each input partition: file, seq, payload (a block) or ids (which documents, in order; not where)."""
    kind = docs.schema["doc_id"].dataType
    arrow = pa.schema([("file", pa.int32()), ("seq", pa.int64()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, codec = TaskContext.get().partitionId(), bpe.codec()
        held, size, seq, ids, listed = [], 0, 0, [], 0
        for batch in common.slices(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append(np.array([*codec.encode(text or ""), SEPARATOR], WIDTH))
                size += len(held[-1])
                ids.append(doc_id)
                if size >= block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block
                    for k in range(whole):
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((file, seq + k, flat[k * block : (k + 1) * block].tobytes(), None), arrow, strict=True)], schema=arrow)
                    held, size, seq = [flat[whole * block :]], len(flat) - whole * block, seq + whole
                while len(ids) >= IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((file, listed, None, ids[:IDS]), arrow, strict=True)], schema=arrow)
                    ids, listed = ids[IDS:], listed + 1
        for at, payload, own in ((seq, np.concatenate(held).tobytes() if held else b"", None), (listed, None, ids)):
            if payload or own:
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((file, at, payload, own), arrow, strict=True)], schema=arrow)

    if kind.simpleString() not in ("bigint", "int"):
        raise ValueError("doc_id must be an integer")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "file int, seq bigint, payload binary, ids array<bigint>")


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """file, seq, payload of flat binary files of tokens, read whole by Spark's binary reader and cut."""
    step = block * np.dtype(WIDTH).itemsize
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("length") - 1) / step).cast("bigint")))
    return files.select(F.col("path").alias("file"), starts.alias("seq"), "content").select("file", "seq", F.expr(f"substring(content, cast(seq * {step} + 1 as int), {step})").alias("payload"))


def document_lengths(blocks: DataFrame, separator: int = SEPARATOR, width: str = WIDTH) -> DataFrame:
    """file, ordinal (from 0), n_tokens, ended of each document in the streams; separators don't count.

    blocks: file, seq, payload (nulls and empty ones hold nothing). Tokens after a
    stream's last separator are a document that has not ended. An empty document has 0
    tokens. Other columns are not read.
    """
    inner = [("n", pa.int64()), ("separators", pa.int64()), ("first", pa.int64()), ("tail", pa.int64()), ("lengths", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column("payload").to_pylist():
                tokens = np.frombuffer(payload or b"", width)
                at = np.flatnonzero(tokens == separator)
                rows.append((len(tokens), len(at), int(at[0]) if len(at) else len(tokens), len(tokens) - int(at[-1]) - 1 if len(at) else len(tokens), np.diff(at) - 1))
            columns = list(zip(*rows, strict=True)) or [[]] * len(inner)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("seq"), *(pa.array(c, t) for c, (_, t) in zip(columns, inner, strict=True))], ["file", "seq", *(n for n, _ in inner)])

    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "seq", "payload").mapInArrow(run, f"file {kind}, seq bigint, n bigint, separators bigint, first bigint, tail bigint, lengths array<bigint>")
    found = found.withColumn("chunk", F.expr(f"seq div {CHUNK}"))

    def scanned(df: DataFrame, within: list[str], order: str) -> DataFrame:
        """Before each row: tokens, separators, and tokens up to the last separator."""
        past = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("tokens_before", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("ended_before", F.coalesce(F.sum("separators").over(past), F.lit(0)))
        end = F.when(F.col("separators") > 0, F.col("tokens_before") + F.col("n") - F.col("tail"))
        return df.withColumn("last_end", end).withColumn("reached", F.max("last_end").over(past))

    inside = scanned(found, ["file", "chunk"], "seq")
    sums = found.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("separators").alias("separators"))
    tails = inside.groupBy("file", "chunk").agg(F.max("last_end").alias("end"))
    chunks = sums.join(tails, ["file", "chunk"]).withColumn("tail", F.col("n") - F.coalesce("end", F.lit(0)))
    outer = scanned(chunks, ["file"], "chunk").select("file", "chunk", F.col("tokens_before").alias("chunk_tokens"), F.col("ended_before").alias("chunk_ended"), F.col("reached").alias("chunk_reached"))
    placed = inside.join(outer, ["file", "chunk"])
    carry = F.col("chunk_tokens") + F.col("tokens_before") - F.coalesce(F.col("chunk_tokens") + F.col("reached"), F.col("chunk_reached"), F.lit(0))
    placed = placed.withColumn("carry", carry).withColumn("base", F.col("chunk_ended") + F.col("ended_before"))
    ended = placed.where("separators > 0").select("file", "base", F.posexplode(F.concat(F.array(F.col("carry") + F.col("first")), "lengths")).alias("place", "n_tokens"))
    ended = ended.select("file", (F.col("base") + F.col("place")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    last = placed.groupBy("file").agg(F.max(F.struct("seq", (F.col("base") + F.col("separators")).alias("ordinal"), F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n")).alias("n_tokens"))).alias("z"))
    return ended.unionByName(last.where("z.n_tokens > 0").select("file", "z.ordinal", "z.n_tokens", F.lit(False).alias("ended")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of all documents: written as streams, then counted by their separators alone."""
    stored = common.written(streams(common.table(spark, sf_dir, "documents", "doc_id", "text")), "streams")
    counts = document_lengths(stored.where("payload is not null").select("file", "seq", "payload"))
    order = stored.where("ids is not null").select("file", "seq", F.posexplode("ids").alias("place", "doc_id")).select("file", (F.col("seq") * IDS + F.col("place")).alias("ordinal"), "doc_id")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
