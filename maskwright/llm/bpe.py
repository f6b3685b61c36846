"""Byte-level BPE encoding and decoding as a monoid reduced over a tree.

A text is halved until the pieces are short, each piece is encoded alone, and
neighbours are joined on the way up. A join re-encodes a window around the seam and
widens it until the tokens outside provably keep: a window may only end where white
space (a space or a line feed) follows a character that is not white space. No
alternative of the split pattern goes on across such a place and none looks back over
it, so the tokens left and right of it are those of the two sides encoded alone.
Every inner node therefore equals the encoding of its own text. Decoding
concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Characters that are encoded at once.
LEAF = 2048
#: Characters on either side of a seam that a join first looks at.
WINDOW = 32
RANKS = "byte_bpe_50k.tiktoken"

_SAFE = re.compile(r"[^\s](?=[ \n])")


class Codec:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.names = [str(i) for i in range(len(self.tokens))]

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        if len(text) <= leaf:
            return self._encoding.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf, window), right, self.encode(right, leaf, window), window)

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int], window: int = WINDOW) -> list[int]:
        """The encoding of left + right from those of both. left_ids is used up."""
        start = self._cut_before(left, window)
        end = self._cut_after(right, window)
        seam = self._encoding.encode_ordinary(left[start:] + right[:end])
        again = len(left[start:].encode())
        while again > 0:
            again -= self.lengths[left_ids.pop()]
        skipped, again = 0, len(right[:end].encode())
        while again > 0:
            again -= self.lengths[right_ids[skipped]]
            skipped += 1
        left_ids += seam
        left_ids += right_ids[skipped:]
        return left_ids

    @staticmethod
    def _cut_before(text: str, window: int) -> int:
        while window < len(text):
            cuts = [m.end() for m in _SAFE.finditer(text, len(text) - window)]
            if cuts:
                return cuts[-1]
            window *= 2
        cuts = [m.end() for m in _SAFE.finditer(text)]
        return cuts[-1] if cuts else 0

    @staticmethod
    def _cut_after(text: str, window: int) -> int:
        found = _SAFE.search(text)
        return found.end() if found else len(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """One per Python worker. path: a rank file; by default the public one of 50k ranks."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for), ids_sha256 and decoded_sha256 of every whole text.

    A null text counts as empty: no tokens, and the digests of nothing. Rows are kept
    as they are, repeated ones too; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = own.names
        for batch in common.slices(batches, "text", 4 << 20):
            counts, hashes, decoded, lists = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = own.encode(text or "")
                counts.append(len(found))
                hashes.append(hashlib.sha256(" ".join([names[i] for i in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    lists.append(found)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []),
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"), ids=False)
