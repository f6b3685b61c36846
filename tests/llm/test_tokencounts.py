import random

import numpy as np
import pytest

from maskwright.llm import bpe, tokencounts


@pytest.mark.parametrize(("block", "chunk"), [(1, 2), (3, 2), (7, 1024), (50, 1)])
def test_lengths_of_streams_cut_anywhere(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(tokencounts, "CHUNK", chunk)
    rnd = random.Random(block)
    rows, want = [], {}
    for file in "abcd":
        docs = [rnd.choice([0, 0, 1, 2, 5, 20]) for _ in range(rnd.randint(0, 12))]
        flat = [t for n in docs for t in [*(rnd.randrange(9) for _ in range(n)), 99]]
        want |= {(file, k): (n, True) for k, n in enumerate(docs)}
        if file == "c":
            flat += [1, 2, 3]
            want[file, len(docs)] = (3, False)
        rows += [(file, k, bytearray(np.array(flat[at : at + block], "<u2").tobytes())) for k, at in enumerate(range(0, len(flat), block))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, seq bigint, payload binary")
    got = {(r[0], r[1]): (r[2], r[3]) for r in tokencounts.document_lengths(df, separator=99).collect()}
    assert got == want


def test_round_trip_of_documents(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", "<|endoftext|>", *(" ".join(rnd.choice(["the", "naïve", "12", "\n"]) for _ in range(rnd.randint(0, 80))) for _ in range(60))]
    rows = [(k * 3, t, "x") for k, t in enumerate(texts)]
    stored = tokencounts.streams(spark.createDataFrame(rows, "doc_id bigint, text string, file string").repartition(3), block=64)
    stored.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    counts = {(r[0], r[1]): r[2] for r in tokencounts.document_lengths(stored.where("payload is not null")).collect()}
    got = {d: counts[r["file"], r["seq"] * tokencounts.IDS + k] for r in stored.where("ids is not null").collect() for k, d in enumerate(r["ids"])}
    assert got == {i: len(bpe.codec().encode(t or "")) for i, t, _ in rows}


def test_flat_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([5, 6, 99, 99, 7], "<u2").tobytes())
    (tmp_path / "y.bin").write_bytes(b"")
    blocks = tokencounts.blocks_of(spark, str(tmp_path), block=2)
    got = sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in tokencounts.document_lengths(blocks, separator=99).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 1, False)]
