import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright.llm import chat

LAYOUT_CASES = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]}, [("system", "s"), ("user", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"dialog": {"turns": [{"speaker": "x y", "text": "t"}]}}, [("x y", "t")]),
    ({"role": "assistant", "content": "é"}, [("assistant", "é")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "c", "prompt": 5}, [("user", "5"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"unknown": 1}, None),
    ({"prompt": "p", "completion": "c", "more": 1}, None),
    ({"messages": []}, None),
]


def test_layouts(spark):
    rows = [(k, json.dumps(record)) for k, (record, _) in enumerate(LAYOUT_CASES)] + [(97, None), (98, ""), (99, "{no json")]
    got = {r[0]: r[1] and [tuple(t) for t in r[1]] for r in spark.createDataFrame(rows, "k int, payload string").select("k", chat.canonical_turns(F.col("payload"))).collect()}
    assert got == {k: want for k, (_, want) in enumerate(LAYOUT_CASES)} | {97: None, 98: None, 99: None}


def test_round_trip_of_hostile_texts(spark):
    rnd = random.Random(3)
    pieces = [*chat.CONTROLS, chat.START, chat.END, "\\", "\n", "<", "|", "im_start|>", "user\n", "é😀", " ", "[/", "\\|", "\r", " ", ""]
    rows, want = [], {}
    for conv in range(60):
        turns = [(rnd.choice(["user", "assistant", "a b", "é\n<|", ""]), "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))) for _ in range(rnd.randint(1, 6))]
        want[conv] = turns
        rows += [(conv, k, json.dumps({"role": r, "content": t}), "x") for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    out = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, payload string, formatted string"))
    undo = lambda t: __import__("re").sub(r"(?s)\\(.)", r"\1", t)
    formatted = {r["conv_id"]: r["formatted"] for r in out.collect()}
    cut = chat.loss_mask(chat.pieces(out)).select("*", F.url_decode("head").alias("role"), chat.unescaped(F.col("body")).alias("text"))
    got = {}
    for r in cut.collect():
        got.setdefault(r["conv_id"], []).append((r["at"], r["role"], r["text"]))
        if r["role"] == "assistant":
            assert undo(formatted[r["conv_id"]][r["loss_start"] : r["loss_end"]]) == r["text"]
        else:
            assert r["loss_start"] is None
    assert {k: [t[1:] for t in sorted(v)] for k, v in got.items()} == want
    import hashlib

    for r in chat.digests(out).collect():
        loss = "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == len(formatted[r["conv_id"]])
        spans = [tuple(map(int, p.split(":"))) for p in r["loss_spans"].split(",") if p]
        assert "".join(undo(formatted[r["conv_id"]][a:b]) for a, b in spans) == loss


def test_texts_beyond_the_json_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "MOST_JSON", 50)
    rows = [(1, 0, "user", "short"), (1, 1, "assistant", "long text </s> " * 10), (2, 0, "user", "y" * 51)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 150), 2: (1, 0), -1: (2, 21)}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    import duckdb

    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    want = con.execute(chat.ORACLE).fetchall()
    got = [tuple(r) for r in chat.op2_chat_formatting(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_nulls_ties_and_empty_table(spark):
    schema = "conv_id bigint, turn bigint, payload string"
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0
    one = json.dumps({"role": "user", "content": "b"})
    two = json.dumps({"role": "user", "content": "a"})
    rows = [(None, 1, one), (None, None, two), (1, 1, one), (1, 1, two), (1, 1, two), (2, 0, None)]
    out = chat.digests(chat.conversations(spark.createDataFrame(rows, schema)))
    assert {r["conv_id"]: r["n_turns"] for r in out.collect()} == {None: 2, 1: 3}
