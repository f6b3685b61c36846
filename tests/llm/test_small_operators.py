"""Encoding, languages and benchmark items: hard inputs, round trips, held-out accuracy."""

import random

import numpy as np

from maskwright.llm import bpe, decontaminate, langid
from pyspark.sql import functions as F


def test_encoding_equals_one_pass_whatever_the_leaves():
    codec, rnd = bpe.codec(), random.Random(1)
    alphabet = "ab  \n\t'sé中1!\x1c　'll"
    for _ in range(5000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        assert codec.encode(text, leaf=rnd.choice([1, 2, 5]), window=rnd.choice([1, 2, 4])) == codec._encoding.encode_ordinary(text)
    for text in ("x" * 9000, " " * 5000, "é" * 5000 + " a"):
        ids = codec.encode(text, leaf=100)
        assert ids == codec._encoding.encode_ordinary(text) and codec.decode(ids).decode() == text


def test_encoding_of_documents(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "<|endoftext|>", "x")]
    out = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out)[1:] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matches_equal_plain_edit_distance():
    rnd = random.Random(3)
    items = [(k, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 60))).strip() or "x") for k in range(12)]
    matcher = decontaminate.Matcher(items, 0.1)
    for _ in range(150):
        text = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80)))
        for _, item in rnd.sample(items, 2):
            broken = list(item)
            for _ in range(rnd.randint(0, 7)):
                at = rnd.randrange(len(broken) + 1)
                broken[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "a"])
            text += "".join(broken)
        want = {(i, d) for i, item in items if (d := distance(item, text)) <= int(len(item) * 0.1)}
        assert {(i, d) for i, d, _ in matcher.matches(text)} == want


def test_leaks_in_documents(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today."
    rows = [(1, f"Intro. {item.upper()} end", "x"), (2, item.replace("quick", "quack").replace(" ", "\n "), "x"), (3, "nothing here", "x"), (4, None, "x"), (5, "", "x"), (3, "nothing here", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " "), (None, "nothing here"), (7, item)], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 7, 0), (2, 7, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()) == [3, 3, 4, 5]
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], "doc_id bigint, text string"), bench).count() == 0


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op9_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert out.where("score < 0 or score > 1").count() == 0


def viterbi(scores, switch):
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def test_labels_equal_a_plain_viterbi_and_spans_cover_words():
    english, greek = "the house of the king and the queen " * 40, "το σπίτι του βασιλιά και η πόλη " * 40
    french = "la maison de la reine et du roi dans une ville " * 40
    counts = np.stack([langid.counts_of([t]) for t in (english, french, greek)], axis=1).astype(float)
    grams, scripts = counts[: langid.BUCKETS], counts[langid.BUCKETS :]
    model = langid.Model(["en", "fr", "el"], np.log((grams + 0.5) / (grams.sum(0) + 0.5 * langid.BUCKETS)).astype("f4"), scripts > 0.01 * scripts.sum(0))
    texts = ["the house 12 la maison de la reine", "", "το σπίτι the king", "..", "queen"]
    words, path = langid.label(model, texts, 4.0)
    scores = np.add.reduceat(model.logp[words.grams], words.first, axis=0)
    allowed = model.uses[words.script]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), scores, -1e6)
    for k in range(len(texts)):
        own = words.doc == k
        assert not own.any() or viterbi(scores[own], 4.0) == path[own].tolist()
    got = langid.predict(model, texts, True)
    assert got[2][2] == [(0, 8, "el"), (9, 17, "en")] and got[1] == ("und", 0.0, []) and got[3] == ("und", 0.0, [])


def test_unusable_rows_and_no_training_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 !", "en"), (4, "some words", None), (4, "some words", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs.where("doc_id = 4"))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    model = langid.train(spark.createDataFrame([(1, "some words here", "en")], "doc_id bigint, text string, lang string"))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, model).collect()) == [4, 4]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_marks_alone_are_no_language_and_many_languages_keep_their_numbers(spark):
    assert not langid.has_letter("́ं 12") and langid.has_letter("é")
    rows = [(k, " ".join(chr(97 + (k + j * (k // 26 + 1)) % 26) * 3 for j in range(30)), f"l{k:03d}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 200
    _, path = langid.label(model, [r[1] for r in rows])
    assert path.min() >= 0 and path.max() > 127
    assert langid.predict(model, ["́ं", "abc ́", None])[0][0] == langid.UNDETERMINED
