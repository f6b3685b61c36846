import corpus_pipeline
from maskwright.llm import bpe


def test_each_decision_takes_effect(spark, tmp_path):
    leak = "Which of the following rivers flows through the largest number of different countries on this continent today."
    body = " ".join(f"word{k}" for k in range(40))
    near = body.replace("word39", "other")
    rows = [
        (1, f"shared line of seven words is here\n{body}", "en", "a", 9),
        (2, f"shared line of seven words is here\n{near}", "en", "a", 9),
        (3, "1234 !!", "en", "a", 9),
        (4, None, "en", "a", 9),
        (5, f"plain opening words of a document\n{leak}", "en", "a", 9),
        (6, "the shared line of seven words is here too\nquite different closing words for this one", "en", "a", 9),
        (7, "shared line of seven words is here\nsomething of its own to say in the end", "en", "a", 9),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    # Document 2's lines both match lines of document 1: no word of it is left.
    assert set(texts) == {1, 6, 7}
    assert texts[1][0] == rows[0][1] and texts[6][0] == "quite different closing words for this one"
    assert texts[7] == ("something of its own to say in the end", 38)
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {k: bpe.codec().encode(t) for k, (t, _) in texts.items()}


def test_odd_tables(spark, tmp_path):
    """Empty tables; null columns, repeated rows and clashing names; a long text."""
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id bigint, text string, lang string, place string, tokens int, n_chars bigint"
    for k, rows in enumerate(([], [(1, "one two three", "en", "p", 1, 13), (1, "one two three", "en", "p", 1, 13), (None, "four five", None, None, None, None), (2, "long word " * 50_000, None, None, None, 500_000), (3, None, "en", None, None, 0)])):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes
        kept = sorted((r["doc_id"] or 0, r["n_chars"]) for r in docs.collect())
        assert kept == ([] if not k else [(0, 9), (1, 13), (1, 13), (2, 500_000)])
