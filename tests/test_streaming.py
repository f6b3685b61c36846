from pyspark.sql import functions as F

from maskwright.functions.types import containers_of
from maskwright.streaming.detection import detections, redacted

KEY = b"0123456789abcdef"


def test_a_stream_of_texts(spark, tmp_path):
    spark.createDataFrame([("a", "SSN 123-45-6789"), ("b", "nothing"), ("c", "ip 10.0.0.1")], "id string, body string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, body string").parquet(str(tmp_path / "in"))
    texts = containers_of(stream, F.col("id"), F.col("body"))
    query = detections(texts, ("ssn", "ip")).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["doc_id"], r["entity_type"]) for r in spark.table("found").collect()) == [("a", "SSN"), ("c", "IP_ADDRESS")]
    out = []
    query = redacted(texts, KEY, lambda df, _: out.extend(df.collect()), str(tmp_path / "state"), ("ssn", "ip"))
    query.processAllAvailable()
    query.stop()
    assert {r["doc_id"]: "123-45" in r["text"] or "10.0.0.1" in r["text"] for r in out} == {"a": False, "b": False, "c": False}
