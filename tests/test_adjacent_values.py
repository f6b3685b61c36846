"""Values with one character, or less than a gap, between them."""

import collections
import datetime as dt

import pytest

from maskwright.functions import detectors
from maskwright.plans import catalog

TODAY = dt.date(2026, 1, 1)


@pytest.mark.parametrize(
    ("name", "text", "found"),
    [
        ("email", "a@x.org b@y.org,c@z.org", ["a@x.org", "b@y.org", "c@z.org"]),
        ("ip", "10.0.0.1 10.0.0.2,10.0.0.3", ["10.0.0.1", "10.0.0.2", "10.0.0.3"]),
        ("phone", "94.182.225.142 +1 (705) 555-1902 Oring", ["+1 (705) 555-1902"]),
    ],
)
def test_one_character_serves_as_the_edge_of_both_neighbours(name, text, found):
    """As the reference's patterns look around; the queries' SQL consumes that character and loses the second value."""
    assert [c.text for c in detectors.scan(text, [], TODAY, [name])] == found


def test_top_types_counts_each_type_as_its_own_query_does(spark, tmp_path):
    import duckdb

    texts = ["the 4495589438270767 42.73.240.87 the", "38.211.12.42 4366089147969128", "10.1.2.3 and 4495589438270767", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = collections.Counter(map(tuple, catalog.top_types(spark, str(tmp_path)).collect()))
    assert got == collections.Counter(con.execute(catalog.oracle_sql()["top_types"]).fetchall())
    assert got == collections.Counter([("IP_ADDRESS", 3), ("CREDIT_CARD", 3)])
