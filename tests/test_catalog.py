"""Every query of the engine against its DuckDB counterpart on the smallest tables."""

import os

import pytest

from maskwright.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return c


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows_of(got), rows_of(want), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_whole_documents_are_searched_for_all_types(spark, tmp_path):
    texts = ["CEO: Maya Stone", "This agreement is with Acme Widgets Private Limited today", "Registered Office: 12 Park Street, Mumbai 400001, Maharashtra, India"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    named = {"PERSON", "COMPANY", "ADDRESS"}
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r["entity_type"] for r in run("detections_by_type") if r["accepted"]} == named
    assert {r["entity_type"] for r in run("plan_by_type")} == named
    assert {"PERSON", "ADDRESS"} <= {r["entity_type"] for r in run("leak_classify")} <= named
