import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import neighbours



def brute(rows, k=20):
    out = {}
    for q, a in rows:
        if q % 20 == 0:
            scored = sorted((-float((np.float64(a) * np.float64(b)).sum()), i) for i, b in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "vec_id bigint, embedding array<float>")
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, **options).collect()):
        out.setdefault(r[0], []).append((r[2], r[3]))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    monkeypatch.setattr(neighbours, "MEMBERS", 25)
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.standard_normal(16).astype(np.float32)) for i in range(1500)]
    truth, got = brute(rows), found(spark, rows)
    assert set(truth) == set(got)
    hits = sum(len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    by = dict(rows)
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in dict(near)
        assert all(abs(s - float((np.float64(by[q]) * np.float64(by[i])).sum())) < 1e-12 for i, s in near)


def test_ties_repeats_and_unusable_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(60, [3.0, 0.0, 0.5])]
    bad = [(80, None), (100, [0.0, 0.0, 0.0]), (120, [1.0, float("nan"), 0.0]), (140, [float("inf"), 0.0, 0.0]), (160, [1.0])]
    got = found(spark, [*rows, *bad, rows[3]])
    assert set(got) == {0, 20, 40, 60}
    assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 1.0])]) == {}
    assert found(spark, [(0, [1.0, 1.0]), (1, [0.5, 0.0])]) == {0: [(1, 0.5)]}


def test_double_vectors_are_scored_as_they_are(spark):
    rows = [(0, [1.0 + 1e-12, 0.0]), (1, [1e300, 1.0]), (2, [1.0, 1e-30]), (3, [-1e300, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, rank string, score int")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())]
    assert got == [(1, 1, (1.0 + 1e-12) * 1e300), (2, 2, 1.0 + 1e-12), (3, 3, -(1.0 + 1e-12) * 1e300)]


def test_queries_visit_no_more_leaves_than_the_recall_needs(spark, monkeypatch):
    """A fixed 15 % of the leaves of eight trees scored 1.2 times all rows; whole groups lie in few leaves."""
    monkeypatch.setattr(neighbours, "LEAF", 50)
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((40, 16)) * 10
    rows = [(i, (centres[i % 40] + rnd.standard_normal(16) * 0.01).astype(np.float32)) for i in range(6000)]
    fit, grown = neighbours.fit, []
    monkeypatch.setattr(neighbours, "fit", lambda *a, **b: grown.append(fit(*a, **b)) or grown[-1])
    told = []
    monkeypatch.setattr(neighbours, "wanted_leaves", lambda *a, of=neighbours.wanted_leaves: told.append(of(*a)) or told[-1])
    truth, got = brute(rows), found(spark, rows)
    assert sum(len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) for q in truth) >= 0.9 * 20 * len(truth)
    assert told[0] <= 0.03 * len(grown[0].normals) * grown[0].leaves


def test_groups_parts_blocks_and_turns(spark, monkeypatch):
    """Many small groups, taken in several turns, give what one whole visit of all leaves gives: brute force."""
    for name, value in (("LEAF", 20), ("BITS", 2), ("MEMBERS", 30), ("QUERIES", 10), ("TURN", 1), ("MERGED", 100)):
        monkeypatch.setattr(neighbours, name, value)
    rnd = np.random.default_rng(7)
    rows = [(i, rnd.standard_normal(6).astype(np.float32)) for i in range(700)] + [(700 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 2.0]) for i in range(90)]
    got = found(spark, [*rows, rows[3], rows[-1]], share=1.0)
    truth = {q: [(i, s) for i, s in near] for q, near in brute([(i, np.array(v, np.float32)) for i, v in rows]).items()}
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in truth.items()}
    assert got == truth
