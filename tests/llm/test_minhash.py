import random
import re

import pytest

from maskwright.llm import minhash
from maskwright.llm.components import components


def brute(rows):
    def of(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        n = min(5, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()

    sets = [of(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 75 * (len(a) + len(b) - n):
                    x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                    parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    base = [rnd.choice(words) for _ in range(120)]
    passage = [rnd.choice(words) for _ in range(60)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            text = list(base)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        elif kind == 1 and rows:
            text = (rnd.choice(rows)[1] or "").split()
            if text and rnd.random() < 0.6:
                text[rnd.randrange(len(text))] = rnd.choice(words)
        elif kind == 2:
            text = passage + [rnd.choice(words) for _ in range(rnd.randint(0, 90))]
        else:
            text = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        rows.append((1000 - i * 3, rnd.choice([" ", "\n", "\t "]).join(text)))
    rows += [(2001, None), (2002, ""), (2003, "  \n"), (2004, "One"), (2005, "oNE "), (2006, "a b c"), (2007, "É b c"), (2008, "é b c")]
    return rows


@pytest.mark.parametrize(("seed", "few", "block", "columns"), [(1, 32, 512, 8192), (2, 2, 7, 50)])
def test_same_as_brute_force(spark, monkeypatch, seed, few, block, columns):
    for name, value in (("FEW", few), ("BLOCK", block), ("COLUMNS", columns)):
        monkeypatch.setattr(minhash, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, digest string, node int")
    assert minhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (None, "z", "z", 3)], "doc_id bigint, text string, digest string, kept int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["digest"] for r in kept.collect()) == ["x", "z"]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 4), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
