import random
import re

import pytest

from maskwright.llm import lines


def tokens(line):
    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)


def brute(rows):
    every = [(i, k, tokens(line)) for i, text in sorted(r for r in rows if r[0] is not None) for k, line in enumerate((text or "").split("\n")) if text is not None]
    gone = set()
    for n, (i, k, s) in enumerate(every):
        if s and any(o and 4 * len(s & o) >= 3 * len(s | o) for a, b, o in every[:n]):
            gone.add((i, k))
    return gone


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    pool = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 60]))] for _ in range(30)]
    rows = []
    for i in range(140):
        out = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(pool)) if rnd.random() < 0.7 else [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if line:
                    line[rnd.randrange(len(line))] = rnd.choice(words)
            if rnd.random() < 0.2:
                line += [rnd.choice(words)]
            out.append(rnd.choice([" ", "  ", "\t"]).join(line))
        rows.append((300 - 2 * i, "\n".join(out)))
    return rows + [(901, None), (902, ""), (903, "\n\n"), (904, " W1 w2\r"), (905, "w1 W2"), (906, "É a"), (907, "é A"), (None, "w1 w2")]


def same(spark, rows):
    got = lines.matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert {(r[0], r[1]) for r in got} == brute(rows)
    by = {(i, k): tokens(line) for i, text in rows if text for k, line in enumerate(text.split("\n"))}
    for r in got:
        a, b = by[r[0], r[1]], by[r[2], r[3]]
        assert (r[2], r[3]) < (r[0], r[1]) and 4 * len(a & b) >= 3 * len(a | b)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    same(spark, corpus(seed))


def test_one_word_edits_of_short_lines_match(spark):
    rnd = random.Random(5)
    rows, edited = [], 0
    for k in range(60):
        line = [f"v{rnd.randrange(100_000)}" for _ in range(rnd.randint(10, 20))]
        other = list(line)
        other[rnd.randrange(len(line))] = f"x{k}"
        rows += [(2 * k, " ".join(line)), (2 * k + 1, "a line of its own " + str(k) + "\n" + " ".join(other))]
        edited += 1
    got = same(spark, rows)
    assert sum(r[1] == 1 for r in got) == edited


def test_chains_and_groups_of_near_lines(spark):
    """Each line is near the one before it only; and a group of which the earliest is near none of the rest."""
    chain = [(k, " ".join(f"c{j}" for j in range(2 * k, 2 * k + 16))) for k in range(30)]
    core = [f"g{j}" for j in range(30)]
    group = [(100, " ".join(core[:12] + [f"h{j}" for j in range(20)]))] + [(101 + k, " ".join([*core, f"own{k}", f"mine{k}"])) for k in range(80)]
    same(spark, chain + group)


def test_very_long_lines_and_texts(spark):
    rnd = random.Random(9)
    long = [f"l{rnd.randrange(400_000)}" for _ in range(200_000)]
    many = "\n".join(f"p{k} q{k} r{k} s{k}" for k in range(20_000))
    rows = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, many), (4, "x y z\n" + many)]
    got = lines.matches(spark.createDataFrame(rows, "doc_id bigint, text string"))
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {2: 1, 4: 20_000}
    kept = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept[4] == "x y z" and kept[2] == "" and kept[3] == many


def test_one_doc_id_with_several_texts(spark):
    rows = [(1, "alpha beta gamma\none two three"), (1, "four five six\nalpha beta gamma"), (1, "four five six\nalpha beta gamma"), (2, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(r["text"] for r in lines.without_repeated_lines(docs).where("doc_id = 1").collect())
    # Whichever text has the smaller digest keeps the common line; both rows of the repeated one fare alike.
    assert out in (sorted(["alpha beta gamma\none two three", "four five six", "four five six"]), sorted(["one two three", "four five six\nalpha beta gamma", "four five six\nalpha beta gamma"]))
    assert [r["text"] for r in lines.without_repeated_lines(docs).where("doc_id = 2").collect()] == [""]


def test_rewriting_keeps_other_lines_and_columns(spark):
    rows = [(2, "b c\n\nx y", "p"), (1, "a\nb c", "q"), (2, "b c\n\nx y", "p"), (3, None, "r"), (4, "a", "s"), (None, "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place string")
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(2, "\nx y", "p"), (1, "a\nb c", "q"), (2, "\nx y", "p"), (3, None, "r"), (4, "", "s"), (None, "a", "t")], key=str)
    assert lines.without_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_tokens_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(lines, "PART_ROWS", 2)
    same(spark, corpus(1))


@pytest.mark.parametrize("seed", [1, 2])
def test_every_link_between_different_sets_is_returned(spark, seed):
    core = [f"g{j}" for j in range(30)]
    rows = corpus(seed) + [(1000 + k, " ".join([*core, f"own{k}", f"mine{k}"])) for k in range(40)] + [(1100, " ".join([*core, "own3", "mine3"]))]
    every = [(i, k, tokens(line)) for i, text in sorted(r for r in rows if r[0] is not None and r[1] is not None) for k, line in enumerate(text.split("\n"))]
    first = {}
    for i, k, s in every:
        first.setdefault(s, (i, k))
    wanted = {(i, k, *first[s], True) for i, k, s in every if s and first[s] != (i, k)}
    sets = [(s, at) for s, at in first.items() if s]
    wanted |= {(*b, *a, False) for n, (t, b) in enumerate(sets) for s, a in sets[:n] if 4 * len(s & t) >= 3 * len(s | t)}
    got = [tuple(r) for r in lines.links(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert sum(r[0] == 1039 for r in got) == 39


def test_few_lines_of_a_wide_group_meet_all_earlier_ones(spark, monkeypatch):
    """Nearly all are near each other, none the earliest: that one alone was tried, then each met every earlier line."""
    rnd = random.Random(3)
    core = [f"g{j}" for j in range(60)]

    def edited(k, n):
        gone = set(rnd.sample(range(60), n))
        return " ".join(f"e{k}x{j}" if j in gone else w for j, w in enumerate(core))

    rows = [(0, edited(0, 9))] + [(k, edited(k, 4)) for k in range(1, 151)]
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, held: seen.append(pairs.count()) or verified(pairs, held))
    got = same(spark, rows)
    assert len(got) > 130
    assert len(seen) == 2 and seen[1] < 10 * len(rows)


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 2)])
def test_links_are_counted_without_pairing_wide_groups(spark, monkeypatch, seed, hot):
    """Every class and its number of links; the pairs of a wide group of near lines are not verified one by one."""
    monkeypatch.setattr(lines, "HOT", hot)
    rnd = random.Random(seed)
    core = [f"g{j}" for j in range(60)]
    group = [(1000 + k, " ".join([f"e{k}x{j}" if j in gone else w for j, w in enumerate(core)])) for k in range(120) for gone in [set(rnd.sample(range(60), rnd.choice([1, 1, 2, 6])))]]
    rows = corpus(seed) + group + [(1200, group[3][1]), (1200, group[3][1])]
    every = [(i, k, tokens(line)) for i, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}) for k, line in enumerate(text.split("\n"))]
    first = {}
    for i, k, s in every:
        first.setdefault(s, (i, k))
    near = {s: sum(4 * len(s & t) >= 3 * len(s | t) for t in first if t) - 1 for s in first if s}
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, held: seen.append(pairs.count()) or verified(pairs, held))
    got = [tuple(r) for r in lines.counted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k, *first[s], near[s]) for i, k, s in every if s}
    assert sum(near.values()) // 2 > 2 * sum(seen)


def test_wide_groups_of_which_most_are_far_from_each_other_are_not_paired(spark, monkeypatch):
    """Distances from any line prove little here; those from what most lines hold leave few pairs. Sizes reach over several classes."""
    monkeypatch.setattr(lines, "HOT", 64)
    rnd = random.Random(8)
    core = [f"g{j}" for j in range(60)]
    rows = []
    for k in range(200):
        gone = set(rnd.sample(range(60), rnd.choice([5, 5, 6, 3])))
        rows.append((k, " ".join(f"e{k}x{j}" if j in gone else w for j, w in enumerate(core))))
    rows += [(300 + n, " ".join(f"s{j}" for j in range(n))) for n in range(1, 50)]
    sets = [tokens(text) for _, text in rows]
    near = [sum(4 * len(s & t) >= 3 * len(s | t) for t in sets) - 1 for s in sets]
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, held: seen.append(pairs.count()) or verified(pairs, held))
    got = {tuple(r) for r in lines.counted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(i, 0, i, 0, n) for (i, _), n in zip(rows, near, strict=True)}
    assert sum(near[:200]) > 2000 and sum(seen) < 2000
