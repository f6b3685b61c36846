import random
import re

from maskwright.llm import identifiers as I

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def valid(digits):
        total = 0
        for k, d in enumerate(reversed(digits)):
            n = int(d) * (1 + k % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and valid(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return [(a, I.KINDS[k], b) for a, k, b in sorted(found)]


def test_base_spans_as_the_plain_patterns():
    rnd = random.Random(4)
    pieces = ["a", "é", "@", ".", "-", "+", "%", " ", "1", "25", "255", "256", "4111111111111111", "4111 1111-1111 1111", "(", ")", "+1 (555) 010-9999", "x@y.z", "@@", "..", "10.0.0.1", "٣", "\n", "007"]
    for _ in range(20000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert I.base_spans(text) == plain(text), text


def test_contexts_find_more_and_leave_others_alone(spark):
    rnd = random.Random(1)
    words = ["red", "blue", "tree", "house", "of", "the", "runs", "over"]
    filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(k, f"{filler(9)} call hotline +1 (555) 010-{1000 + k} {filler(5)}", "x") for k in range(8)]
    rows += [(100, f"{filler(4)} call hotline 030 555 1234 {filler(3)}", "x"), (101, f"{filler(4)} 030 555 9876 {filler(3)}", "x"), (102, None, "x"), (103, "", "x")]
    rows.append(rows[8])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own string")
    got = {}
    for r in I.identifiers(docs).collect():
        got.setdefault(r["doc_id"], []).append(([tuple(s) for s in r["base"]], [tuple(s) for s in r["all"]]))
    assert all(len(got[k][0][0]) == 1 and got[k][0][0] == got[k][0][1] for k in range(8))
    assert len(got[100]) == 2
    text = rows[8][1]
    assert [(k, text[a:b]) for k, a, b in got[100][0][1]] == [("phone", "030 555 1234")] and got[100][0][0] == []
    assert got[101] == got[102] == got[103] == [([], [])]
    assert I.identifiers(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_every_supported_pattern_takes_part(spark):
    seed = lambda k: f"+1 555 {k:07d}"
    label = lambda k: "".join(chr(97 + int(d)) for d in str(k)) + "x"
    rows = [f"{label(k)} {seed(10 * k + j)}" for k in range(2100) for j in range(4)] + [f"{label(k)} 040 {k:05d}" for k in range(2100)]
    rows += [f"rare {seed(90000 + j)}" for j in range(3)] + ["rare 030 555 1234"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["all"]] for r in I.identifiers(docs).where(f"doc_id >= {len(rows) - 1} or doc_id between 8400 and 10499").collect()}
    assert got[len(rows) - 1] == [("phone", 5, 17)] and all(len(s) == 1 for s in got.values()) and len(got) == 2101


def test_found_values_support_further_patterns(spark):
    number = lambda k, j: f"030 555 {1000 + 10 * k + j}"
    labels = ["hotline", "rufnummer", "tel", "fon", "apparat", "durchwahl", "zentrale"]
    rows = [f"call hotline +1 555 0000{100 + j}" for j in range(30)]
    for k, label in enumerate(labels):  # the values of each label stand after the next one too, twice
        rows += [f"my {label} {number(k, j)}" for j in range(3)] + [f"my {after} {number(k, j)}" for after in labels[k + 1 : k + 2] for j in range(3)] * 2
    rows += [f"price {number(90, j)}" for j in range(5)] + [f"my zentrale {number(80, 0)}", f"price {number(80, 0)}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: len(r["all"]) for r in I.identifiers(docs).collect()}
    assert {rows[k] for k, n in got.items() if not n} == {f"price {number(90, j)}" for j in range(5)}


def test_occurrences_of_patterns_as_counted_plainly(spark):
    rnd = random.Random(2)
    words = [f"Wört{k}" for k in range(12)] + ["x" * 50]
    texts = [None, "", " "] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    want = {}
    for text in texts:
        w = (text or "").lower().split()
        for i in range(len(w)):
            for p in [f"1 {w[i]}", *([f"2 {w[i - 1]} {w[i]}"] if i else []), *[f"3 {w[i]} {b}" for b in w[i + 2 : i + 5]]]:
                want[p] = want.get(p, 0) + 1
    asked = rnd.sample(sorted(want), 200) + ["1 nowhere", "3 not here"]
    totals = I._occurrences(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in asked], "pattern string"))
    got = {r["pattern"]: r["total"] for r in totals.collect()}
    assert {p: got.get(p) for p in asked} == {p: want.get(p) for p in asked}


def test_long_runs_of_digits_and_redaction():
    assert I.base_spans("1" * 50_000) == []
    text = "a x@y.zz b"
    assert I.redact(text, [(k, a, b) for a, k, b in I.base_spans(text)]) == "a <email> b"


def test_secrets_by_form_and_by_context(spark):
    digest = lambda k: f"{k:02d}" + "ab12" * 9 + "cd"
    rows = [f'some words token = "{digest(k)}" and more' for k in range(5)] + ['here token = "Qw3rTy-99x" it is', "version Qw3rTy-98x of it", f"x{digest(1)} is longer"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["base"]], [rows[r["doc_id"]][s["start"] : s["end"]] for s in r["all"] if s["kind"] == I.SECRET]) for r in I.identifiers(docs).collect()}
    assert all(got[k] == ([], [digest(k)]) for k in range(5))
    assert got[5][1] == ["Qw3rTy-99x"] and got[6][1] == [] and got[7][1] == []


def test_contexts_have_no_window():
    text = "before " + "w" * 500 + " " * 300 + '("1.2.3.4")' + " " * 200 + "v" * 90 + " end"
    at = text.index("1.2.3.4")
    assert I.Words(text).contexts(at, at + 7) == ["1 " + "w" * 500, "2 before " + "w" * 500, "3 " + "w" * 500 + " " + "v" * 90]
    assert I.Words("x@y.z").contexts(0, 5) == [] and I.Words("a x@y.z").contexts(2, 7) == ["1 a"]
