import random

import pytest

from quire.llm import scans
from quire.llm.boosting import Boosted

SCHEMA = "block_id bigint, source string, page int, block_seq int, text string, ocr boolean, noise string"
WORDS = "registration quality dataset percent compared previous publication assessment operators department reimbursement classification industry cross-border data-sharing".split()


def clean_line(rng, n=8):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def rows():
    rng = random.Random(4)
    out = [(i, f"o{i % 9}", None, i, "\n".join(clean_line(rng) for _ in range(4)) + "\n数据局负责公共数据的安全审查工作，提供方应当提交材料。", None, "x") for i in range(400)]
    k = 1000
    for s in range(12):
        for page in range(1, 6):
            head = "Title of work 7" if page == 1 else "TITLE OF WORK 7"
            body = [clean_line(rng, 5), "the quality data-", "sharing of percent regi-", "stration and publication", clean_line(rng, 4)]
            if page == 3:
                body.append("the asscssment of pub1ication is co\nmpared")
                body.append("数椐局负责公共数据的安全审查工作，提供方应当提交材料。")
            out.append((k, f"scan{s}", page, page, "\n".join([head, *body, f"- {page + 10} -"]), True, None))
            k += 1
    out += [(k, "scan0", 1, 1, out[400][4], True, None), (k + 1, None, None, None, None, True, None), (k + 2, "scan0", 9, 9, "", True, None), (k + 3, "o1", 1, 1, "- 1 -", False, None)]
    return out


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return {tuple(r) for r in scans.scan_noise(df.drop("noise")).collect()}


def test_furniture(found):
    for i, source, page, _, text, ocr, _ in rows()[400:460]:
        last = len(text.split("\n"))
        assert (i, last, "page_number") in found
        assert ((i, 1, "running_header") in found) == (page > 1)


def test_cut_words(found):
    for i, *_ in rows()[400:460]:
        assert (i, 4, "broken_word") in found and (i, 3, "broken_word") not in found


def test_misread(found):
    for i, _, page, _, text, *_ in rows()[400:460]:
        lines = {n for b, n, kind in found if b == i and kind == "misread"}
        if page == 3:
            assert {7, 9} <= lines
        else:
            assert not lines


def test_copies_and_others(found):
    assert {(n, k) for b, n, k in found if b == 400 + 600} == {(n, k) for b, n, k in found if b == rows()[460][0]}
    assert not {b for b, *_ in found} & {i for i, _, _, _, t, ocr, _ in rows() if not ocr or not t}


def test_repair(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["block_id"]: r["paragraphs"] for r in scans.repair(df).collect()}
    text = got[1002]
    assert "Title" not in text and "TITLE" not in text and "- 13 -" not in text
    assert "data-sharing" in text and "registration and publication" in text and "assessment" in text and "数据局" in text
    assert got[rows()[461][0]] is None and got[rows()[462][0]] == ""


def test_repair_at_line_ends():
    """What was found at the start or end of a line is replaced, over line ends too, and headings stay apart."""
    text = "一、总则\nasscssment of the quality and more words in here\nby the opcrators of a data regis-\ntratlon 数椐局"
    fixes = [{"kind": "w", "token": t, "other": o} for t, o in (("asscssment", "assessment"), ("opcrators", "operators"), ("registratlon", "registration"))]
    joined, _ = scans.body(text, set(), {3})
    han = next(t for kind, t, i, _ in scans.tokens_of(joined) if kind == "t" and t[1] == "椐")
    got = scans._paragraphs(text, set(), {3}, [*fixes, {"kind": "t", "token": han, "other": han[0] + "据" + han[2]}])
    assert got == "一、总则\nassessment of the quality and more words in here by the operators of a data registration 数据局"
    assert scans._paragraphs("x\n\n", {1}, set(), []) == "" and scans._paragraphs("ab\ncd", set(), set(), []) == "ab cd"


def test_candidates_are_whole(spark):
    """Words with one or two wrong places always meet the right word."""
    rng = random.Random(9)
    shapes = (("rn", "m"), ("cl", "d"), ("e", "c"), ("t", "f"), ("l", "1"), ("o", "0"), ("b", "h"), ("i", "l"))
    vocabulary = sorted({w for w in " ".join(clean_line(rng) for _ in range(60)).replace(".", "").replace("-", " ").split()} | {"commencement", "modern", "internal", "middle", "information", "interim", "form"})
    asked = {}
    for w in vocabulary:
        for _ in range(6):
            bad = w
            for _ in range(rng.choice((1, 2))):
                a, b = rng.choice(shapes)
                i = bad.find(a)
                if i >= 0:
                    bad = bad[:i] + b + bad[i + len(a) :]
            if bad != w and len(bad) >= 3:
                asked[bad] = w
    tokens = spark.createDataFrame([("w", t) for t in asked], "kind string, token string")
    many = spark.createDataFrame([("w", w, 50) for w in vocabulary], "kind string, token string, n long")
    met = {(r["token"], r["other"]) for r in scans.candidates(tokens, many).collect()}
    assert len(asked) > 40 and not [x for x in asked.items() if x not in met]


def test_empty(spark):
    assert scans.scan_noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_keys_of_many_lines():
    lines = ["The quick MODEL 12 of 1O0", "", "ﬁne ligature", "é6q0", "Über die Straße", "- 7 -", "第 3 章", "e\u0301tude", "\u0301ab", "a\u2028b", "".join(a for a, _ in scans.ALIKE)]
    assert scans.running_keys(lines) == [scans.running_key(x) for x in lines] and scans.running_keys([]) == []
    pairs = [(a, b) for a in lines for b in lines]
    assert scans.likenesses([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [scans.likeness(a, b) for a, b in pairs]
    assert scans.likeness("abab", "ab") == 0.5 and scans.likeness("a", "b") == scans.likeness("", "b") == 0.0


def test_pages_around_are_whole(spark):
    """Lines meet exactly those of the pages around them, whatever the runs; a crowded page does not meet itself."""
    rng = random.Random(5)
    lines = [(i, f"s{rng.randrange(3)}", rng.choice((-3, 0, *range(1, 60))), rng.random() < 0.5) for i in range(300)]
    lines += [(1000 + i, "s2", 70, True) for i in range(200)] + [(2000, "s2", 2**31 - 1, True), (2001, "s2", -(2**31), True), (2002, "s2", 2**31 - 2, True)]
    want = {(a, b) for a, s, p, f in lines for b, t, q, g in lines if s == t and f == g and 1 <= abs(p - q) <= scans.AROUND}
    for width in (scans.RUN, 1):
        rows = spark.createDataFrame([(*x, width) for x in lines], "a int, source string, page int, foot boolean, width int")
        other = rows.selectExpr("a AS b", "source AS s2", "page AS page2", "foot AS foot2", "width AS width2")
        assert {(r["a"], r["b"]) for r in scans.around(rows, other).collect()} == want
        left = scans.around(rows, other, "left").select("a", "b").collect()
        assert {(r["a"], r["b"]) for r in left} == want | {(a, None) for a, *_ in lines if a not in {x for x, _ in want}} and len(left) == len(set(left))


def test_pages_at_the_ends_of_their_type(spark):
    rows = [(i, "s", page, 1, f"Work on quality 3\nsome text of a page\n- {n} -", True) for i, (page, n) in enumerate([(2**31 - 1, 5), (2**31 - 2, 4), (-(2**31), 9), (1, 1)])]
    got = scans.scan_noise(spark.createDataFrame(rows, SCHEMA.rpartition(",")[0])).collect()
    assert {r["block_id"] for r in got if r["noise"] == "page_number"} == {0, 1, 2, 3}


def test_counts_over_batches():
    """A task counts over its batches, and passes on what it holds when it is much."""
    batch = lambda *texts: scans.pa.RecordBatch.from_pydict({"text": scans.pa.array(texts, scans.pa.string())})
    parts = lambda: iter([batch("one two-three", None, "数据局"), batch(), batch("", "one 数据局")])
    whole = [r for b in scans._count(parts()) for r in b.to_pylist()]
    got = {(r["kind"], r["token"]): r["n"] for r in whole}
    assert len(got) == len(whole) and got["w", "one"] == 2 and got["w", "two-three"] == 1 and got["t", "数据局"] == 2 and got["t", "^数据"] == 1 and got["t", " 数据"] == 1


def test_samples_settle_ties(spark):
    """Which of the rows with one key are drawn does not hang on the order in which they come."""
    rows = [("a", k // 50, k % 50) for k in range(600)]
    drawn = [{tuple(r) for r in scans.bounded_sample(spark.createDataFrame(x, "s string, h int, idx int").repartition(n), "s", "h", 120, ("idx",)).collect()} for x, n in ((rows, 1), (rows[::-1], 3))]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 120


def test_page_numbers():
    for line, want in (("- l2 -", 12), ("第 3 页 共 9 页", 3), ("Page 4 of 29", 4), ("·7·", 7), ("iv", 4), ("[12]", 12), ("14.3%", None), ("2023 items", None), ("civil", None)):
        got = scans.page_number(line)
        assert (got and got[0]) == want, line


def test_difference():
    assert scans.difference("regisbration", "registration") == (5, "b", "t")
    assert scans.difference("forrn", "form") == (3, "rn", "m")


def test_boosting_learns():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = Boosted().fit(x[:1500], y[:1500]).score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    assert Boosted().fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).max() < 0.5
