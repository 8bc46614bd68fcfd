import unicodedata

from quire.llm import lookalike, mojibake

SCHEMA = "block_id bigint, text string, section string, source string, field string, value string"


def test_variants_have_plain_forms():
    assert lookalike.VARIANTS["Ａ"] == "A" and lookalike.VARIANTS["⽤"] == "用" and lookalike.VARIANTS["ﬁ"] == "fi" and lookalike.VARIANTS["​"] == "" and lookalike.VARIANTS[" "] == " "
    for kept in "，：（）％①Ⅲ㎡℃~":
        assert kept not in lookalike.VARIANTS


def test_classes_are_transitive():
    uf = lookalike.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        uf.join(a, b)
    assert sorted(map(sorted, uf.classes().values())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_rewriting_is_longest_first():
    table = lookalike.representatives({s: 1 for s in ("é", "ﬃ", "ﬁ", "ｱ", "ｶﾞ", "각", "⽤")})
    a = lookalike.automaton_of(table)
    assert lookalike.rewrite("café oﬃce ﬁ ｱｶﾞ 각 使⽤", a, table) == "café office fi アガ 각 使用"


def rows():
    plain = [(i, "平台开放HTTP接口，参考Office的做法，由API与SaaS维护。", "一、总则", f"s{i % 3}", "f", "v") for i in range(60)]
    odd = [
        (100, "平台开放НТТР接口", None, "s", None, None),  # Cyrillic and Greek look-alikes
        (101, "参考Оffiсе的做法", "", "s", None, None),
        (102, "Перечень данных 为俄文", "⼀、总则", "s", None, None),
        (103, "参考Office的做法", "Ａ１", "s", None, None),
        (104, unicodedata.normalize("NFD", "São Vérde"), "a​b", "s", None, None),
        (105, None, None, None, None, None),
        (106, "", "", "s", None, None),
        (107, "α系数，误差±5μs，①㎡Ⅲ，（一）", "A　B", "s", None, None),
        (108, "平台开放НТТР接口", None, "s", None, None),
        (109, "字" * 100_000 + "⽤", None, "s", None, None),
    ]
    return plain + odd


def test_skeletons_join_all_scripts():
    """Cyrillic, Greek, full-width and mathematical forms of a letter are one class, through one another."""
    assert {"АΑＡ𝐀".translate(lookalike.skeletons())} == {"AAAA"} and "оοо".translate(lookalike.skeletons()) == "ooo"


def test_long_runs_of_marks(spark):
    """A letter under very many marks gets its plain form and is not collected."""
    df = spark.createDataFrame([(1, "一个e" + "\u0301" * 500 + "字", None), (2, "e\u0301", None)], "block_id bigint, text string, section string")
    got = {r["block_id"]: r["text_plain"] for r in lookalike.unify(df).collect()}
    assert got[1] == unicodedata.normalize("NFC", "一个e" + "\u0301" * 500 + "字") and got[2] == "é"
    _, counts = lookalike.scanned(df, ("text", "section"))
    assert counts.filter("kind = 's'").selectExpr("max(length(form))").first()[0] <= lookalike.LONGEST


def test_fields(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in lookalike.lookalike_fields(df).collect()]
    want = {(100, "text"), (101, "text"), (102, "section"), (103, "section"), (104, "text"), (104, "section"), (107, "section"), (108, "text"), (109, "text")}
    assert len(got) == len(set(got)) and set(got) == want


def test_unify(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["block_id"]: r for r in lookalike.unify(df).collect()}
    assert len(got) == len(rows()) and got[100]["text_plain"] == "平台开放HTTP接口" and got[101]["text_plain"] == "参考Office的做法"
    assert got[102]["text_plain"].startswith("Перечень") and got[102]["section_plain"] == "一、总则" and got[103]["section_plain"] == "A1"
    assert got[104]["text_plain"] == "São Vérde" and got[104]["section_plain"] == "ab" and got[105]["text_plain"] is None and got[107]["section_plain"] == "A B"
    assert lookalike.lookalike_fields(df.limit(0)).count() == 0


def test_fields_are_left_out_by_the_model_of_all_rows(spark, monkeypatch):
    made, fit = [], mojibake.fit
    monkeypatch.setattr(mojibake, "fit", lambda fields: made.append(fit(fields)) or made[-1])
    texts = [f"平台开放接口{i}个，参考{'Оffiсе' if i == 7 else 'Office'}的做法{chr(0x5000 + i // 40)}。" for i in range(2400)]
    df = spark.createDataFrame([(i, t, None, "s.pdf") for i, t in enumerate(texts)], "block_id bigint, text string, section string, source string")
    assert [tuple(r) for r in lookalike.lookalike_fields(df).collect()] == [(7, "text")]
    assert made == [mojibake.train({"zh": texts, "source": ["s.pdf"]})]
