import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mojibake

ZH = ["数据局每年安排不少于{}万元用于公共数据的安全审查。", "逾期未提交申请表的，视为自动放弃{}。", "园区企业应当在{}年前提交信用承诺书和场景建设方案。", "平台开放接口{}个，支持行业协会在线调用电子证照。"]
FR = ["La qualité du service s’est améliorée grâce à l’espace de confiance {}.", "À partir de février {}, le Bureau des finances publiera les résultats détaillés."]
EN = ["The platform moved to version {} and cut costs by half.", "Projects already funded by the council in {} are not eligible."]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    make = lambda forms: ["".join(rng.choice(forms).format(rng.randint(1, 9999)) for _ in range(3)) for _ in range(150)]
    return mojibake.Model(*mojibake.train({"zh": make(ZH), "fr": make(FR), "en": make(EN)}))


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gb18030"), ("gb18030", "latin-1"), ("gb18030", "cp437"), ("utf-8", "cp437"), ("utf-8", "cp1251")]


@pytest.mark.parametrize("written,read", CHAINS)
def test_round_trip(model, written, read):
    text = "数据局每年安排不少于4096万元用于公共数据的安全审查。逾期未提交申请表的，视为自动放弃7。"
    try:
        wrong = text.encode(written).decode(read)
    except UnicodeDecodeError:
        pytest.skip("not all bytes can be read so")
    assert model.judge(wrong) == (True, text)


def test_passage_and_swap(model):
    text = "平台开放接口7个，支持行业协会在线调用电子证照。"
    wrong = text[:9] + text[9:].encode().decode("latin-1")
    assert model.judge(wrong) == (True, text)
    swapped = text.encode("utf-16-le").decode("utf-16-be", "surrogatepass")
    assert model.judge(swapped)[0]


def test_western(model):
    text = "La qualité du service s’est améliorée grâce à l’espace de confiance 12."
    assert model.judge(text.encode().decode("cp1252")) == (True, text)
    assert model.judge(text) == (False, text)


def test_clean_and_odd_fields_stay(model):
    for text in (None, "", " ", "plain ascii", "数据局", "园区企业应当在9年前提交信用承诺书和场景建设方案。" * 500):
        assert model.judge(text) == (False, text)
    assert model.judge("abc�数据")[0] and model.judge("锟斤拷锟斤拷")[0]


def test_naming_is_judging(model):
    """A field is named exactly where judging restores it or finds it broken."""
    rng = random.Random(8)
    texts = [rng.choice(ZH + FR + EN).format(rng.randint(1, 9999)) for _ in range(120)]
    for written, read in CHAINS:
        for t in texts[:40]:
            texts.append(t[:7] + t[7:].encode(written, "replace").decode(read, "replace"))
            texts.append(t[:-5].encode(written, "replace").decode(read, "ignore") + t[-5:])
    named = [model.wrong(t) for t in texts]
    assert named == [model.judge(t)[0] for t in texts] and any(named) and not all(named)


def test_query_on_rows(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(ZH).format(rng.randint(1, 99)) for _ in range(3)), f"数发〔{i}〕号.pdf", "e") for i in range(200)]
    rows += [(500, rows[0][1].encode().decode("latin-1"), "a.pdf", None), (501, None, None, None), (502, "", "x" * 5, ""), (503, rows[1][1], rows[1][2].encode().decode("cp1252", "replace"), "e"), (504, rows[0][1].encode().decode("latin-1"), "a.pdf", None)]
    df = spark.createDataFrame(rows, "block_id bigint, text string, source string, text_bad string")
    assert {tuple(r) for r in mojibake.wrong_fields(df).collect()} == {(500, "text"), (503, "source"), (504, "text")}
    assert mojibake.restore_fields(df.drop("text_bad")).filter(F.col("text_fixed") == rows[0][1]).count() >= 3
    assert mojibake.wrong_fields(df.limit(0)).count() == 0


def test_passages_in_fitted_rows():
    rng = random.Random(3)
    made = ["".join(rng.choice(FR).format(rng.randint(1, 9999)) for _ in range(3)) for _ in range(150)]
    wrong = [t[:40] + t[40:].encode().decode("cp1252", "replace") for t in made[:6]]
    wrong = [(w, t) for w, t in zip(wrong, made) if "\ufffd" not in w]
    assert len(wrong) >= 2
    fitted = mojibake.Model(*mojibake.train({"fr": [*(w for w, _ in wrong), *made]}))
    assert [fitted.judge(w) for w, _ in wrong] == [(True, t) for _, t in wrong]
    assert not any(fitted.judge(t)[0] for t in made)


def test_shortest_of_all_offers(model, monkeypatch):
    text = "数据局每年安排不少于4096万元用于公共数据的安全审查。"
    wrong = text.encode().decode("latin-1")
    offers = [(text[i:][::-1] + text[:i], 1) for i in range(8, 0, -1)] + [(text, 1)]
    monkeypatch.setattr(model, "steps", lambda t, odd: iter(offers if t == wrong else ()))
    assert model.judge(wrong) == (True, text)


def test_model_is_counted_over_all_rows(spark):
    """Rows beyond any draw count: the model of a table is that of all its rows, however they lie."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(ZH).format(rng.randint(1, 9999)) for _ in range(2)) + chr(0x5000 + i // 40) for i in range(2400)]
    df = spark.createDataFrame([(i, t, f"{i % 30}号.pdf") for i, t in enumerate(texts)], "_id bigint, text string, source string")
    fitted = mojibake.fit(df)
    assert fitted == mojibake.train({"zh": texts, "source": [f"{i}号.pdf" for i in range(30)]}) == mojibake.fit(df.repartition(7))
    assert {chr(0x5000 + i) for i in range(60)} <= set(fitted[1])
