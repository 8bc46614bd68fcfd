import random
import textwrap

import pytest

from quire.llm import sentences

EN = ["The platform moved to version 5.3 and cut costs by 58.5%.", "Contact Ms. Quillan at the Data Bureau, Bldg. 19, approx. 56.2 km from the station.", "Who may apply for verification?", "Dr. Varlowe presented the register.", "Some services, e.g. security review, remain free of charge."]
ZH = ["系统升级至V4.3版后，响应时间缩短了36.2%。", "“真快！”一位园区负责人这样说。", "他说：“推行首席数据官制度后，一个月就拿到了补助！”", "《公共数据怎么用？》一文介绍了做法。", "（具体名单另行公布。）"]
FR = ["« Qui finance ? » demande souvent le public.", "Le budget atteint 41.686 euros selon le doc. n° 1292 du registre.", "M. Quillan a rappelé que l’art. 77 s’applique.", "Quelle réussite pour Chenghu !"]
TH = ["หน่วยงานท้องถิ่นต้องยื่นเอกสารภายใน 90 วันทำการ", "มาตรการนี้ช่วยลดต้นทุนของผู้ให้บริการ"]


def joined(parts, sep):
    text, ends = "", []
    for p in parts:
        text += (sep if text else "") + p
        ends.append(len(text))
    return text, ends


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        forms, sep = rng.choice([(EN, " "), (ZH, ""), (FR, " "), (TH, " ")])
        text, ends = joined([rng.choice(forms) for _ in range(rng.randint(1, 5))], rng.choice([sep, sep, "\n"]))
        if forms in (EN, FR) and "\n" not in text and rng.random() < 0.4:
            text = "\n".join(textwrap.wrap(text, 60, break_on_hyphens=False, break_long_words=False))
        out.append((text, ends))
    return out


@pytest.fixture(scope="module")
def model():
    return sentences.fit_rows([t for t, _ in sample(600, 1)])


def test_held_out(model):
    right = wrong = lost = 0
    for text, ends in sample(300, 2):
        got, want = set(model.ends(text)), set(ends)
        right, wrong, lost = right + len(got & want), wrong + len(got - want), lost + len(want - got)
    assert right / (right + wrong) > 0.98 and right / (right + lost) > 0.98


def test_wrapped_lines(model):
    text = "Contact Ms. Quillan at the Data Bureau, Bldg. 19, approx.\n56.2 km from the station. The platform moved to version\n5.3 and cut costs by 58.5%."
    assert [text[a:b].strip()[-12:] for a, b in zip([0, *model.ends(text)], model.ends(text))] == ["the station.", "ts by 58.5%."]


def test_headings_and_lists(model):
    assert model.ends("一、总则\n- 公共数据\n- 信用信息") == [4, 11, 18]


def test_defined_results(model):
    assert model.ends(None) == model.ends("") == model.ends(" \n ") == []
    assert model.ends("a") == [1] and model.ends("  a  ") == [3]
    long = "系统升级至V4.3版后，响应时间缩短了36.2%。" * 4000
    assert len(model.ends(long)) == 4000


def test_rows(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(sample(400, 3))] + [(900, None, "x"), (901, "", None), (902, rows_text := "系统升级。逾期放弃。", None), (903, rows_text, None)]
    df = spark.createDataFrame(rows, "block_id bigint, text string, sentence string")
    got = sentences.sentences(df.drop("sentence"))
    out = {}
    for r in got.orderBy("block_id", "sent_no").collect():
        out.setdefault(r["block_id"], []).append(r["sentence"])
    assert 900 not in out and 901 not in out and out[902] == out[903] == ["系统升级。", "逾期放弃。"]
    for i, t, _ in rows[:400]:
        assert "".join("".join(out[i]).split()) == "".join(t.split())
    assert sentences.sentence_ends(df.limit(0)).count() == 0
