"""The retriever against a plain telling of its rules, and answers over it."""

import numpy as np

from quire.config import EngineConfig
from quire.functions import embedding
from quire.operators import dense, lexical, ranking
from quire.plans import answer, retrieve

BLOCKS = "block_id bigint, source string, page int, tier string, section string, path string, text string"
TOPICS = ("数据登记确权", "算力券申请条件", "数据要素流通平台", "公共数据授权运营", "电子证照跨域调度", "隐私计算平台建设")


def rows():
    out = []
    for i in range(90):
        topic = TOPICS[i % 6]
        source = f"关于{TOPICS[i % 6]}的通知{i % 9}.pdf" if i < 60 else f"汇编{i % 2}.md"
        tier = ("国家政策", "省级政策", None)[i % 3]
        out.append((i, source, i % 4 or None, tier, f"第{i % 7}节", f"第{i % 5}章 {TOPICS[i % 5]} > 第{i % 7}节", f"{topic}由主管部门第{i * 7 % 11}次组织实施，{TOPICS[(i * 5 + 1) % 6]}另行规定{'甲乙丙丁'[i % 4] * (i % 5)}"))
    return [*out, (200, "外地.pdf", 1, "其他地区政策", None, None, "深圳数据登记确权"), (201, "空.pdf", 1, None, None, None, None), (202, "空.pdf", 2, None, "", "", "")]


def plain(blocks, question, config, k, limit, scope):
    """Hits of one question in a scope (a set of ids) or, for None, of all: lists, check, merging, told plainly."""
    by = {b[0]: b for b in blocks}
    q = embedding.vector(question, 64)
    near = []
    for b in blocks:
        v = embedding.vector(b[6], 64)
        if v is not None:
            d = max(float((q.astype(float) ** 2).sum() + (v.astype(float) ** 2).sum() - 2 * q.astype(float) @ v.astype(float)), 0)
            near.append((-round(1 - d / np.sqrt(2), 6), b[0]))
    near = [(s, i) for s, i in sorted(near) if -s >= config.score_threshold - 1e-9]
    ranked = [i for _, i in near if i in scope][:120]
    allowed = {i for _, i in near[: config.recheck_depth]}
    hits = [i for i in ranked if i in allowed][:limit]
    sizes = {}
    for b in blocks:
        sizes[b[1]] = sizes.get(b[1], 0) + 1
    out = []
    for i in hits:
        s = by[i][1]
        out += [x for x in (sorted(b[0] for b in blocks if b[1] == s) if sizes[s] <= config.small_source_max else [i]) if x not in out]
    return out[:limit], hits


def test_scoped_retrieval(spark):
    config = EngineConfig()
    df = spark.createDataFrame(rows(), BLOCKS)
    found = retrieve.corpus(df)
    asked = [(1, "省级数据登记确权由谁负责"), (2, "数据登记确权由谁组织实施"), (3, "《算力券申请条件》由谁组织"), (4, " "), (5, None)]
    hits, kinds = retrieve.retrieve(found, spark.createDataFrame(asked, "question_id bigint, question string"))
    kind = {r["question_id"]: r["kind"] for r in kinds.collect()}
    assert (kind[1], kind[2], kind[3]) == ("tier", "local", "named")
    got = {}
    for r in hits.orderBy("question_id", "position").collect():
        got.setdefault(r["question_id"], []).append(r["block_id"])
    everything = {b[0] for b in rows()}
    scopes = {1: {b[0] for b in rows() if b[3] == "省级政策"}, 2: everything - {200}, 3: {b[0] for b in rows() if "算力券申请条件" in b[1]}}
    for n, question in asked[:3]:
        want, _ = plain(rows(), question, config, config.top_k, config.retrieve_limit, scopes[n])
        assert got[n][: len(want)] == want and len(got[n]) == len(set(got[n])) <= config.retrieve_limit, n
    assert 200 not in got[2]


def test_free_retrieval_and_summaries(spark):
    df = spark.createDataFrame(rows(), BLOCKS)
    found = retrieve.corpus(df)
    asked = spark.createDataFrame([(1, "外地数据登记确权"), (2, "外地数据登记确权请总结一下")], "question_id bigint, question string")
    hits, kinds = retrieve.retrieve(found, asked)
    assert {r["kind"] for r in kinds.collect()} == {"all"}
    got = {n: [r["block_id"] for r in hits.filter(f"question_id = {n}").orderBy("position").collect()] for n in (1, 2)}
    best = [r["block_id"] for r in lexical.search(found.index, asked.filter("question_id = 1"), "block_id", "question_id", 1).collect()]
    assert set(best) <= set(got[1]) and len(got[1]) <= 24 < len(got[2])
    first = next(b[1] for b in rows() if b[0] == got[2][0])
    whole = {b[0] for b in rows() if b[1] == first}
    assert whole == set(got[2][: len(whole)])


def test_answers(spark):
    found = retrieve.corpus(spark.createDataFrame(rows(), BLOCKS))
    asked = spark.createDataFrame([(1, "算力券申请条件由谁组织"), (2, "qqq zzz"), (3, "xxx yyy"), (4, ""), (5, None), (6, "xxx yyy 报告")], "question_id bigint, question string")
    history = spark.createDataFrame([(3, "知识库中的旧答", ["a", "b"]), (6, "旧", ["a"])], "question_id bigint, answer string, sources array<string>")
    got = {r["question_id"]: r for r in answer.answers(found, asked, history=history).collect()}
    assert len(got) == 6 and "算力券" in got[1]["answer"] and got[1]["sources"] and not got[1]["unknown"]
    assert got[2]["unknown"] and got[4]["unknown"] and got[5]["unknown"] and got[6]["unknown"] and got[2]["sources"] == []
    assert got[3]["answer"] == "已有资料中的旧答" and got[3]["sources"] == ["a", "b"]
    searches = spark.createDataFrame([(1, 2, "甲"), (1, 4, "乙")], "conv_id bigint, turn int, query string")
    results = spark.createDataFrame([("甲", 1, "题", "https://a.example", "文")], "query_text string, position int, title string, url string, snippet string")
    web = {r["turn"]: r for r in answer.web_answers(searches, results).collect()}
    assert web[2]["answer"].startswith("> ") and not web[2]["unknown"] and web[4]["unknown"]


def test_embeddings(spark):
    import pytest

    assert abs((embedding.vector("数据 abc", 16) ** 2).sum() - 1) < 1e-6 and embedding.vector("", 16) is None and embedding.vector(None, 16) is None
    with pytest.raises(ValueError):
        embedding.provider("other")


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "block_id bigint, text string")
    asked = spark.createDataFrame([(1, "数据")], "question_id bigint, question string")
    assert lexical.bm25(none, asked, "block_id", "question_id", 3).count() == 0


def test_section_places_are_the_heaviest_in_scope(spark):
    """The same blocks as weighing every block of the scope."""
    df = spark.createDataFrame(rows(), BLOCKS)
    found = retrieve.corpus(df)
    asked = spark.createDataFrame([(1, "省级数据登记确权"), (2, "算力券申请条件第3节"), (3, "外地公共数据授权运营"), (4, "《算力券申请条件》第2节数据")], "question_id bigint, question string")
    kinds, named, local = retrieve.scopes(df, asked)
    weights = {(r["question_id"], r["section"]): r["weight"] for r in ranking.section_weights(df.selectExpr("path AS section"), asked).collect()}
    inside = {1: lambda b: b[3] == "省级政策", 2: lambda b: b[0] != 200, 3: lambda b: True, 4: lambda b: "算力券申请条件" in b[1]}
    for depth in (3, 20, 500):
        got = {}
        for r in retrieve.section_places(found, asked, kinds, named, local, depth).orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append(r["block_id"])
        for n, ok in inside.items():
            want = sorted((-weights[n, b[5]], b[0]) for b in rows() if ok(b) and (n, b[5]) in weights)
            assert got.get(n, []) == [i for _, i in want[:depth]], (n, depth)


def test_questions_that_ask_the_same_are_looked_up_once(spark):
    asked = spark.createDataFrame([(i, f"第{i % 3}项由谁组织") for i in range(30)], "question_id bigint, question string")
    queries = spark.createDataFrame([(i, 1, f"问{i % 2}") for i in range(30)], "question_id bigint, turn int, query string")
    stands = {r["question_id"]: r["first_id"] for r in answer.alike(asked, queries).collect()}
    assert stands == {i: i % 6 for i in range(30)}


def test_heaviest_blocks_against_all_pairs(spark):
    """No pair of a question and a path is written; what comes out is what all pairs give."""
    df = spark.createDataFrame(rows(), BLOCKS)
    part = {}
    for i, source, _, tier, _, path, _ in rows():
        if path:
            part.setdefault((path, tier or "", source.startswith("关于")), []).append(i)
    asked = [(1, TOPICS[0], "all", None), (2, TOPICS[1] + TOPICS[0], "tier", "省级政策"), (3, TOPICS[2] + "第三节", "local", None), (4, TOPICS[0], "all", None), (5, "的", "all", None)]
    questions = spark.createDataFrame(asked, "question_id bigint, question string, kind string, tier_found string")
    weights = {(r["question_id"], r["section"]): r["weight"] for r in ranking.section_weights(df.selectExpr("path AS section"), questions).collect()}
    groups = spark.createDataFrame([(*k, sorted(v)[:4]) for k, v in part.items()], "path string, tier string, home boolean, ids array<bigint>")
    grams = questions.withColumn("grams", ranking.question_grams(questions.question))
    got = {}
    for r in ranking.heaviest_blocks(groups, grams, 4).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((-r["weight"], r["block_id"]))
    for n, _, kind, tier in asked:
        want = [(-weights[n, path], i) for (path, t, home), ids in part.items() for i in ids if (n, path) in weights and (kind == "all" or kind == "tier" and t == tier or kind == "local" and home)]
        assert got.get(n, []) == sorted(want)[:4], n


def test_the_driver_has_one_block_of_queries_at_a_time(spark, monkeypatch):
    """Many queries give what one block gives; equal ones are sent once, and no plan holds a pass for each block."""
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], "ab"[i % 2]) for i in range(60)], "vec_id bigint, embedding array<float>, s string")
    asked = spark.createDataFrame([(i, [float(i % 4), float(i % 3), 1.0], ("a", "b", None)[i % 3]) for i in range(48)], "vec_id bigint, embedding array<float>, s string")
    near = lambda same: dense.nearest(vectors, asked, 5, None, same)
    want = {same: sorted(near(same).collect()) for same in (None, "s")}
    sent, plain = [], dense._pass
    monkeypatch.setattr(dense, "_pass", lambda v, ids, *rest: sent.append(len(ids)) or plain(v, ids, *rest))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 5)
    for same in (None, "s"):
        sent.clear()
        got = near(same)
        assert sum(sent) == 12 and "MapInArrow" not in got._jdf.queryExecution().toString()
        assert sorted(got.collect()) == want[same]


def test_questions_that_name_the_same_share_a_list_of_sources(spark):
    df = spark.createDataFrame(rows(), BLOCKS)
    asked = spark.createDataFrame([(i, f"《{TOPICS[i % 2]}》第{i}项由谁组织") for i in range(20)] + [(50, "省级《算力券申请条件》"), (51, "《没有的名称》")], "question_id bigint, question string")
    kinds, named, _ = retrieve.scopes(df, asked)
    kind = {r["question_id"]: (r["kind"], r["within"]) for r in kinds.collect()}
    assert all(kind[i] == ("named", i % 2) for i in range(20)) and kind[50] == ("named", 50) and kind[51] == ("local", None)
    lists = sorted((r["within"], r["source"]) for r in named.collect())
    want = [(n, s) for n, topic in ((0, TOPICS[0]), (1, TOPICS[1]), (50, TOPICS[1])) for s in sorted({b[1] for b in rows() if topic in b[1]})]
    assert lists == want


def test_completed_sources_carry_no_texts(spark, monkeypatch):
    """Blocks are put in order before questions meet them: by page (none last), path, section, text, id."""
    df = spark.createDataFrame(rows(), BLOCKS)
    hits = spark.createDataFrame([(1, 70, 1), (1, 3, 2), (2, 3, 1)], "question_id bigint, block_id bigint, rank int")
    by = {b[0]: b for b in rows()}
    place = lambda b: (b[2] is None, b[2] or 0, b[5] or "", b[4] or "", b[6] or "", b[0])
    whole = lambda i: [b[0] for b in sorted((b for b in rows() if b[1] == by[i][1]), key=place)]
    met, plain = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda rows: met.append(rows.columns) or plain(rows))
    out = ranking.complete_sources(hits, df, 17)
    got = {n: [r["block_id"] for r in out.filter(f"question_id = {n}").orderBy("position").collect()] for n in (1, 2)}
    assert got == {1: (whole(70) + whole(3))[:17], 2: whole(3)[:17]}
    assert met == [["source", "path", "block_id", "place"]]
