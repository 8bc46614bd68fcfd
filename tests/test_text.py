"""Text functions, ranking and dialogue on small rows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import text as T
from quire.functions.prefix import running_sum
from quire.operators import dense, dialog, ranking, scope, web


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr).first()[0]


def test_functions(spark):
    c = F.col("t")
    assert one(spark, T.strip(c), t="　 a b ") == "a b"
    assert one(spark, T.squeeze(c), t="a 　b\n") == "ab"
    assert one(spark, T.tier_from_path(c), t="x/03市级政策/a.md") == "市级政策"
    assert one(spark, T.tier_from_path(c), t="a.md") == ""
    assert one(spark, T.suffix(c), t="x/a.B.PDF") == ".pdf"
    assert one(spark, T.without_extension(c), t="a.b.Docx") == "a.b"
    assert one(spark, T.quoted_titles(c), t="《甲》和《乙》") == ["甲", "乙"]
    assert one(spark, T.without_enumeration(c), t=" 12.问题") == "问题"
    assert one(spark, T.outside_titles(c, (("a", "b"),)), t="a《a》a") == "b《a》b"
    assert one(spark, T.clean_html(c), t="<b>x</b> &lt;y&gt; &amp;lt;") == "x &lt;"
    assert one(spark, T.line_kind(c), t="##### x") == "body"
    assert one(spark, T.line_kind(c), t="#### x") == "heading3"
    assert one(spark, T.sentences(c), t="甲。 乙！\n\n丙") == ["甲", "乙", "丙"]


def test_running_sum_over_buckets(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("v", F.lit(1))
    got = running_sum(df, ["g"], ["id"], F.floor(F.col("id") / 7), "v", "n").collect()
    assert all(r["n"] == r["id"] // 3 + 1 for r in got)


def test_dense_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in dense.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()}
    for q in range(0, 300, 50):
        d = ((x.astype("f4") - x[q].astype("f4")) ** 2).sum(1)
        assert [got[q, r] for r in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()


def test_interleave_and_fuse(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, id int, rank int")
    assert [r["id"] for r in ranking.interleave([a, b], "q", "id", 9).orderBy("position").collect()] == [10, 11, 12]
    assert ranking.fuse([a, b], "q", "id", 1).first()["id"] == 11


TURNS = "turn_id bigint, conv_id bigint, turn int, role string, content string, sources array<string>, unknown boolean"


def test_dialogue(spark):
    rows = [
        (1, 1, 0, "USER", "《甲》的条件是什么？", [], None),
        (2, 1, 1, "assistant", "我还不懂这些，你可以换个问法 再问一次。", ["s"], None),
        (3, 1, 2, "user", "好的", None, None),
        (4, 1, 3, "assistant", "答", ["t", "s", "t", None], False),
        (5, 1, 4, "user", "它的依据呢？", [], None),
        (6, 1, 4, "user", "again", [], None),
        (7, 2, 0, "system", "x", [], None),
        (8, 2, 1, "user", " ", [], None),
        (9, 3, 0, "user", "它呢？", [], None),
    ]
    t = spark.createDataFrame(rows, TURNS)
    assert {(r["conv_id"], r["turn"]) for r in dialog.without_unknown(t).collect()} == {(1, 2), (1, 3), (1, 4), (3, 0)}
    assert {(r["conv_id"], r["turn"]): r["question"] for r in dialog.resolved(t).collect()}[1, 4] == "甲的依据呢？"
    assert {(r["conv_id"], r["turn"]): r["question"] for r in dialog.resolved(t).collect()}[3, 0] == "它呢？"
    assert [(r["turn"], r["consents"]) for r in dialog.pending_consent(t).collect()] == [(2, True)]
    assert [r["source"] for r in dialog.history_sources(t).filter("conv_id = 1").orderBy("position").collect()] == ["s", "t"]
    assert dialog.recent(t, 2).filter("conv_id = 1").count() == 2


def test_scope_and_settings(spark):
    spark.conf.set("quire.top_k", "7")
    spark.conf.set("quire.chunk_size", "many")
    config = EngineConfig.from_session(spark)
    assert (config.top_k, config.chunk_size) == (7, 1000)
    spark.conf.unset("quire.top_k")
    spark.conf.unset("quire.chunk_size")
    rows = [(1, "a", "其他地区政策", "上海"), (2, "b", None, "云岭"), (3, "上海c", "市级政策", ""), (4, "d", "市级政策", None)]
    df = spark.createDataFrame(rows, "block_id bigint, source string, tier string, text string")
    assert {r["source"] for r in scope.local_sources(df).collect()} == {"b", "d"}


def test_files_naming(spark):
    asked = spark.createDataFrame([(1, "《数据 条例》和《城市名册2021》讲什么？"), (2, "没有书名"), (3, "《 》《甲》"), (4, None)], "question_id int, question string")
    files = spark.createDataFrame([("市政府关于数据条例的公告.pdf",), ("名册.docx",), ("别的.pdf",), (None,), ("",), ("数据条例.jpg",), (".pdf",), ("甲.txt",), ("甲.txt",)], "source string")
    assert sorted(tuple(r) for r in scope.named_files(asked, files).collect()) == [(1, "名册.docx"), (1, "市政府关于数据条例的公告.pdf"), (1, "数据条例.jpg"), (3, "甲.txt")]
    assert scope.named_files(asked, files.limit(0)).count() == 0


def test_sources_in_scope(spark):
    """Named files that are local; all named ones if none is; with a tier whatever is named."""
    named = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "b")], "question_id int, source string")
    local = spark.createDataFrame([("a",), ("z",)], "source string")
    classes = spark.createDataFrame([(1, None, False), (2, None, False), (3, "省级政策", False), (4, None, False)], "question_id int, tier_found string, wants_other boolean")
    assert sorted(map(tuple, scope.scoped_sources(named, local, classes).collect())) == [(1, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_tiers(spark):
    cases = {"国家级补助": "国家政策", "全市有哪些": "市级政策", "省级和市级": "省级政策", "深圳的市级补助": None, "其他地区政策": "其他地区政策", "补助": None}
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "question_id int, question string")
    got = {r["question_id"]: r for r in scope.question_classes(df).collect()}
    assert [got[i]["tier_found"] for i in range(len(cases))] == list(cases.values())
    assert got[1]["is_list"] and got[1]["is_summary"] and not got[1]["is_summary_style"] and got[3]["wants_other"]


def test_topics(spark):
    cases = {
        "数字孪生是什么？": "数字孪生",
        "《甲 办法》和《乙办法》呢": "乙办法",
        "关于数据标注基地有什么期望吗？": "数据标注基地",
        "可信数据空间在哪些园区试点？另一句": "可信数据空间",
        "什么？": None,
        "吗": None,
        "": None,
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r["q"]: r["t"] for r in df.select("q", T.topic(F.col("q")).alias("t")).collect()}
    assert {q: got[q] for q in cases} == cases


def test_referents_of_the_same_message(spark):
    """A topic before the word that refers to it comes first, an earlier turn's only after it."""
    rows = [
        (1, 1, 0, "user", "数字孪生是什么？", None, None),
        (2, 1, 1, "user", "算力券是什么？它的期限呢？", None, None),
        (3, 1, 2, "user", "这个政策什么时候失效？", None, None),
        (4, 1, 3, "user", "上述内容", None, None),
    ]
    got = {r["turn"]: r["question"] for r in dialog.resolved(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1] == "算力券是什么？算力券的期限呢？" and got[2] == "数字孪生什么时候失效？" and got[3] == "数字孪生"
    asked = {(r["turn"], r["position"]): r["query"] for r in dialog.conversation_queries(spark.createDataFrame(rows, TURNS)).collect()}
    assert asked[0, 1] == "数字孪生是什么？" and (0, 2) not in asked and asked[2, 2] == "算力券是什么？它的期限呢？ 数字孪生什么时候失效？"


def test_web_searches(spark):
    unknown = "我还不懂这些，你可以换个问法再问一次。"
    rows = [
        (1, 1, 0, "user", "算力券的期限？", None, None), (2, 1, 1, "assistant", unknown, None, None), (3, 1, 2, "user", "好的，联网吧", None, None),
        (4, 2, 0, "user", "帮我搜索一下算力券的期限。", None, None), (5, 3, 0, "user", "好的", None, None), (6, 4, 0, "assistant", "要。需要我帮你联网搜索相关的答案吗？", None, None), (7, 4, 1, "user", "行", None, None),
    ]
    got = {(r["conv_id"], r["turn"]): r["query"] for r in dialog.web_searches(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {(1, 2): "算力券的期限？", (2, 0): "算力券的期限", (4, 1): ""}
    past = {r["conv_id"]: (r["answer"], r["sources"]) for r in dialog.answers_from_history(spark.createDataFrame([*rows, (8, 5, 0, "assistant", "答", ["b", "a"], None), (9, 5, 1, "assistant", unknown, ["c", "b"], None)], TURNS)).collect()}
    assert past[5] == ("答", ["b", "a", "c"]) and 1 not in past


def test_captured_results(spark):
    rss = "<rss><channel><title>x</title><item><title>甲 &amp;lt;b&amp;gt;乙</title><link>https://a.example/1?x=1&amp;y=2</link><description>&lt;p&gt;摘 要&lt;/p&gt;</description></item><item><title>无</title><link>ftp://b</link></item></channel></rss>"
    listed = '<ol><li class="b_algo"><h2 x><a t href="https://c.example">标&nbsp;题<b>!</b></a></h2><div><p c>摘要&hellip;</p></div></li>\n<li class="b_algo"><h2><a href="javascript:x">no</a></h2></li></ol>'
    headed = '<h3 class="v"> <a x href="http://d.example">一</a></h3><h3><a href="http://e.example"> </a></h3>'
    boxed = '<body><div class="r c-container"><h3 t><a k href="https://f.example">二</a></h3><span class="content-right_1">文</span></div><div class="c-container x"><h3><a href="https://g.example">三</a></h3></div></body>'
    rows = [("q", k, k, p) for k, p in (("rss", rss), ("listed", listed), ("headed", headed), ("boxed", boxed))] + [("q", "rss", "rss", "<broken"), ("q", "rss", "rss", None), ("q", "x", "other", "x")]
    got = sorted(tuple(r) for r in web.parsed(spark.createDataFrame(rows, "query_text string, engine string, kind string, payload string")).collect())
    assert got == sorted([
        ("q", "rss", 1, "甲 乙", "https://a.example/1?x=1&y=2", "摘 要"), ("q", "listed", 1, "标 题 !", "https://c.example", "摘要…"),
        ("q", "headed", 1, "一", "http://d.example", ""), ("q", "boxed", 1, "二", "https://f.example", "文"), ("q", "boxed", 2, "三", "https://g.example", ""),
    ])


def test_sources_completed_by_paths(spark):
    paths = ["第一章 总则", "第一章 总则 > 第二条", "第一章 总则 > 第二条 > （一）", "第二章 附则", "第二章 附则 > 第九条", None]
    chunks = spark.createDataFrame([(i, "a", 1, p, p and p.split(" > ")[-1], "t") for i, p in enumerate(paths)] + [(9, "b", None, None, None, None)], "block_id int, source string, page int, path string, section string, text string")
    config = EngineConfig(summary_full_source_max=3)
    for hit, want in ((0, {0, 1, 2, 5}), (2, {0, 1, 2, 5}), (4, {3, 4, 5}), (5, {0, 1, 2, 3, 4, 5}), (9, {9})):
        hits = spark.createDataFrame([(7, hit, 1)], "question_id int, block_id int, rank int")
        assert {r["block_id"] for r in ranking.complete_sources(hits, chunks, 200, config).collect()} == want


def test_small_functions(spark):
    c = F.col("t")
    assert one(spark, T.query_lines(c), t="1. 甲\n\n二、乙\n" + "长" * 81 + "\n（丙\n3）丁\n戊") == ["甲", "乙", "（丙", "丁"]
    offered = one(spark, T.with_offer(c), t=" 答 ")
    assert offered == "答需要我帮你联网搜索相关的答案吗？" and one(spark, T.with_offer(c), t=offered) == offered
    assert one(spark, T.printable_share(c), t="ab\x01\u3000") == 0.5 and one(spark, T.printable_share(c), t="a\n数 ") == 1 and one(spark, T.printable_share(c), t="") is None
    assert one(spark, T.ideographs(c), t="a数据1") == 2
    assert one(spark, T.inline_markup(c), t="a **b** *c* `<d>` 2*3") == "a <b>b</b> <i>c</i> <code>&lt;d&gt;</code> 2*3"
    assert one(spark, T.tier_from_path(c), t="x/01国家政策/a.txt") == "国家政策" and one(spark, T.tier_from_path(c), t="x/02 _ 省级/a") == "省级" and one(spark, T.tier_from_path(c), t="a.txt") == ""
    assert one(spark, T.tokens(c), t="A-1数据条例，法") == ["a", "1", "数据", "据条", "条例", "法"]
    assert one(spark, T.clean_html(c), t="&#x6570;<br>&amp;lt;&nbsp;x") == "数 &lt; x"
