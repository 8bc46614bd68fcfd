from quire.llm import site_lines

SCHEMA = "block_id bigint, source string, text string, _q_extra string, line_no string"


def brute(rows):
    """The definition, told plainly."""
    import re
    from collections import Counter, defaultdict

    key = lambda x: re.sub("[0-9]+", "0", re.sub(r"\s+", "", x))
    n, df = Counter(), defaultdict(set)
    for b, s, t, *_ in rows:
        if s is not None:
            n[s] += 1
            for x in (t or "").split("\n"):
                df[s, key(x)].add(b)
    return {
        (b, i)
        for b, s, t, *_ in rows
        if s is not None and t is not None
        for i, x in enumerate(t.split("\n"), 1)
        if key(x) and len(df[s, key(x)]) >= 8 and len(df[s, key(x)]) >= 0.05 * n[s]
    }


def rows():
    out = []
    for i in range(60):
        word = "".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17, 19, 23)) + chr(97 + i // 26)
        lines = [f"body {word} of {word[::-1]}", f"© site  {i}" if i % 5 == 0 else "more text here", "page 1"]
        out.append((i, "hot" if i < 40 else "small", "\n".join(lines), "x", "y"))
    out += [(100, None, "page 1", None, None), (101, "hot", None, None, None), (102, "hot", "", None, None), (103, "hot", " \n\n", None, None), (104, "small", "page 1\npage 2\n" + "long " * 20000, None, None)]
    return out


def test_matches_definition(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in site_lines.repeated_lines(df.select("block_id", "source", "text")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows())


def test_strip_keeps_the_rest(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["block_id"]: r["clean_text"] for r in site_lines.strip_site_lines(df).collect()}
    assert len(got) == len(rows()) and got[101] is None and got[102] == "" and got[100] == "page 1"
    assert got[1].startswith("body ") and "\n" not in got[1] and "page" not in got[104]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert site_lines.repeated_lines(df).count() == 0 and site_lines.strip_site_lines(df).count() == 0


def test_near_duplicates_share_a_band():
    a = site_lines.signatures(["分享到微信微博收藏打印本页关闭窗口", "分享到微信微博收藏打印本页关闭窗口", "完全不同的一行正文内容在这里"])
    assert (a[0] == a[1]).all() and (a[0] != a[2]).all()


def test_a_block_counts_once_for_a_cluster(spark):
    """Ten lines alike in one block are no site line; the same line in ten blocks is."""
    ten = "\n".join(f"第{x}项任务由县级主管部门会同有关单位组织实施并按季度报送进展情况和下一步安排" for x in "一二三四五六七八九十")
    made = [(0, "s", ten, "", "")] + [(i, "s", f"{chr(0x5000 + i * 37)}只在这里 {chr(97 + i % 26) * 3}{i * 7919}\n本站声明：转载请注明出处", "", "") for i in range(1, 40)]
    got = {r["block_id"]: r["clean_text"] for r in site_lines.strip_site_lines(spark.createDataFrame(made, SCHEMA)).collect()}
    assert got[0] == ten and all("声明" not in got[i] and "只在这里" in got[i] for i in range(1, 40))


def test_clusters_are_components(spark):
    """Near-duplicates of different lines of a cluster go with it, in one group and in many."""
    base = "本网站由泊云区数据管理服务中心主办技术支持单位负责运行维护未经许可不得转载任何内容"
    chain = [base, base[:-2] + "图片", base[:-4] + "文字图片", "请" + base[:-4] + "文字图片", "敬请" + base[:-4] + "文字图片"]
    made = [(i, "s", f"{chr(0x6000 + i * 53)}{chr(0x5100 + i * 91)}正文{i}\n{chain[i % 5]}", "", "") for i in range(30)]
    df = spark.createDataFrame(made, SCHEMA)
    old = site_lines.CHUNK
    try:
        for site_lines.CHUNK in (old, 2):
            got = [r["clean_text"] for r in site_lines.strip_site_lines(df).collect()]
            assert len(got) == 30 and all("正文" in t and "\n" not in t for t in got)
    finally:
        site_lines.CHUNK = old


def test_links_match_all_pairs():
    """The forest of a group has the components of all alike pairs."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(30)) for _ in range(12)]
    lines = sorted({"".join(c if rng.random() > 0.04 else "子" for c in rng.choice(words)) for _ in range(150)})
    alike = [(i, j) for i in range(len(lines)) for j in range(i) if site_lines._alike(site_lines._set(lines[i]), site_lines._set(lines[j]))]

    def parts(links):
        up = list(range(len(lines)))
        for _ in range(len(lines)):
            for i, j in links:
                up[i] = up[j] = min(up[i], up[j])
        return up

    got = site_lines.linked(list(enumerate(lines)))
    assert alike and len(got) < len(lines) and parts(got) == parts(alike)
    for n in range(1, 20):
        few = [(i, lines[i]) for i in range(n)]
        assert parts(site_lines.linked(few)) == parts([(i, j) for i, j in alike if i < n])


def test_recall_of_near_duplicates(spark, data):
    """Alike lines of a source are found in a band for nine tenths of them at least."""
    lines = [r["line"] for r in spark.read.parquet(f"{data}/blocks.parquet").selectExpr("explode(split(text, '\n')) AS line").distinct().collect() if len(r["line"]) > 6]
    bands = site_lines.signatures(lines)
    sets = [site_lines._set(x) for x in lines]
    by: dict[str, list[int]] = {}
    pairs = set()
    for i, s in enumerate(sets):
        pairs |= {(j, i) for g in s for j in by.get(g, ())}
        for g in s:
            by.setdefault(g, []).append(i)
    near = [(i, j) for i, j in pairs if lines[i] != lines[j] and site_lines._alike(sets[i], sets[j])]
    assert near and sum((bands[i] == bands[j]).any() for i, j in near) >= 0.9 * len(near)


def test_members_are_shuffled_once(spark):
    """Buckets of one mask are left out, and members go through one exchange."""
    members = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (3, 12), (3, 13), (1, 13)], "_q_m bigint, _q_bucket bigint")
    near = site_lines.shared_buckets(members)
    assert sorted(tuple(r) for r in near.collect()) == [(1, 10, 2), (1, 13, 2), (2, 10, 2), (3, 13, 2)]
    assert near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_shuffle_files_go_with_the_cut(spark):
    """What led to a table that is written is not kept on disk beside it."""
    import time

    from quire import session

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        kept = disk.getAllFiles()
        return {name for name in (kept.apply(i).getName() for i in range(kept.size())) if name.startswith("shuffle_")}

    before = files()
    table = session.cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get(session._FREED) == "false"
