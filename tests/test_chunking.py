"""Chunk merging against a plain fold; splitting; section paths."""

import random

from quire.config import EngineConfig
from quire.operators import chunking


def fold(rows, size, overlap):
    """The greedy merge, told plainly for one source."""
    out, items, seg = [], [], 0

    def flush(keep):
        nonlocal items
        out.append((seg, "\n".join(t for t, _ in items).strip()))
        kept, n = [], 0
        for t, s in reversed(items):
            if not keep or n + len(t) > overlap:
                break
            kept.insert(0, (t, s))
            n += len(t)
        items = kept

    for text, section in rows:
        if section:
            if items:
                flush(False)
            seg += 1
        if len(text) > size:
            for part in chunking.split_oversized(text, size, overlap):
                items.append((part, section))
                if sum(len(t) for t, _ in items) >= size:
                    flush(True)
            continue
        if items and sum(len(t) for t, _ in items) + len(text) > size:
            flush(True)
        items.append((text, section))
        if sum(len(t) for t, _ in items) >= size:
            flush(True)
    if items:
        flush(False)
    return out


def test_merge_matches_fold(spark):
    rng = random.Random(5)
    config = EngineConfig(chunk_size=30, chunk_overlap=10)
    data, want = [], set()
    for k in range(12):
        rows = [("".join(rng.choice("abcd ，。") for _ in range(rng.choice([3, 8, 15, 70]))) + "x", rng.choice(["", "", "", "h"])) for _ in range(rng.randint(0, 14))]
        data += [(len(data) + i, f"s{k}", i, None, s, t) for i, (t, s) in enumerate(rows)]
        want |= {(f"s{k}", i, seg, t) for i, (seg, t) in enumerate(fold(rows, 30, 10))}
    df = spark.createDataFrame(data, "block_id bigint, source string, block_seq int, page int, section string, text string")
    got = chunking.merge_chunks(df, config).collect()
    assert sorted((s, seg, t) for s, _, seg, t in want) == sorted((r["source"], r["segment"], r["text"].split("\n", 1)[1]) for r in got)


def test_merge_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0, None, None, None), (2, None, 1, 3, "", " ")], "block_id bigint, source string, block_seq int, page int, section string, text string")
    assert chunking.merge_chunks(df).count() == 0


def test_split_oversized_covers_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abc，。\n ") for _ in range(rng.randint(0, 120)))
        parts = chunking.split_oversized(text, 20, 5)
        assert all(0 < len(p) <= 20 for p in parts)
        assert set("".join(parts)) >= set(text.replace(" ", "").replace("\n", "")) if text.strip() else not parts


def path_by_hand(heads, top):
    path, out = [], []
    for h in heads:
        if h:
            path = [h] if h.startswith(top) else path[:2] + [h]
        out.append(" > ".join(path))
    return out


def test_section_paths_match_fold(spark):
    rng = random.Random(9)
    data, want = [], {}
    for k in range(10):
        heads = [rng.choice(["", "", "一、甲", "二、乙", "（一）丙", "1.丁", "第一章 戊"]) for _ in range(25)]
        for i, (h, p) in enumerate(zip(heads, path_by_hand(heads, ("一、", "二、", "第一章")))):
            want[len(data)] = p
            data.append((len(data), f"s{k}", i * 1000, h))
    df = spark.createDataFrame(data, "block_id bigint, source string, block_seq int, section string")
    assert {r["block_id"]: r["path"] for r in chunking.section_paths(df).collect()} == want


def test_pages_to_chunks(spark):
    """Paths go on over pages, a page's own path begins anew, chunks take what their first block has."""
    pages = [
        ("a.pdf", 0, 1, "前言\n第一章 总则\n第一条 为了\n文", None, None),
        ("a.pdf", 1, 2, "接着\n第二条 再\n第三条 又\n\n第二章 附则", None, None),
        ("a.pdf", 2, 3, " \n", None, None),
        ("b.xlsx", 0, None, "工作表：甲\n1.一", "工作表：甲", "甲 > 乙 > 丙"),
        ("b.xlsx", 1, None, "工作表：丁", "工作表：丁", "丁"),
        ("c.txt", 0, None, None, None, None),
    ]
    schema = "source string, seq int, page int, text string, section string, section_path string, tier string, slide int, ocr boolean, converted_from string"
    df = spark.createDataFrame([(*p, "层级", None, None, ".doc") for p in pages], schema)
    want = {
        ("a.pdf", 0, 0): ("", ""), ("a.pdf", 0, 1): ("第一章 总则", "第一章 总则"), ("a.pdf", 0, 2): ("第一条 为了", "第一章 总则 > 第一条 为了"),
        ("a.pdf", 1, 0): ("", "第一章 总则 > 第一条 为了"), ("a.pdf", 1, 1): ("第二条 再", "第一章 总则 > 第一条 为了 > 第二条 再"), ("a.pdf", 1, 2): ("第三条 又", "第一章 总则 > 第一条 为了 > 第三条 又"),
        ("a.pdf", 1, 3): ("第二章 附则", "第二章 附则"), ("b.xlsx", 0, 0): ("工作表：甲", "甲 > 乙 > 丙"), ("b.xlsx", 0, 1): ("1.一", "甲 > 乙 > 1.一"), ("b.xlsx", 1, 0): ("工作表：丁", "丁"),
    }
    got = {(r["source"], r["seq"], r["block_no"]): (r["section"], r["path"]) for r in chunking.page_blocks(df).collect()}
    assert got == want
    chunks = {(r["source"], r["segment"]): r for r in chunking.chunks_of(df).collect()}
    assert chunks["a.pdf", 2]["text"] == "【来源：a.pdf】\n第一条 为了\n文\n接着" and chunks["a.pdf", 2]["page"] == 1 and chunks["a.pdf", 2]["path"].endswith("第一条 为了")
    assert {r["tier"] for r in chunks.values()} == {"层级"} and chunks["b.xlsx", 1]["converted_from"] == ".doc"
    assert chunking.chunks_of(df.limit(0)).count() == 0


def test_headings_are_told_from_text(spark):
    lines = {"第二节 经费": (True, True), "第三部分 附": (False, True), "第一条的规定": (False, False), "第一千条 末": (True, False), "一．总则": (True, True), "（3）丙": (True, False), "12、丁": (True, False), "1234.戊": (False, False), "一、": (False, False)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string")
    got = {r["line"]: (r["is_heading"], r["is_top"]) for r in chunking.heading_lines(df, "doc_id").collect()}
    assert got == lines


def test_paths_over_many_buckets(spark):
    """The closed form is the fold, with buckets of a few rows too."""
    rng = random.Random(3)
    old = chunking.BUCKET
    data, want = [], {}
    heads = [rng.choice(["", "", "（一）丙", "1.丁", "2.己", "一、甲"]) if i > 60 else rng.choice(["", "（一）丙", "1.丁", "2.己"]) for i in range(150)]
    for i, (h, p) in enumerate(zip(heads, path_by_hand(heads, ("一、",)))):
        want[i] = p
        data.append((i, "s", i, h))
    df = spark.createDataFrame(data, "block_id bigint, source string, block_seq int, section string")
    try:
        chunking.BUCKET = 4
        assert {r["block_id"]: r["path"] for r in chunking.section_paths(df).collect()} == want
    finally:
        chunking.BUCKET = old
