"""Files of every supported kind, an index that grows, and a folder that is watched."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators.chunking import merge_chunks
from quire.operators.index import append, missing_lines
from quire.plans import ingest
from quire.sources import formats
from quire.sources.listing import list_files, load_pages
from quire.streaming import landing

W = 'xmlns:w="http://x/w"'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


DOCX = archive(**{
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>第一章 总则</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
})
PPTX = archive(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<s xmlns:a="u"><a:p><a:r><a:t>one</a:t></a:r></a:p></s>', "ppt/slides/slide2.xml": "<s/>", "ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="u"><a:p><a:r><a:t>note</a:t></a:r></a:p></s>'})
XLSX = archive(**{
    "xl/workbook.xml": '<w xmlns:r="rel"><sheets><sheet name="T" r:id="r2"/><sheet name="U" r:id="r1"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>k</t></si></s>",
    "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>',
    "xl/styles.xml": '<s><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></s>',
    "xl/worksheets/sheet2.xml": '<w><sheetData><row r="2"><c t="s"><v>0</v></c><c><v>7</v></c></row><row r="3"><c/></row></sheetData></w>',
    "xl/worksheets/sheet1.xml": '<w><sheetData><row r="1"><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>45292.5</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></w>',
})
HTML = b"<html><body><h1>A &amp; B</h1><p>one<br>two</p><table><tr><td>x</td></tr></table></body></html>"
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello\par " + b"\\" + b"u25968?x" + rb"\'e9}"


def test_readers():
    assert formats.load(".docx", "zip", DOCX)[0]["text"] == "第一章 总则\na | b"
    assert formats.load(".doc", "zip", DOCX)[0]["text"] == "第一章 总则\na | b"
    assert formats.load(".pptx", "zip", PPTX) == [{"text": "one\n备注：note", "slide": 1}]
    assert formats.load(".xlsx", "zip", XLSX) == [
        {"text": "工作表：T\n第2行：k | 7", "section": "工作表：T", "section_path": "T"},
        {"text": "工作表：U\n第1行：2024-01-01 00:00:00 | 2024-01-01 12:00:00 | 45292.5 | True | in", "section": "工作表：U", "section_path": "U"},
    ]
    assert formats.load(".html", "html", HTML)[0]["text"] == "A & B\none\ntwo\nx"
    assert formats.load(".rtf", "rtf", RTF)[0]["text"] == "Hello\n数xé"
    assert formats.load(".csv", "text", " a ,,b\n,\nc,d".encode())[0]["text"] == "a | b\nc | d"
    assert formats.load(".txt", "text", "数据".encode("gb18030"))[0]["text"] == "数据"
    assert formats.load(".txt", "text", "数据".encode("utf-8-sig"))[0]["text"] == "数据"


def fill(root):
    (root / "01国家政策").mkdir(parents=True)
    (root / "01国家政策" / "a.docx").write_bytes(DOCX)
    (root / "b.doc").write_bytes(HTML)
    (root / "bad.xlsx").write_bytes(b"PK\x03\x04nothing")
    (root / "~$lock.docx").write_bytes(b"")
    (root / "c.unknown").write_bytes(b"x")


def test_pages_and_rows(spark, tmp_path):
    root, index = tmp_path / "in", str(tmp_path / "index")
    fill(root)
    pages = load_pages(list_files(spark, str(root)))
    got = {r["source"]: r for r in pages.collect()}
    assert set(got) == {"a.docx", "b.doc", "bad.xlsx"}
    assert got["a.docx"]["tier"] == "国家政策" and got["b.doc"]["tier"] == ""
    assert got["b.doc"]["text"].startswith("A & B") and got["bad.xlsx"]["error"] and got["bad.xlsx"]["text"] is None
    assert append(pages, index) == 3 and append(pages, index) == 0
    (root / "d.txt").write_text("new")
    assert append(load_pages(list_files(spark, str(root))), index) == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "none"))


def test_ingest_adds_what_is_new(spark, tmp_path, monkeypatch):
    root, index = tmp_path / "in", str(tmp_path / "index")
    fill(root)
    opened = []
    add = ingest.add_files
    monkeypatch.setattr(ingest, "add_files", lambda files, *a: opened.append({r["source"] for r in files.select("source").collect()}) or add(files, *a))
    with pytest.raises(FileNotFoundError):
        ingest.indexed(spark, index)
    assert ingest.ingest(spark, str(root), index) == 2
    chunks = {r["source"]: r for r in ingest.indexed(spark, index).collect()}
    assert chunks["a.docx"]["tier"] == "国家政策" and chunks["a.docx"]["section"] == "第一章 总则" and chunks["a.docx"]["text"] == "【来源：a.docx】\n第一章 总则\na | b"
    (root / "02省级政策").mkdir()
    (root / "02省级政策" / "n[1].md").write_text("一、甲\n正文\n（一）乙\n正文二")
    (root / "bad.xlsx").write_bytes(XLSX)
    assert ingest.ingest(spark, str(root), index) == 2 + 2  # a file that failed is tried again
    assert opened == [{"a.docx", "b.doc", "bad.xlsx"}, {"n[1].md", "bad.xlsx"}]
    got = [(r["section"], r["path"]) for r in ingest.indexed(spark, index).filter("source = 'n[1].md'").orderBy("segment").collect()]
    assert got == [("一、甲", "一、甲"), ("（一）乙", "一、甲 > （一）乙")]
    assert ingest.ingest(spark, str(root), index) == 0
    assert ingest.ingest(spark, str(root), index, rebuild=True) == 6 and ingest.indexed(spark, index).count() == 6
    assert spark.read.parquet(f"{index}/chunks").select("block_id").distinct().count() == 6


def test_watched_folder(spark, tmp_path):
    root, index, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    fill(root)
    for more, rows in ((None, 2), ("e.md", 3), (None, 3)):
        if more:
            (root / "01国家政策" / more).write_text("x")
        landing.ingest_files(spark, str(root), index, state).awaitTermination()
        assert spark.read.parquet(f"{index}/chunks").count() == rows
    assert {r["tier"] for r in spark.read.parquet(f"{index}/chunks").filter("source = 'e.md'").collect()} == {"国家政策"}
    assert [r["source"] for r in spark.read.parquet(f"{index}/errors").collect()] == ["bad.xlsx"]


def compound(**streams):
    """A compound file with the streams given, all of them in whole sectors."""
    size, sectors, places = 512, [], {}
    for name, body in streams.items():
        body = body.ljust(4096, b"\0")
        places[name] = (len(sectors), len(body))
        sectors += [body[i : i + size].ljust(size, b"\0") for i in range(0, len(body), size)]
    table = [0] * 0
    for start, n in places.values():
        count = -(-n // size)
        table += [start + i + 1 for i in range(count - 1)] + [0xFFFFFFFE]
    entry = lambda name, kind, start, n: (name.encode("utf-16-le").ljust(64, b"\0") + (2 * len(name) + 2).to_bytes(2, "little") + bytes([kind, 1]) + b"\xff" * 12 + b"\0" * 36 + start.to_bytes(4, "little") + n.to_bytes(8, "little"))[:128]
    listed = b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *(entry(k, 2, *v) for k, v in places.items())])
    first = len(sectors)
    chunks = [listed[i : i + size].ljust(size, b"\0") for i in range(0, len(listed), size)]
    sectors += chunks
    table += [first + i + 1 for i in range(len(chunks) - 1)] + [0xFFFFFFFE, 0xFFFFFFFD]
    fat = b"".join(x.to_bytes(4, "little") for x in table).ljust(size, b"\xff")
    head = formats.OLE_START + b"\xa1\xb1\x1a\xe1" + b"\0" * 16 + (62).to_bytes(2, "little") + (3).to_bytes(2, "little") + b"\xfe\xff" + (9).to_bytes(2, "little") + (6).to_bytes(2, "little")
    head = head.ljust(44, b"\0") + (1).to_bytes(4, "little") + first.to_bytes(4, "little") + b"\0" * 4 + (4096).to_bytes(4, "little") + (0xFFFFFFFE).to_bytes(4, "little") + b"\0" * 4 + (0xFFFFFFFE).to_bytes(4, "little") + b"\0" * 4
    head = head.ljust(76, b"\0") + len(sectors).to_bytes(4, "little") + b"\xff" * 432
    return head + b"".join([*sectors, fat])


def test_binary_documents():
    """Pieces of one and of two bytes a character, marks of cells and lines, and binary slides."""
    number = lambda n, size=4: n.to_bytes(size, "little")
    eight, wide = "Résumé 12\x07ok".replace("é", "e").encode(), "数据条例\r第二段 — PAGE 3 —".encode("utf-16-le")
    word = bytearray(b"\0" * 1024 + eight + wide)
    word[10:12] = number(0x200, 2)
    pieces = [(len(eight), (1024 * 2) | 0x40000000), (len(wide) // 2, 1024 + len(eight))]
    plc = b"".join(number(n) for n in (0, pieces[0][0], pieces[0][0] + pieces[1][0])) + b"".join(b"\0\0" + number(fc) + b"\0\0" for _, fc in pieces)
    clx = b"\x01" + number(2, 2) + b"xx" + b"\x02" + number(len(plc)) + plc
    word[0x1A2:0x1AA] = number(16) + number(len(clx))
    data = compound(WordDocument=bytes(word), **{"1Table": b"\0" * 16 + clx})
    got = formats.load(".doc", "ole", data)
    assert got == [{"text": "Resume 12 | ok数据条例\n第二段", "converted_from": ".doc"}]
    slides = compound(**{"PowerPoint Document": b"\x01\0\x02\0" + "标题一二三 abc".encode("utf-16-le") + b"\0\0" + "ab".encode("utf-16-le") + b"\0\0"})
    assert formats.load(".ppt", "ole", slides)[0]["text"] == "标题一二三 abc"
    for bad in (b"\xd0\xcf\x11\xe0", compound(Other=b"x")):
        with pytest.raises(Exception):  # noqa: B017 - any error makes the file's error row
            formats.load(".doc", "ole", bad)


def test_first_bytes(spark):
    from quire.sources.listing import sniff

    cases = {b"\xd0\xcf\x11\xe0x": "ole", b"PK\x03\x04": "zip", b"PK\x05\x06": "zip", b"PK\x01\x02": "text", b" \n{\\RTF1": "rtf", b"\t<BODY>": "html", b"<!DOCTYPE html": "html", b"<meta": "text", b"": "text"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary")
    assert [r[0] for r in df.select(sniff(F.col("c"))).collect()] == list(cases.values())


def test_turn_stream_equals_batch(spark, data, tmp_path):
    turns = spark.read.parquet(f"{data}/turns.parquet").withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    turns.write.parquet(str(tmp_path / "t"))
    stream = landing.turn_activity(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "t")), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("turn_activity").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = landing.turn_activity(turns)
    assert spark.table("turn_activity").agg(F.sum("turns")).first()[0] == batch.agg(F.sum("turns")).first()[0]


def test_audit_finds_lost_lines(spark):
    schema = "block_id bigint, source string, block_seq int, page int, section string, text string"
    blocks = spark.createDataFrame([(1, "s", 0, None, "", "a first line of text\nand a second one"), (2, "s", 1, None, "", "one more line here")], schema)
    assert missing_lines(blocks, merge_chunks(blocks)).count() == 0
    lost = missing_lines(blocks, merge_chunks(blocks.filter("block_id = 1"))).collect()
    assert [r["line"] for r in lost] == ["onemorelinehere"]


def test_rtf_by_code_page():
    text = "数据开放乗条例"
    for page in ("cp936", "cp949"):
        want = text if page == "cp936" else "데이터 개방"
        body = "".join(rf"\'{b:02x}" if b > 127 else "\\\\" if b == 92 else chr(b) for b in want.encode(page))
        assert formats.load_rtf(rf"{{\rtf1\ansi\ansicpg{page[2:]} {body}\par}}".encode("latin-1"))[0]["text"] == want
    assert formats.load_rtf(rb"{\rtf1\ansi\ansicpg1251 \'e4\'e0}")[0]["text"] == "да"
    assert formats.load_rtf(rb"{\rtf1\ansi\'e9\par x}")[0]["text"] == "é\nx"
