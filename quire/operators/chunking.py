"""From delivered blocks to chunks: deduplication, headings, section paths, merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.functions import text as T
from quire.functions.prefix import running_last, running_sum

#: Block numbers that one bucket of a running sum spans.
BUCKET = 4096


def current_blocks(blocks: DataFrame) -> DataFrame:
    """Each delivered block once: the first delivery of (source, block_seq, text) wins."""
    key = ["source", "block_seq", "text"]
    first = blocks.groupBy(*key).agg(F.min("block_id").alias("block_id"))
    return blocks.join(first.select("block_id"), "block_id", "left_semi")


def heading_lines(texts: DataFrame, id_col: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`id`, `line_no`, `line`, `is_heading`, `is_top`): trimmed non-blank lines of a text column."""
    rows = texts.select(F.col(id_col), F.posexplode(T.lines(F.col("text"))).alias("p", "line"))
    return rows.select(id_col, (F.col("p") + 1).alias("line_no"), "line", F.col("line").rlike(config.heading).alias("is_heading"), F.col("line").rlike(config.top_heading).alias("is_top"))


def assembled(texts: DataFrame, id_col: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`id`, `block_no`, `section`, `text`): a heading begins a block, other lines join the current one."""
    rows = heading_lines(texts, id_col, config)
    order = W.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("block_no", F.sum(F.col("is_heading").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line", "is_heading")))
    out = rows.groupBy(id_col, "block_no").agg(parts.alias("p"))
    head = F.when(F.col("p")[0]["is_heading"], F.substring(F.col("p")[0]["line"], 1, 80)).otherwise("")
    return out.select(id_col, "block_no", head.alias("section"), F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def heading_paths(rows: DataFrame, order: list[str], bucket: Column, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Adds `path` to rows of (`source`, `order...`, `heading`, `seed`): the headings above each row, in closed form.

    A chapter heading, or a `seed` path that a page brings with it, begins a new
    path. Headings below it fill the path up to its second level and then replace
    the third. Rows with no heading have an empty or null `heading`.

    Chapters come from a bucketed running count, their first headings from sums
    and the last heading from a bucketed running last, so neither a source nor a
    chapter is ever gathered in one task, whatever its size.
    """
    top, at = F.coalesce(F.col("heading"), F.lit("")).rlike(config.top_heading), F.struct(*order)
    rows = rows.withColumns({"_base": F.when(top, F.array("heading")).otherwise(F.col("seed")), "_at": at})
    rows = rows.withColumn("_sub", F.when((F.coalesce(F.col("heading"), F.lit("")) != "") & ~top, F.col("heading")))
    rows = rows.withColumn("_new", F.col("_base").isNotNull().cast("int"))
    rows = running_sum(rows, ["source"], order, bucket, "_new", "_g")
    rows = rows.withColumn("_seen", F.when(F.col("_sub").isNotNull(), F.struct("_g", "_at", F.col("_sub").alias("h"))))
    rows = running_last(rows, ["source"], order, bucket, "_seen", "_last")
    key = ["source", "_g"]
    first = rows.groupBy(*key).agg(F.first("_base", True).alias("_base"), F.min(F.when(F.col("_sub").isNotNull(), F.struct("_at", F.col("_sub").alias("h")))).alias("_s1"))
    subs = rows.filter("_sub IS NOT NULL").select(*key, "_at", F.col("_sub").alias("h"))
    second = subs.join(first.select(*key, "_s1"), key).filter(F.col("_at") > F.col("_s1._at")).groupBy(*key).agg(F.min(F.struct("_at", "h")).alias("_s2"))
    rows = rows.drop("_base").join(first, key, "left").join(second, key, "left")
    base, none = F.coalesce("_base", F.array().cast("array<string>")), F.lit(None).cast("string")
    one, two = F.col("_at") >= F.col("_s1._at"), F.coalesce(F.col("_at") >= F.col("_s2._at"), F.lit(False))
    three = two & (F.col("_last._at") > F.col("_s2._at"))
    last = F.col("_last.h")
    under = (
        F.when(F.size(base) >= 2, F.concat(F.slice(base, 1, 2), F.array(last)))
        .when(F.size(base) == 1, F.concat(base, F.array("_s1.h", F.when(two, last).otherwise(none))))
        .otherwise(F.array(F.col("_s1.h"), F.when(two, F.col("_s2.h")).otherwise(none), F.when(three, last).otherwise(none)))
    )
    path = F.array_join(F.array_compact(F.when(F.coalesce(one, F.lit(False)), under).otherwise(base)), " > ")
    return rows.withColumn("path", path).drop("_base", "_at", "_sub", "_new", "_g", "_seen", "_last", "_s1", "_s2")


def section_paths(blocks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`block_id`, `path`): the headings above each block, whose own heading is its `section`."""
    rows = blocks.select("block_id", "source", "block_seq", F.coalesce(F.trim("section"), F.lit("")).alias("heading"), F.lit(None).cast("array<string>").alias("seed"))
    return heading_paths(rows, ["block_seq", "block_id"], F.floor(F.col("block_seq") / BUCKET), config).select("block_id", "path")


#: What pages know of their file beside text and headings; chunks take it from their first block.
CARRIED = ("tier", "slide", "ocr", "converted_from")


def page_blocks(pages: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`source`, `seq`, `block_no`, `page`, `section`, `path`, `text`, CARRIED): blocks of the pages of files.

    `pages` has `source`, `seq` (order of pages in the file), `page`, `section` and
    `section_path` (both may be null), `text` and CARRIED. A heading begins a block
    and names it, in at most 80 characters; lines before any heading of a page are
    a block under the page's own section. The path goes on from page to page.
    Blank lines and pages without text give no blocks; a null source is one source.
    """
    own = ["source", "seq"]
    pages = pages.withColumn("source", F.coalesce("source", F.lit("")))
    rows = pages.select(*own, F.posexplode(T.lines(F.col("text"))).alias("at", "line")).withColumn("head", F.col("line").rlike(config.heading))
    rows = rows.withColumn("block_no", F.sum(F.col("head").cast("int")).over(W.partitionBy(*own).orderBy("at")))
    parts = F.sort_array(F.collect_list(F.struct("at", "line", "head")))
    rows = rows.groupBy(*own, "block_no").agg(parts.alias("p"))
    rows = rows.withColumn("heading", F.when(F.col("p")[0]["head"], F.substring(F.col("p")[0]["line"], 1, 80)))
    rows = rows.withColumn("text", F.array_join(F.transform("p", lambda x: x["line"]), "\n")).drop("p")
    rows = rows.join(pages.select(*own, "page", F.trim("section").alias("_section"), "section_path", *CARRIED), own)
    first = F.row_number().over(W.partitionBy(*own).orderBy("block_no")) == 1
    parts = F.filter(F.transform(F.split(F.col("section_path"), ">"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("_first", first).withColumn("seed", F.when(F.col("_first") & (F.size(parts) > 0), parts))
    rows = heading_paths(rows, ["seq", "block_no"], F.struct("seq", F.floor(F.col("block_no") / BUCKET)), config)
    section = F.coalesce("heading", "_section", F.lit(""))
    return rows.select(*own, "block_no", "page", section.alias("section"), "path", "text", *CARRIED)


def chunks_of(pages: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Pages of files to chunks: structure, paths, splitting and merging (see `page_blocks`, `merge_chunks`)."""
    return merge_chunks(page_blocks(pages, config), config, ("seq", "block_no"), F.struct("seq", F.floor(F.col("block_no") / BUCKET)), ("path", *CARRIED))


def split_oversized(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n", "。", "；", "，", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that is there.

    A separator stays at the start of the piece after it; small pieces are put
    together again up to the size, with up to `overlap` characters repeated.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if sep:
        first, *more = text.split(sep)
        parts = [p for p in [first, *(sep + m for m in more)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append("".join(held))
                held, length = [], 0
            out += split_oversized(part, size, overlap, rest or ("",))
            continue
        if held and length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held))
    return [p for p in map(str.strip, out) if p]


class _Fold:
    """The greedy buffer of one segment; blocks arrive in order and none is kept longer than it must."""

    def __init__(self, source: str | None, size: int, overlap: int):
        self.source, self.size, self.overlap = source, size, overlap
        self.items: list[tuple[str, str, str | None]] = []
        self.first: tuple = ()
        self.length = self.seq = 0

    def flush(self, keep: bool) -> Iterator[tuple]:
        """What is held as a chunk; with `keep` its last blocks go into the next one."""
        section = next((s for _, s, _ in self.items if s), "")
        path = next((p for *_, p in self.items if p), "")
        text = "\n".join(t for t, *_ in self.items).strip()
        if text:
            yield self.seq, section, path, f"【来源：{self.source}】\n{text}" if self.source else text, self.first
            self.seq += 1
        kept, total = [], 0
        for item in reversed(self.items if keep else []):
            if total + len(item[0]) > self.overlap:
                break
            kept.insert(0, item)
            total += len(item[0])
        self.items, self.length = kept, total

    def add(self, section: str, path: str | None, text: str, own: tuple) -> Iterator[tuple]:
        if section and self.items:
            yield from self.flush(False)
        whole = len(text) <= self.size
        if whole and self.items and self.length + len(text) > self.size:
            yield from self.flush(True)
        for part in [text] if whole else split_oversized(text, self.size, self.overlap):
            if not self.items:
                self.first = own
            self.items.append((part, section, path))
            self.length += len(part)
            if self.length >= self.size:
                yield from self.flush(True)


def merge_chunks(blocks: DataFrame, config: EngineConfig = DEFAULTS, order: tuple[str, ...] = ("block_seq", "block_id"), bucket: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(`source`, `segment`, `chunk_seq`, `page`, `section`, `text`, carried): blocks merged greedily.

    A block with a section begins a segment, and the buffer is empty there, so
    segments fold independently. Tasks stream their sorted rows through the fold:
    no group is ever collected, whatever its size. `path` is the first one of a
    chunk's blocks; the page and all other `carried` columns are its first block's.
    """
    size, overlap = config.chunk_size, config.chunk_overlap
    others = [c for c in carried if c != "path"]
    path = F.col("path") if "path" in carried else F.lit(None).cast("string")
    rows = blocks.filter("text IS NOT NULL AND trim(text) <> ''").select(*order, "source", "page", F.coalesce(F.trim("section"), F.lit("")).alias("section"), path.alias("path"), "text", *others)
    rows = rows.withColumn("starts", (F.col("section") != "").cast("int"))
    bucket = F.floor(F.col(order[0]) / BUCKET) if bucket is None else bucket
    rows = running_sum(rows, ["source"], list(order), bucket, "starts", "segment")
    rows = rows.repartition("source", "segment").sortWithinPartitions("source", "segment", *order)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = ["source", "segment", "chunk_seq", "page", "section", "path", "text", *others]

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, schema = _Fold(None, size, overlap), None, None
        for batch in parts:
            out: list[tuple] = []
            schema = schema or pa.schema([(c, pa.int64() if c == "segment" else pa.int32() if c == "chunk_seq" else batch.schema.field(c).type) for c in columns])
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            own = list(zip(get("page"), *[get(c) for c in others]))
            for source, segment, section, path, text, first in zip(get("source"), get("segment"), get("section"), get("path"), get("text"), own):
                if (source, segment) != key:
                    out += [(*(key or ()), *x) for x in state.flush(False)]
                    state, key = _Fold(source, size, overlap), (source, segment)
                out += [(*key, *x) for x in state.add(section, path, text, first)]
            yield _batch(out, schema)
        if key:
            yield _batch([(*key, *x) for x in state.flush(False)], schema)

    schema = ", ".join(f"{c} {'bigint' if c == 'segment' else 'int' if c == 'chunk_seq' else types[c]}" for c in columns)
    out = rows.select("source", "segment", "page", "section", "path", "text", *others).mapInArrow(fold, schema)
    return out if "path" in carried else out.drop("path")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Chunks (source, segment, seq, section, path, text, (page, others...)) as a batch."""
    flat = [(s, g, n, own[0], section, path, text, *own[1:]) for s, g, n, section, path, text, own in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], f.type) for i, f in enumerate(schema)], schema=schema)
