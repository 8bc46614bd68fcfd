"""Listing and decoding files: one row a file, an error column instead of exceptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import formats

# Suffixes that have a loader.
SUPPORTED = (".txt", ".md", ".csv", ".html", ".htm", ".rtf", ".docx", ".doc", ".wps", ".pptx", ".ppt", ".xlsx", ".xlsm")

PAGE_COLUMNS = ("source", "path", "tier", "seq", "page", "slide", "section", "section_path", "ocr", "converted_from", "text", "error")
_PAGES = "source string, path string, tier string, seq int, page int, slide int, section string, section_path string, ocr boolean, converted_from string, text string, error string"


def described(files: DataFrame, root: str) -> DataFrame:
    """Supported files among rows of (`path`, ...), with `source`, `suffix` and the `tier` their folder names.

    Office lock files (`~$`) are left out.
    """
    inside = F.regexp_replace(F.col("path"), "^file:/+", "/")
    inside = F.replace(inside, F.lit("/" + root.removeprefix("file:").strip("/") + "/"), F.lit(""))
    rows = files.withColumns({"source": T.basename(F.col("path")), "suffix": T.suffix(F.col("path")), "tier": T.tier_from_path(inside)})
    return rows.filter(F.col("suffix").isin(*SUPPORTED) & ~F.col("source").startswith("~$"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(`path`, `source`, `suffix`, `tier`, `length`, `modified_at`, `content`) of supported files, by path.

    Spark itself passes over names that begin with a dot or an underscore. Content
    is read only where it is used. A folder without supported files raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = described(files, root).select("path", "source", "suffix", "tier", "length", F.col("modificationTime").alias("modified_at"), "content")
    if rows.drop("content").isEmpty():
        raise FileNotFoundError(f"no supported file in {root}; supported are {', '.join(SUPPORTED)}")
    return rows


def sniff(content: Column) -> Column:
    """What a file's first bytes say it is: ole, zip, rtf, html or text."""
    head = F.substring(content, 1, 16)
    low = F.lower(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^[ \t\n\r\x0B\f]+", ""))
    starts = lambda c, words: F.concat_ws("", *[F.when(c.startswith(w), "1") for w in words]) != ""
    return (
        F.when(F.hex(head).startswith(formats.OLE_START.hex().upper()), "ole")
        .when(starts(F.hex(head), [z.hex().upper() for z in formats.ZIP_STARTS]), "zip")
        .when(low.startswith("{\\rtf"), "rtf")
        .when(starts(low, [h.decode() for h in formats.HTML_STARTS]), "html")
        .otherwise("text")
    )


def load_pages(files: DataFrame) -> DataFrame:
    """PAGE_COLUMNS of the pages of files (`path`, `source`, `suffix`, `tier`, `content`).

    Every file is read in a task by the loader of its kind, which its first bytes
    decide where the suffix may lie. A file that cannot be read gives one row with
    its error and no text, so that a bad file stops nothing.
    """
    rows = files.withColumn("kind", sniff(F.col("content"))).select("path", "source", "suffix", "tier", "kind", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, source, suffix, tier, kind, content in p.itertuples(index=False):
                try:
                    pages = formats.load(suffix, kind, bytes(content))
                    out += [(source, path, tier, i, *(g.get(c) for c in ("page", "slide", "section", "section_path", "ocr", "converted_from")), g["text"], None) for i, g in enumerate(pages)]
                except Exception as e:  # noqa: BLE001 - any bad file is reported in its row
                    out.append((source, path, tier, 0, *[None] * 7, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=list(PAGE_COLUMNS)).astype({"page": "Int64", "slide": "Int64"})

    return rows.mapInPandas(run, _PAGES)
