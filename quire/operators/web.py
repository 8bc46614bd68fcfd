"""Captured results of web searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.functions import text as T


# How pages of results mark a result, its link and title, and its snippet (none where a page has none).
PAGES = {
    "listed": (r'(?s)<li class="b_algo".*?</li>', r'(?s)<h2[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', r"(?s)<p[^>]*>(.*?)</p>"),
    "headed": (r"(?s)<h3[^>]*>\s*<a[^>]+href=\"[^\"]+\"[^>]*>.*?</a>", r'(?s)<h3[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', None),
    "boxed": (r'(?s)<div[^>]*class="[^"]*c-container[^"]*"[^>]*>.*?(?=<div[^>]*class="[^"]*c-container|</body>)', r'(?s)<h3[^>]*>.*?<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', r'(?s)<span[^>]*class="[^"]*content-right[^"]*"[^>]*>(.*?)</span>'),
}
_FEED = "channel struct<item: array<struct<title: string, link: string, description: string>>>"


def _result(anchor: str, snippet: str | None) -> Callable[[Column], Column]:
    def parts(block: Column) -> Column:
        text = F.regexp_extract(block, snippet, 1) if snippet else F.lit("")
        return F.struct(F.regexp_extract(block, anchor, 2).alias("title"), F.regexp_extract(block, anchor, 1).alias("url"), text.alias("snippet"))

    return parts


def parsed(captured: DataFrame) -> DataFrame:
    """(`query_text`, `engine`, `result_rank`, `title`, `url`, `snippet`) of captured answers of search engines.

    `captured` has `query_text`, `engine`, `kind` (`rss` or one of PAGES) and
    `payload`. Only results with a title and an http(s) link count, in the order
    of the page; a payload that is null, broken or of another kind gives none.
    """
    feed = F.from_xml(F.when(F.col("kind") == "rss", F.col("payload")), _FEED, {"mode": "PERMISSIVE"})
    items = F.transform(F.coalesce(feed["channel"]["item"], F.array().cast("array<struct<title: string, link: string, description: string>>")), lambda r: F.struct(r["title"].alias("title"), r["link"].alias("url"), r["description"].alias("snippet")))
    for kind, (block, anchor, snippet) in PAGES.items():
        blocks = F.regexp_extract_all(F.coalesce("payload", F.lit("")), F.lit(block), F.lit(0))
        items = F.when(F.col("kind") == kind, F.transform(blocks, _result(anchor, snippet))).otherwise(items)
    rows = captured.select("query_text", "engine", F.posexplode(items).alias("at", "r"))
    rows = rows.select("query_text", "engine", "at", T.clean_html(F.col("r.title")).alias("title"), T.strip(T.unescape(F.col("r.url"))).alias("url"), T.clean_html(F.col("r.snippet")).alias("snippet"))
    rows = rows.filter((F.col("title") != "") & F.col("url").rlike("^https?://"))
    return rows.select("query_text", "engine", (F.col("at") + 1).alias("result_rank"), "title", "url", "snippet")


def merged(results: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`query_text`, `position`, `title`, `url`, `snippet`): engines in order, unioned.

    Only http(s) links with a title; a page (url and title) keeps its first place;
    every query is cut off at `web_results`.
    """
    rank = F.lit(len(config.engines))
    for i, e in reversed(list(enumerate(config.engines))):
        rank = F.when(F.col("engine") == e, i).otherwise(rank)
    rows = results.withColumns({"title": T.clean_html(F.col("title")), "snippet": T.clean_html(F.col("snippet"))}).filter(F.col("url").rlike("^https?://") & (F.col("title") != "") & F.col("query_text").isNotNull())
    first = rows.groupBy("query_text", "url", "title").agg(F.min(F.struct(rank.alias("e"), "result_rank", "result_id", "snippet")).alias("m"))
    order = W.partitionBy("query_text").orderBy("m.e", "m.result_rank", "m.result_id")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= config.web_results).select("query_text", "position", "title", "url", F.col("m.snippet").alias("snippet"))
