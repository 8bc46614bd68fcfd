"""Text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.config import TOPIC_ENDS, TOPIC_PARTS, WEB_OFFER

SENTENCE_MARKS = "。！？!?；;"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """All white space out."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def bare(c: Column) -> Column:
    """White space and sentence punctuation out, for comparing questions."""
    return F.regexp_replace(squeeze(c), "[，。！？!?、；;]+", "")


def lines(c: Column) -> Column:
    """The lines of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, r"\R"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Pieces between terminators and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, rf"[{SENTENCE_MARKS}\n]+"), strip), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


# Fixed value: the numbering before the name of a tier's folder.
TIER_NUMBER = r"^\s*[0-9]+\s*[-_\x{3000}]?\s*"


def tier_from_path(path: Column) -> Column:
    """Name of the parent folder without its numbering; empty at the root."""
    parent = F.when(F.size(F.split(path, "/")) >= 2, F.element_at(F.split(path, "/"), -2)).otherwise("")
    return F.trim(F.regexp_replace(F.trim(parent), TIER_NUMBER, ""))


# Fixed value: suffixes that a name is compared without; those of images stay.
NAME_SUFFIX = r"(?i)\.(docx?|pptx?|pdf|wps|xlsx?|xlsm?|txt|md|csv)$"


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, NAME_SUFFIX, "")


def quoted_titles(c: Column) -> Column:
    """Titles in book-title quotes."""
    return F.regexp_extract_all(c, F.lit("《([^》]+)》"), F.lit(1))


def without_enumeration(c: Column) -> Column:
    """A leading number and its separator off."""
    return F.regexp_replace(c, r"^\s*(?:[0-9]+|[一二三四五六七八九十]+)[.、)）]\s*", "")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Does the text contain any of the words; null reads as empty."""
    text = F.coalesce(c, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def inline_markup(c: Column) -> Column:
    """Markdown inside a line as tags: code, then bold, then italic; signs of XML escaped first."""
    out = F.regexp_replace(escape_xml(c), "`([^`]+)`", "<code>$1</code>")
    out = F.regexp_replace(out, r"\*\*(.+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(out, r"(?<!\*)\*([^*]+)\*(?!\*)", "<i>$1</i>")


def escape_xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """Entities of HTML decoded, named and numbered ones."""
    return c.map(html.unescape, na_action="ignore")


def clean_html(c: Column) -> Column:
    """Entities decoded, then tags out and white space squeezed to single spaces; null reads as empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " "), r"(?U)\s+", " "))


def line_kind(c: Column) -> Column:
    """Kind of a Markdown line: blank, heading1-3, bullet, numbered or body."""
    level = F.least(F.length(F.regexp_extract(c, r"^(#{1,4})\s", 1)), F.lit(3))
    return (
        F.when(F.trim(c) == "", "blank")
        .when(c.rlike(r"^#{1,4}\s"), F.concat(F.lit("heading"), level.cast("string")))
        .when(c.rlike(r"^\s*[-*•]\s"), "bullet")
        .when(c.rlike(r"^\s*[0-9]+[.、)]\s*"), "numbered")
        .otherwise("body")
    )


def outside_titles(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Ordered literal replacements in what is not between book-title quotes."""
    parts = F.regexp_extract_all(c, F.lit("《[^》]*》|[^《]+|《"), F.lit(0))

    def change(x: Column) -> Column:
        y = x
        for a, b in rules:
            y = F.replace(y, F.lit(a), F.lit(b))
        return F.when(x.startswith("《") & x.endswith("》"), x).otherwise(y)

    return F.array_join(F.transform(parts, change), "")


def cache_key(*parts: Column) -> Column:
    """Twenty hex digits that name a page of a version of a file."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 20)


def reading_order(boxes: Column) -> Column:
    """Text of recognised boxes (struct y, x, text) from top to bottom, left to right."""
    return F.array_join(F.transform(F.array_sort(boxes), lambda b: b["text"]), "\n")


def context_label(source: Column, page: Column, tier: Column, section: Column) -> Column:
    """How a piece of context names where it is from."""
    tags = F.filter(F.array(F.coalesce(tier, F.lit("")), F.coalesce(section, F.lit(""))), lambda x: x != "")
    place = F.when(page.isNull(), F.lit("")).otherwise(F.concat(F.lit("（第 "), page.cast("string"), F.lit(" 页）")))
    marks = F.when(F.size(tags) > 0, F.concat(F.lit("【"), F.array_join(tags, "】【"), F.lit("】"))).otherwise("")
    return F.concat(F.lit("[来源: "), F.coalesce(source, F.lit("未知来源")), place, marks, F.lit("]"))


def topic(c: Column) -> Column:
    """What a question is about: its last quoted title, or the longest part of its first sentence.

    White space and marks, the ends that ask and empty particles go first; parts
    lie between prepositions and have two characters at least. Null if none is left;
    of equally long parts the first.
    """
    titles = F.regexp_extract_all(c, F.lit("《([^》]+)》"), F.lit(1))
    first = F.coalesce(F.get(sentences(c), F.lit(0)), F.lit(""))
    cleaned = F.regexp_replace(first, r"(?U)[？?！!。，,.、；;：:\s]+", "")
    cleaned = F.regexp_replace(cleaned, f"({'|'.join(TOPIC_ENDS)})$", "")
    cleaned = F.regexp_replace(cleaned, "^[的是了在]+|[的是了在]+$", "")
    parts = F.filter(F.split(cleaned, "|".join(TOPIC_PARTS)), lambda x: F.length(x) >= 2)
    best = F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.size(titles) > 0, squeeze(F.element_at(titles, -1))).otherwise(F.nullif(best, F.lit("")))


def local_topic(c: Column, referents: str) -> Column:
    """The topic of the last sentence before the first one that refers to something; null without either."""
    start = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("topic"))

    def step(acc: Column, x: Column) -> Column:
        refers = acc["done"] | x.rlike(referents)
        return F.struct(refers.alias("done"), F.when(refers, acc["topic"]).otherwise(F.coalesce(topic(x), acc["topic"])).alias("topic"))

    return F.aggregate(sentences(c), start, step, lambda acc: F.when(acc["done"], acc["topic"]))


def query_lines(c: Column, most: int = 4, longest: int = 80) -> Column:
    """Further queries that a model wrote, a line each: numbering off, none empty or too long, the first few."""
    return F.slice(F.filter(F.transform(F.split(c, r"\R"), lambda x: strip(without_enumeration(x))), lambda x: (x != "") & (F.length(x) <= longest)), 1, most)


def with_offer(answer: Column, offer: str = WEB_OFFER) -> Column:
    """The answer with an offer to search the web after it, once."""
    text = strip(F.coalesce(answer, F.lit("")))
    return F.when(text.contains(offer), text).otherwise(F.concat(text, F.lit(offer)))


def printable_share(c: Column) -> Column:
    """Share of the characters of a text that can be printed, line ends and tabs among them; null for an empty one."""
    return 1 - F.regexp_count(c, F.lit(r"[\p{C}\p{Z}&&[^ \r\n\t]]")) / F.nullif(F.length(c), F.lit(0))


def ideographs(c: Column) -> Column:
    """How many ideographs a text has."""
    return F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}]"))


def tokens(c: Column) -> Column:
    """Words of Latin letters and digits in lower case, and pairs of neighbouring ideographs.

    An ideograph that stands alone is a token; a pair says more than either sign
    of it, and no pair stands in as many texts as the common signs do.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+|[\x{4E00}-\x{9FFF}]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when((F.length(r) == 1) | r.rlike("^[a-z0-9]"), F.array(r)).otherwise(pairs(r))))
