"""Noise that scanning leaves in text: furniture, cut words, wrong characters (problem 1).

Method
------
* Furniture: lines at the head and foot of pages are paired with those of the
  pages around them; a line-pair classifier (boosted trees over likeness,
  numbers and place) tells running lines. Printed page numbers are lines that
  hold a number and keep their distance from the page's own number.
* Cut words: a line that ends in a mark and the line after it are classified by
  how often the joined and the hyphenated word stand in the corpus.
* Wrong characters: words, and characters of scripts without spaces in their
  context, that the clean corpus does not have are joined with its vocabulary
  on q-grams (an inverted join); boosted trees rank the candidates, and the best
  one replaces the word if it is likelier right than not. The ranker is trained
  on clean words corrupted with the substitutions that the corpus shows.

Models are fitted on bounded samples (`SAMPLE`, `PAIRS`); counts, candidates and
decisions cover all rows.

Defined results
---------------
* blocks that are not recognised, and null or empty texts, have no noise;
* a missing page number counts as one page for the source;
* blocks delivered several times are judged once and named each;
* a null source is one source; extra columns are carried through `repair`.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.boosting import Boosted
from quire.llm.common import PART_ROWS, bounded_sample
from quire.session import cut

#: Rows of the samples that models and the list of well-known tokens come from,
#: substitutions learned, and synthetic tokens trained on.
SAMPLE, PAIRS, TRAINED = 4000, 300, 3000
#: Share of the most frequent substitution's evidence below which one is not taught.
CHANCE = 0.02
#: A clean token that stands so often needs no judging; one below is in doubt.
KNOWN, DOUBT = 3, 3
#: Trigrams by which a word in doubt meets the vocabulary.
RARE = 9
#: Lines at either end of a page that may be furniture; pages around it that it is looked for in.
EDGE, AROUND = 2, 4
#: Pages by which lines of neighbouring pages meet, in works with at most so many blocks a page.
RUN, CROWD = 16, 16
#: Distinct tokens that a task counts before it passes them on.
HELD = 200_000

# Marks that part a word at a line end; digits and their look-alikes.
CUT_MARKS = "-‐‑­¬"
DIGIT_LIKE = str.maketrans("OoIlSsZzBbg", "00115522869")

# Shapes that recognition takes for one another, levelled in this order.
ALIKE = (("m", "rn"), ("u", "ii"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("b", "li"), ("é", "c"), ("6", "c"), ("e", "c"), ("q", "g"), ("0", "o"), ("5", "s"), ("1", "i"), ("l", "i"), ("r", "i"), ("f", "i"), ("t", "i"))

_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ0-9]+")
_HYPHENED = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]+(?:[-‐][A-Za-zÀ-ɏЀ-ӿ]+)+")
_HAN = re.compile(r"[㐀-鿿]")
_NUMBER = re.compile(r"(?<![^\W\d_])[0-9OoIlSsZzBb]*[0-9][0-9OoIlSsZzBb]*(?![^\W\d_])")
#: Ends of sentences and numbered headings are no running lines.
NOT_RUNNING = "[。；！？!?,，、]$|\\p{Ll}[.]$|^[（(][一二三四五六七八九十\\d]+[）)]|^第\\S{1,6}[章条节]|^\\d+[.、]\\s?\\D|^[一二三四五六七八九十]+、"
_TRIM = r"[\s\-–—―·•.\[\]()（）|*_~=:]*"
_PAGE = re.compile(
    rf"^{_TRIM}(?:第|p[aà]?[gq]?[ec]?\.?|seite|s\.|стр\.?|ページ|쪽)?{_TRIM}([0-9OoIlSsZzBb]{{1,4}}|[ivxlcIVXLC]{{1,6}})\s*(?:页|頁|ページ|쪽)?\s*(?:(?:共|of|o[ft]|/|von|de|sur|из)\s*[0-9OoIlSsZzBb]{{1,5}}\s*(?:页|頁)?)?{_TRIM}$",
    re.I,
)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def page_number(line: str) -> tuple[int, str] | None:
    """The number a line prints and the form around it, if it prints nothing else."""
    s = unicodedata.normalize("NFKC", line.strip())
    m = _PAGE.match(s)
    if not m or "%" in s:
        return None
    token = m.group(1)
    bare = "bare" if s.rstrip(".,，。") == token else "dressed"
    if any(c.isdigit() for c in token) or (bare == "dressed" and set(token) <= set("OoIlSsZzBb") and not set(token.lower()) <= set("ivxlc")):
        digits = token.translate(DIGIT_LIKE)
        return (int(digits), bare) if digits.isdigit() else None
    low = token.lower()
    if not set(low) <= set(_ROMAN):
        return None
    v = 0
    for a, b in zip(low, low[1:] + " "):
        x = _ROMAN[a]
        v += -x if _ROMAN.get(b, 0) > x else x
    return (v, "roman") if _roman(v) == low else None


def _roman(v: int) -> str:
    out = ""
    for n, r in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while v >= n:
            out, v = out + r, v - n
    return out


def _levelled() -> dict[int, str]:
    """Each character as ALIKE leaves it; signs and spaces between words go."""
    out = {ord(c): "" for c in " \t\r\x0b\x0c\u00a0\u2002\u2003\u2009\u3000·.-–—|"}
    for a, _ in ALIKE:
        x = a
        for b, c in ALIKE:
            x = x.replace(b, c)
        out[ord(a)] = x
    return out


_LEVELLED = _levelled()


def running_key(line: str) -> str:
    """What a running line keeps from page to page: no numbers, case, spaces or dots."""
    s = line if line.isascii() else unicodedata.normalize("NFKC", line)
    if _DIGIT.search(s):
        s = _NUMBER.sub("", s)
    return s.casefold().translate(_LEVELLED)


def running_keys(lines: list[str]) -> list[str]:
    """`running_key` of lines without line ends, levelled all at once."""
    kept = (line if line.isascii() else unicodedata.normalize("NFKC", line) for line in lines)
    text = "\n".join([_NUMBER.sub("", s) if _DIGIT.search(s) else s for s in kept]).casefold()
    for c, to in _LEVELLED.items():  # what a character becomes is not levelled again
        text = text.replace(chr(c), to)
    return text.split("\n") if lines else []


def _bigrams(key: str) -> Counter:
    return Counter(map(str.__add__, key, key[1:]))


def _dice(x: Counter, y: Counter, n: int) -> float:
    if len(x) > len(y):
        x, y = y, x
    return 2 * sum([min(k, y[g]) for g, k in x.items() if g in y]) / n if n > 0 else 0.0


def likeness(a: str, b: str) -> float:
    """Dice likeness of the character pairs of two keys."""
    if a == b:
        return 1.0
    return _dice(_bigrams(a), _bigrams(b), max(len(a) - 1, 0) + max(len(b) - 1, 0))


def likenesses(left: list[str], right: list[str]) -> np.ndarray:
    """`likeness` of many pairs of keys; equal keys are taken apart once, equal pairs judged once."""
    grams: dict[str, Counter] = {}
    known: dict[tuple[str, str], float] = {}
    out = np.ones(len(left))
    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            continue
        pair = (a, b) if a < b else (b, a)
        like = known.get(pair)
        if like is None:
            for s in pair:
                if s not in grams:
                    grams[s] = _bigrams(s)
            like = known[pair] = _dice(grams[a], grams[b], max(len(a) - 1, 0) + max(len(b) - 1, 0))
        out[i] = like
    return out


# ---------------------------------------------------------------- furniture


_EDGES = "k1 bigint, k2 int, source string, page int, line_no int, idx int, foot boolean, line string, key string, num int, form string"


def _edges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first non-blank lines of the blocks that begin a page, the last of those that end one."""
    for p in parts:
        of, lines, places = [], [], []
        for row, (text, head, foot) in enumerate(zip(*(p.column(c).to_pylist() for c in ("text", "begins", "ends")))):
            full = [(i + 1, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
            for at, part in ((False, full[:EDGE] if head else []), (True, full[::-1][:EDGE] if foot else [])):
                for idx, (no, line) in enumerate(part):
                    of.append(row)
                    lines.append(line)
                    places.append((no, idx, at))
        nos, idxs, feet = zip(*places) if places else ((), (), ())
        nums, forms = zip(*(page_number(x) or (None, None) for x in lines)) if lines else ((), ())
        rows = pa.array(of, pa.int32())
        own = [p.column(c).take(rows) for c in ("k1", "k2", "source", "page")]
        yield pa.RecordBatch.from_arrays(
            [*own, *(pa.array(v, t) for v, t in ((nos, pa.int32()), (idxs, pa.int32()), (feet, pa.bool_()), (lines, pa.string()), (running_keys(lines), pa.string()), (nums, pa.int32()), (forms, pa.string())))],
            ["k1", "k2", "source", "page", "line_no", "idx", "foot", "line", "key", "num", "form"],
        )


def _count_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of all lines, with how many lines of a batch have them."""
    for p in parts:
        keys = Counter(running_keys([x for t in p.column("text").to_pylist() for x in t.split("\n") if x.strip()]))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.keys(), pa.string()), "n": pa.array(keys.values(), pa.int64())})


def _pair_features(p: pd.DataFrame) -> np.ndarray:
    like = likenesses(p["key"].tolist(), p["key2"].tolist())
    la, lb = (np.fromiter(map(len, p[c]), float, len(p)) for c in ("key", "key2"))
    return np.column_stack([like, np.minimum(la, lb), np.abs(la - lb), p["idx"], p["idx2"], p["idx"] == p["idx2"], p["gap"].abs(), p["size"], p["spread"], p["share"]]).astype(float)


def page_lines(scans: DataFrame) -> DataFrame:
    """Edge lines of pages: (`k1`, `k2`, `source`, `page`, `line_no`, `idx`, `foot`, `line`, `key`, `num`, `form`)."""
    ends = scans.groupBy("source", "page").agg(F.min("block_seq").alias("lo"), F.max("block_seq").alias("hi"))
    rows = scans.join(ends, ["source", "page"]).filter("block_seq = lo OR block_seq = hi")
    return rows.select("k1", "k2", "source", "page", "text", F.expr("block_seq = lo").alias("begins"), F.expr("block_seq = hi").alias("ends")).mapInArrow(_edges, _EDGES)


def around(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with those of `other` (`s2`, `page2`, `foot2`, `width2`) that stand at the same end, up to AROUND pages away.

    They meet by runs of `width` pages, which is far fewer rows than one for each
    distance. Where many blocks share a page a run is one page, and a page does not
    meet itself, so that no more meet than are paired.
    """
    runs = F.expr(f"sequence(floor((page2 - {AROUND}L) / width2), floor((page2 + {AROUND}L) / width2))")
    met = other.withColumn("run2", F.explode(runs)).filter("width2 > 1 OR run2 <> page2")
    on = f"source = s2 AND run = run2 AND foot = foot2 AND abs(page2 - CAST(page AS BIGINT)) BETWEEN 1 AND {AROUND}"
    return rows.withColumn("run", F.expr("floor(CAST(page AS BIGINT) / width)")).hint("merge").join(met, F.expr(on), how).drop("run", "run2")


def furniture(scans: DataFrame) -> DataFrame:
    """(`k1`, `k2`, `line_no`, `noise`) of running lines and page numbers."""
    edges = cut(page_lines(scans))
    first = scans.groupBy("source", "page").agg(F.count("*").alias("n")).groupBy("source").agg(F.min("page").alias("first_page"), F.count("*").alias("pages"), F.max("n").alias("n"))
    first = cut(first.select("source", "first_page", "pages", F.when(F.col("n") <= CROWD, RUN).otherwise(1).alias("width")))
    nums = cut(printed_numbers(edges, first))
    # running lines
    texts = edges.filter("num IS NULL AND length(key) >= 3").filter(~F.col("line").rlike(NOT_RUNNING))
    texts = texts.select("k1", "k2", "source", "page", "line_no", "idx", "foot", "key", F.length("line").alias("size"))
    pages = texts.groupBy("source", "key", "page").agg(F.count("*").alias("edge"), F.sum(F.col("foot").cast("int")).alias("feet"))
    shares = pages.groupBy("source", "key").agg(F.count("*").alias("seen"), F.sum("edge").alias("edge"), F.sum("feet").alias("feet"))
    keys = shares.groupBy("key").agg(F.count("*").alias("spread"), F.sum("edge").alias("edge"), F.sum("feet").alias("feet"))
    # what also stands inside pages is no running line, however often it meets an edge
    counted = scans.select("text").mapInArrow(_count_keys, "key string, n long").filter("length(key) >= 3").groupBy("key").agg(F.sum("n").alias("all"))
    keys = keys.join(counted, "key").filter(F.col("all") <= 1.25 * F.col("edge")).select("key", "spread", (F.col("feet") / F.col("edge")).alias("low"))
    texts = texts.join(shares.select("source", "key", "seen"), ["source", "key"]).join(keys, "key").join(first, "source").withColumn("share", F.col("seen") / F.col("pages"))
    texts = cut(texts)
    other = texts.select(F.col("source").alias("s2"), F.col("page").alias("page2"), F.col("foot").alias("foot2"), F.col("width").alias("width2"), F.col("idx").alias("idx2"), F.col("key").alias("key2")).distinct()
    pairs = around(texts, other).withColumn("gap", F.expr("CAST(page2 - CAST(page AS BIGINT) AS INT)"))
    model = scans.sparkSession.sparkContext.broadcast(_fit_pairs(pairs))

    @F.pandas_udf(T.DoubleType())
    def same(p: pd.DataFrame) -> pd.Series:
        return pd.Series(model.value.score(_pair_features(p)))

    chance = same(F.struct("key", "key2", "idx", "idx2", "gap", "size", "spread", "share"))
    repeats = pairs.withColumn("p", chance).filter("p > 0.5").select("k1", "k2", "line_no").distinct()
    columns = ["k1", "k2", "line_no", "first_page", "page", "foot", "low"]
    lone = texts.filter("pages < 3 AND spread >= 8").select(columns)
    many = texts.join(repeats, ["k1", "k2", "line_no"], "left_semi").select(columns)
    # the title where the work begins is none: a line with letters and a number, or the only such line, at the head of the first page
    lines = many.unionByName(lone).filter("page > first_page OR foot OR low > 0.2")
    found = lines.select("k1", "k2", "line_no", F.lit("running_header").alias("noise")).distinct()
    # by merging, here and in `around`: a table read back is many times larger than the files that Spark measures
    return nums.unionByName(found.hint("merge").join(nums.select("k1", "k2", "line_no"), ["k1", "k2", "line_no"], "left_anti"))


_NUMBER_COLUMNS = ["same", "twin", "form", "idx", "foot", "gap", "num", "page", "agree", "pages"]


def _number_features(p: pd.DataFrame) -> np.ndarray:
    num = p["num"].to_numpy(float)
    return np.column_stack([
        p["same"], p["twin"], p["form"] == "dressed", p["form"] == "roman", p["idx"], p["foot"], np.abs(p["gap"]), np.log1p(num), np.log1p(np.abs(num - p["page"].to_numpy(float))), np.minimum(p["agree"], 5), np.log1p(p["pages"].to_numpy(float)),
    ]).astype(float)


def printed_numbers(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(`k1`, `k2`, `line_no`, `noise`) of edge lines that print the page's number.

    Lines that hold a number are paired with those of the pages around them, at the
    same end; a classifier of the pairs judges whether the numbers go with the pages
    (`same`), the form around them and how many pages of the work agree. A line
    without a pair is judged by itself.
    """
    nums = edges.filter("num IS NOT NULL").withColumn("off", F.col("num") - F.col("page").cast("long"))
    kept = nums.groupBy("source", "off", "form").agg(F.countDistinct("page").alias("agree"))
    known = kept.groupBy("source").agg(F.max("agree").alias("most"))
    nums = nums.join(kept, ["source", "off", "form"]).join(first.select("source", "pages", "width"), "source").join(known, "source")
    nums = cut(nums.select("k1", "k2", "line_no", "source", "page", "foot", "idx", "num", "form", "agree", "pages", "most", "width"))
    other = nums.select(F.col("source").alias("s2"), F.col("page").alias("page2"), F.col("foot").alias("foot2"), F.col("width").alias("width2"), F.col("num").alias("num2"), F.col("form").alias("form2")).distinct()
    # a line without a pair is there once, by itself
    gap = F.expr("CAST(coalesce(page2 - CAST(page AS BIGINT), 0) AS INT)")
    met = around(nums, other, "left").withColumn("gap", gap)
    alone = nums.withColumns({"gap": F.lit(0), "same": F.lit(-1), "twin": F.lit(0)})
    pairs = met.withColumns({"same": F.coalesce((F.col("num2") - F.col("num") == F.col("gap")).cast("int"), F.lit(-1)), "twin": F.coalesce((F.col("form") == F.col("form2")).cast("int"), F.lit(0))}).select(alone.columns)
    model = edges.sparkSession.sparkContext.broadcast(_fit_numbers(pairs.filter("gap <> 0").unionByName(alone)))

    @F.pandas_udf(T.DoubleType())
    def prints(p: pd.DataFrame) -> pd.Series:
        return pd.Series(model.value.score(_number_features(p)))

    # a line with pairs is judged by the best of them, one without by itself
    judged = pairs.withColumn("p", prints(F.struct(*_NUMBER_COLUMNS)))
    return judged.filter("p > 0.5").select("k1", "k2", "line_no", F.lit("page_number").alias("noise")).distinct()


def _fit_numbers(pairs: DataFrame) -> Boosted:
    """Numbers in a form of their own, or on which pages agree, are printed; those that
    stand against pages that agree are none. Both are shown to the model alone too.
    """
    label = F.when((F.col("form") == "dressed") | (F.col("agree") >= 3), 1).when((F.col("agree") == 1) & (F.col("most") >= 3), 0)
    rows = pairs.withColumn("label", label).filter("label IS NOT NULL").withColumn("_h", F.xxhash64("k1", "k2", "line_no", "gap")).withColumn("_s", F.concat_ws("|", "label", "form", F.col("same") < 0))
    ties = ("idx", "foot", "same", "twin", "form", "num", "page")
    got = bounded_sample(rows, "_s", "_h", PART_ROWS, ties).select(*_NUMBER_COLUMNS, "label", "_h").toPandas().sort_values(["label", "_h", *ties]).reset_index(drop=True)
    # rules of thumb where a corpus shows too little: a number in a form is printed, a year by itself is not
    thumb = pd.DataFrame([(-1, 0, form, i, foot, 0, n, 1, 1, 1, int(form == "dressed" or n < 1000)) for form in ("bare", "dressed", "roman") for i in (0, 1) for foot in (False, True) for n in (1, 3, 9, 27, 81, 243, 729, 1999, 2023, 9999)], columns=[*_NUMBER_COLUMNS, "label"])
    taught = pd.concat([got.drop(columns="_h"), got.drop(columns="_h").query("same >= 0").assign(same=-1, twin=0, gap=0, agree=1, pages=1).query("label == 1"), thumb], ignore_index=True)
    return Boosted().fit(_number_features(taught), taught["label"].to_numpy(float))


def _fit_pairs(pairs: DataFrame) -> Boosted:
    """Pairs of equal keys that many pages share are one line; keys seen once are none."""
    rows = pairs.withColumn("_h", F.xxhash64("key", "key2", "gap", "line_no", "k1")).filter("(key = key2 AND share >= 0.3 AND seen >= 3) OR (key <> key2 AND seen = 1 AND spread = 1)")
    rows = rows.withColumn("label", (F.col("key") == F.col("key2")).cast("int"))
    # a line of a short page stands at both ends
    ties = ("idx", "idx2", "key", "key2")
    got = bounded_sample(rows, "label", "_h", SAMPLE, ties).select("key", "key2", "idx", "idx2", "gap", "size", "spread", "share", "label", "_h").toPandas()
    if not len(got):
        return Boosted().fit(np.array([[1.0] * 10, [0.0] * 10] * 20), np.array([1.0, 0.0] * 20))
    got = got.sort_values(["label", "_h", *ties]).reset_index(drop=True)
    # likeness decides, not how common the examples are: positives also with characters changed
    rng = random.Random(7)
    noisy = got[got["label"] == 1].copy()
    noisy["key2"] = ["".join(rng.choice("lcqh1o") if c.isalnum() and rng.random() < 0.12 else c for c in k) for k in noisy["key2"]]
    noisy["spread"], noisy["share"] = 1, 0.05
    both = pd.concat([got, noisy], ignore_index=True)
    return Boosted().fit(_pair_features(both), both["label"].to_numpy(float))


# ---------------------------------------------------------------- tokens


def body(text: str, gone: set[int], cuts: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The lines of a text that are no furniture, joined into running text.

    Returns the text and (offset, line number) of where each line begins in it.
    Words cut at a line end are joined without the mark, compounds keep it.
    """
    out, starts, size, before = [], [], 0, 0
    width = max(map(len, text.split("\n")))
    for no, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if not s or no in gone:
            continue
        if out:
            last = out[-1]
            if before in cuts and len(last) > 1:
                out[-1] = last[:-1]
                size -= 1
            elif _HAN.match(last[-1]) or last[-1] in "，、；。（《“" or _HAN.match(s[0]):
                if len(last) < 0.75 * width:  # a heading or the end of a paragraph
                    out.append("\n")
                    size += 1
            elif last[-1] not in CUT_MARKS:
                out.append(" ")
                size += 1
        starts.append((size, no))
        out.append(s)
        size += len(s)
        before = no
    return "".join(out), starts


_LETTER, _DIGIT = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[0-9]")


def _flat(text: str) -> str:
    """Digits as one sign and letters as another, for contexts of ideographs."""
    return _LETTER.sub("A", _DIGIT.sub("0", text))


def tokens_of(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, token, offset, offset of the character in question) of a running text."""
    for m in _WORD.finditer(text):
        a, b = m.span()
        if m.group().isdigit():
            continue
        if (text[b : b + 1] == "-" or text[a - 1 : a] == "-") and any(c.isdigit() for c in m.group()):
            continue  # part of a code
        yield "w", m.group(), a, a
    if not _HAN.search(text):
        return
    padded = f"^{_flat(text)}$"
    for m in _HAN.finditer(text):
        i = m.start()
        token = padded[i : i + 3]
        if "\n" in token:
            token = token[0].replace("\n", "^") + token[1] + token[2].replace("\n", "$")
        if " " not in token and "$" not in token:  # letters set apart, or nothing after
            yield "t", token, i, i


def _levels() -> np.ndarray:
    """Code points as `_flat` writes them, and line ends as zero."""
    out = np.arange(0x110000, dtype=np.int64)
    for c in map(chr, range(0x250)):
        out[ord(c)] = ord(_flat(c))
    out[10] = 0
    return out


_FLAT: list[np.ndarray] = []


def contexts(text: str) -> Counter:
    """How often every ideograph stands between its neighbours; line ends are ^ and $."""
    if not _FLAT:
        _FLAT.append(_levels())
    c = _FLAT[0][np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero((c >= 0x3400) & (c <= 0x9FFF))
    keys, n = np.unique(c[at - 1] << 42 | c[at] << 21 | c[at + 1], return_counts=True)
    left, mid, right = keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF
    return Counter({f"{chr(a) if a else '^'}{chr(b)}{chr(d) if d else '$'}": k for a, b, d, k in zip(left.tolist(), mid.tolist(), right.tolist(), n.tolist())})


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and ideographs in context of a task's texts, with their counts."""
    held = {"w": Counter(), "t": Counter()}

    def passed() -> Iterator[pa.RecordBatch]:
        for kind, found in held.items():
            yield pa.RecordBatch.from_pydict({"kind": pa.repeat(kind, len(found)), "token": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()

    for p in parts:
        text = "\n".join(t for t in p.column("text").to_pylist() if t)
        held["w"].update(_WORD.findall(text))
        held["w"].update(w.lower() for line in text.split("\n") if "-" in line or "‐" in line for w in _HYPHENED.findall(line))
        held["t"].update(contexts(text))
        if sum(map(len, held.values())) > HELD:
            yield from passed()
    yield from passed()


_COUNTED = "kind string, token string, n long"


def counts(blocks: DataFrame) -> DataFrame:
    """(`kind`, `token`, `clean`, `scanned`): how often tokens stand in clean and in recognised text."""
    part = lambda df, name: df.select("text").mapInArrow(_count, _COUNTED).select("kind", "token", F.col("n").alias("n"), F.lit(name).alias("where"))
    both = part(blocks.filter("NOT coalesce(ocr, false)"), "clean").unionByName(part(blocks.filter("ocr"), "scanned"))
    return cut(both.groupBy("kind", "token").agg(F.sum(F.when(F.col("where") == "clean", F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("where") == "scanned", F.col("n")).otherwise(0)).alias("scanned")))


def _is_number(token: str, before: str, after: str) -> str | None:
    """The number that a token of digits and their look-alikes was, if it was one."""
    if not set(token) <= set("0123456789OoIlSsZzBbg") or token.isdigit():
        return None
    near = before[-1:].isdigit() or (before[-1:] in ".," and before[-2:-1].isdigit()) or (after[:1] in ".," and after[1:2].isdigit()) or after[:1] in "年月日条项个万%次家批" or before[-1:] == "第"
    if sum(c.isdigit() for c in token) or (near and len(token) <= 4):
        return token.translate(DIGIT_LIKE)
    return None


def doubtful(scans: DataFrame, gone: DataFrame, cuts: DataFrame, known) -> DataFrame:
    """(`k1`, `k2`, `kind`, `token`, `line_no`, `split`, `line_no2`, `number`) of tokens not well known.

    A token over a line end has the number of characters before it in `split`.
    """
    marks = gone.select("k1", "k2", F.col("line_no").alias("g"), F.lit(None).cast("int").alias("c")).unionByName(cuts.select("k1", "k2", F.lit(None).cast("int").alias("g"), F.col("line_no").alias("c")))
    marks = marks.groupBy("k1", "k2").agg(F.collect_set("g").alias("gone"), F.collect_set("c").alias("cuts"))
    rows = scans.select("k1", "k2", "text").join(marks, ["k1", "k2"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure = known.value
        for p in parts:
            out = []
            for k1, k2, text, g, c in zip(p["k1"], p["k2"], p["text"], p["gone"], p["cuts"]):
                joined, starts = body(text, set(g) if g is not None else set(), set(c) if c is not None else set())
                at = np.array([s for s, _ in starts])
                for kind, token, i, _ in tokens_of(joined):
                    if token in sure:
                        continue
                    row = int(np.searchsorted(at, i, "right")) - 1
                    split, no2 = len(token), starts[row][1]
                    if kind == "w" and row + 1 < len(at) and i + len(token) > at[row + 1]:
                        split, no2 = int(at[row + 1] - i), starts[row + 1][1]
                    number = _is_number(token, joined[max(0, i - 2) : i], joined[i + len(token) : i + len(token) + 2]) if kind == "w" else None
                    out.append((k1, k2, kind, token, starts[row][1], split, no2, number))
            yield pd.DataFrame(out, columns=["k1", "k2", "kind", "token", "line_no", "split", "line_no2", "number"])

    return cut(rows.mapInPandas(run, "k1 bigint, k2 int, kind string, token string, line_no int, split int, line_no2 int, number string"))


def difference(a: str, b: str) -> tuple[int, str, str]:
    """Where two spellings part, and what stands there in each."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i, a[i : len(a) - j], b[i : len(b) - j]


_DIFF = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("was", T.StringType()), T.StructField("is", T.StringType())])


@F.pandas_udf(_DIFF)
def _diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([difference(x, y) for x, y in zip(a, b)], columns=["at", "was", "is"])


def _grams(word: Column) -> Column:
    """The padded character trigrams of a word."""
    padded = F.concat(F.lit("^^"), F.lower(word), F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def candidates(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(`kind`, `token`, `other`, `n_other`, `shared`, `was`, `is`, `at`) by inverted joins on q-grams.

    Characters in context meet the vocabulary on what stands on both sides.
    Words meet it on their RARE rarest trigrams: a wrong character (or two for
    one) spoils at most four, so the right word of a word with two wrong places
    is always among the meetings. What has more than half of its characters in
    another place is no candidate.
    """
    sides = lambda c: F.concat(F.substr(c, F.lit(1), F.lit(1)), F.substr(c, F.lit(3), F.lit(1)))
    chars = (
        tokens.filter("kind = 't'").select("kind", "token", sides(F.col("token")).alias("q"))
        .join(vocabulary.filter("kind = 't'").select(sides(F.col("token")).alias("q"), F.col("token").alias("other"), F.col("n").alias("n_other")).hint("merge"), "q")
        .filter("other <> token").select("kind", "token", "other", "n_other", F.lit(1).alias("shared"))
    )
    words = vocabulary.filter("kind = 'w' AND length(token) >= 2").select(F.col("token").alias("other"), F.col("n").alias("n_other"), F.explode(_grams(F.col("token"))).alias("q"))
    common = words.groupBy("q").agg(F.count("*").alias("df"))
    asked = tokens.filter("kind = 'w' AND length(token) >= 3").select("token", F.explode(_grams(F.col("token"))).alias("q")).hint("merge").join(common, "q")
    rare = asked.withColumn("r", F.row_number().over(W.partitionBy("token").orderBy("df", "q"))).filter(F.col("r") <= RARE).select("token", "q")
    # by merging: what a broadcast would hold is the vocabulary's trigrams, many times the table that Spark measures
    met = rare.join(words.hint("merge"), "q").filter((F.abs(F.length("other") - F.length("token")) <= 2) & (F.col("other") != F.col("token"))).groupBy("token", "other").agg(F.first("n_other").alias("n_other"), F.count("*").alias("shared"))
    met = met.filter((F.levenshtein("token", "other", 3) >= 0) & (2 * F.levenshtein("token", "other", 3) <= F.length("token") + 1)).select(F.lit("w").alias("kind"), "token", "other", "n_other", F.col("shared").cast("int").alias("shared"))
    both = chars.unionByName(met).withColumn("d", _diff("token", "other"))
    return both.select("kind", "token", "other", "n_other", "shared", "d.was", "d.is", "d.at")


def _ranked(p: pd.DataFrame) -> np.ndarray:
    log = lambda c: np.log1p(p[c].to_numpy(float))
    size = p["token"].str.len().to_numpy(float)
    return np.column_stack([
        log("n_other"), log("n_token"), log("n_scanned"), log("pair"), p["pair"] / np.maximum(p["was_pairs"], 1), p["shared"] / np.maximum(size, 1), size, p["was"].str.len(), p["is"].str.len(),
        p["was"].str.contains(r"\d") & ~p["is"].str.contains(r"\d"), log("rivals"), p["kind"] == "w", log("was_clean"), log("pair_n"),
    ]).astype(float)


def misread_tokens(doubt: DataFrame, counted: DataFrame) -> DataFrame:
    """(`kind`, `token`, `other`, `at`): tokens that were recognised wrongly, and what they were."""
    spark = doubt.sparkSession
    vocabulary = counted.withColumn("n", F.col("clean") + F.col("scanned")).filter("clean >= 3 OR scanned >= 12").filter("kind = 't' OR NOT token RLIKE '[0-9]'").select("kind", "token", "n", "clean")
    own = doubt.filter("number IS NULL").select("kind", "token").distinct().join(counted, ["kind", "token"], "left").fillna(0, ["clean", "scanned"]).filter(F.col("clean") < DOUBT)
    own = cut(own.withColumn("truth", F.lit(None).cast("string")))
    met = cut(candidates(own.select("kind", "token"), vocabulary))
    strong = met.join(own.select("kind", "token", "clean", "scanned"), ["kind", "token"]).filter("n_other >= 5 AND clean = 0 AND n_other >= 10 * scanned")
    pairs = cut(strong.groupBy("kind", "was", "is").agg(F.countDistinct("token").alias("pair"), F.sum("scanned").alias("pair_n")))
    wholes = pairs.groupBy("kind", "was").agg(F.sum("pair").alias("was_pairs"))
    top = pairs.filter("was <> '' AND is <> '' AND length(was) <= 3 AND length(is) <= 3 AND lower(was) <> lower(is)").orderBy(F.desc(F.col("pair") * 3 + F.col("pair_n")), "kind", "was", "is").limit(PAIRS).collect()
    # what is seen far less often than the most frequent substitution of its kind is chance, in corpora of any size
    most = {kind: max(q["pair"] * 3 + q["pair_n"] for q in top if q["kind"] == kind) for kind in {q["kind"] for q in top}}
    top = [q for q in top if q["pair"] * 3 + q["pair_n"] >= CHANCE * most[q["kind"]]]
    singles = cut(counted.filter("kind = 't'").groupBy(F.substr("token", F.lit(2), F.lit(1)).alias("was")).agg(F.sum("clean").alias("was_clean")))

    # clean tokens with learned substitutions, and rare clean tokens that are right
    good = vocabulary.filter("clean >= 20").withColumn("_s", F.col("kind"))
    good = bounded_sample(good, "_s", "token", TRAINED).select("kind", "token").collect()
    rare = bounded_sample(counted.filter("clean BETWEEN 1 AND 2").withColumn("_s", F.col("kind")), "_s", "token", TRAINED).select("kind", "token").collect()
    rng = random.Random(20)
    made = {}
    for kind, token in sorted((r["kind"], r["token"]) for r in good):
        fits = [(q["was"], q["is"], q["pair"] + q["pair_n"]) for q in top if q["kind"] == kind and q["is"] in (token if kind == "w" else token[1:2])]
        if fits:
            was, to, _ = rng.choices(fits, [f[2] for f in fits])[0]
            spots = [m.start() for m in re.finditer(re.escape(to), token)] if kind == "w" else [1]
            i = rng.choice(spots)
            made[kind, token[:i] + was + token[i + len(to) :]] = token
    known = {(r["kind"], r["token"]) for r in good}
    synthetic = [(k, t, 0, 1, true) for (k, t), true in sorted(made.items()) if (k, t) not in known] + [(r["kind"], r["token"], 0, 1, r["token"]) for r in sorted(rare)]
    schema = "kind string, token string, clean long, scanned long, truth string"
    lesson = spark.createDataFrame(synthetic, schema)
    met_lesson = candidates(lesson.select("kind", "token").distinct(), vocabulary.join(lesson.select("kind", "token"), ["kind", "token"], "left_anti"))

    def described(found: DataFrame, tokens: DataFrame) -> DataFrame:
        rivals = found.groupBy("kind", "token").agg(F.sum("n_other").alias("rivals"))
        out = found.join(tokens.select("kind", "token", F.col("clean").alias("n_token"), F.col("scanned").alias("n_scanned"), "truth"), ["kind", "token"]).join(rivals, ["kind", "token"])
        out = out.join(pairs, ["kind", "was", "is"], "left").join(wholes, ["kind", "was"], "left").join(singles, "was", "left")
        return out.fillna(0, ["pair", "pair_n", "was_pairs", "was_clean"])

    taught = described(met_lesson, lesson).toPandas()  # bounded by TRAINED
    ranker = Boosted()
    if len(taught):
        taught = taught.sort_values(["kind", "token", "other", "truth"]).reset_index(drop=True)
        ranker.fit(_ranked(taught), (taught["other"] == taught["truth"]).to_numpy(float))
    shared = spark.sparkContext.broadcast(ranker)

    @F.pandas_udf(T.DoubleType())
    def rank(p: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(_ranked(p)))

    columns = ["kind", "token", "n_other", "n_token", "n_scanned", "pair", "pair_n", "was_pairs", "shared", "was", "is", "rivals", "was_clean"]
    scored = described(met, own).filter("n_other >= 5 AND n_other >= 5 * n_token AND n_other >= 3 * (n_token + n_scanned) AND was <> '' AND is <> '' AND pair >= 1 AND length(was) <= 3 AND length(is) <= 3 AND lower(was) <> lower(is)").withColumn("p", rank(F.struct(*columns)))
    # what a token was may be open between a few words; that it was another is their sum
    best = scored.filter("p > 0.1").groupBy("kind", "token").agg(F.max(F.struct("p", "n_other", "other", "at")).alias("b"), F.sum("p").alias("sum")).filter("sum > 0.5")
    return best.select("kind", "token", "b.other", F.when(F.col("kind") == "t", 1).otherwise(F.col("b.at")).alias("at"))


# ---------------------------------------------------------------- cut words


def _line_ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that end in a letter and a mark, with the piece after it."""
    for p in parts:
        out = []
        for k1, k2, text, g in zip(p["k1"], p["k2"], p["text"], p["gone"]):
            gone = set(g) if g is not None else set()
            lines = [(no, x.strip()) for no, x in enumerate(text.split("\n"), 1) if x.strip() and no not in gone]
            for (no, line), (_, after) in zip(lines, [*lines[1:], (0, "")]):
                m = re.search(rf"([^\W\d_][^\W_]*)[{CUT_MARKS}]$", line)
                r = re.match(r"[^\W_]+", after)
                if m and (r and not r.group()[0].isdigit() or not after):
                    out.append((k1, k2, no, m.group(1).lower(), r.group().lower() if r else "", line[-1]))
        yield pd.DataFrame(out, columns=["k1", "k2", "line_no", "left", "right", "mark"])


def _cut_features(p: pd.DataFrame) -> np.ndarray:
    log = lambda c: np.log1p(p[c].to_numpy(float))
    return np.column_stack([log("joined"), log("hyphened"), log("joined") - log("hyphened"), log("n_left"), log("n_right"), p["left"].str.len(), p["right"].str.len(), p["mark"] != "-"]).astype(float)


def cut_words(scans: DataFrame, gone: DataFrame, counted: DataFrame) -> DataFrame:
    """(`k1`, `k2`, `line_no`) of lines that end in the first piece of a cut word."""
    spark = scans.sparkSession
    per = gone.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("gone"))
    rows = scans.select("k1", "k2", "text").filter(F.col("text").rlike(f"[\\p{{L}}\\p{{N}}][{CUT_MARKS}]\\s*(\\n|$)")).join(per, ["k1", "k2"], "left")
    found = cut(rows.mapInPandas(_line_ends, "k1 bigint, k2 int, line_no int, left string, right string, mark string"))
    lower = counted.filter("kind = 'w'").groupBy(F.lower("token").alias("word")).agg(F.sum(F.col("clean") + F.col("scanned")).alias("n"))
    lower = cut(lower)

    def described(cases: DataFrame) -> DataFrame:
        for name, key in (("joined", F.concat("left", "right")), ("hyphened", F.concat("left", F.lit("-"), "right")), ("n_left", F.col("left")), ("n_right", F.col("right"))):
            cases = cases.withColumn("word", key).join(lower.withColumnRenamed("n", name), "word", "left").drop("word")
        return cases.fillna(0, ["joined", "hyphened", "n_left", "n_right"])

    # words cut anywhere against hyphened words cut at their hyphen, from a bounded sample of the vocabulary
    words = bounded_sample(lower.filter("n >= 3 AND length(word) >= 5").withColumn("_s", F.col("word").contains("-")), "_s", "word", TRAINED).select("word").collect()
    rng, lesson = random.Random(3), []
    for w in sorted(r["word"] for r in words):
        if "-" in w:
            a, _, b = w.partition("-")
            if a and b and "-" not in b:
                lesson.append((a, b, "-", 0))
        elif w.isalpha():
            i = rng.randint(2, len(w) - 2)
            lesson.append((w[:i], w[i:], rng.choice(CUT_MARKS), 1))
            j = rng.randrange(i)
            lesson.append((w[:j] + "q" + w[j + 1 : i], w[i:], "-", 1))  # with a wrong character
    taught = described(spark.createDataFrame(lesson or [("a", "b", "-", 0)], "left string, right string, mark string, label int")).toPandas()
    taught = taught.sort_values(["left", "right", "mark", "label"]).reset_index(drop=True)
    shared = spark.sparkContext.broadcast(Boosted().fit(_cut_features(taught), taught["label"].to_numpy(float)))

    @F.pandas_udf(T.DoubleType())
    def chance(p: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(_cut_features(p)))

    cases = described(found.select("left", "right", "mark").distinct())
    cases = cases.withColumn("p", chance(F.struct("left", "right", "mark", "joined", "hyphened", "n_left", "n_right"))).filter("p > 0.5").select("left", "right", "mark")
    return found.join(cases, ["left", "right", "mark"], "left_semi").select("k1", "k2", "line_no")


# ---------------------------------------------------------------- all noise


def recognised(blocks: DataFrame) -> DataFrame:
    """Recognised blocks, each once however often delivered, under the key (`k1`, `k2`)."""
    return (
        blocks.filter("ocr AND text IS NOT NULL AND text <> ''")
        .select(*_keys(), F.coalesce("source", F.lit("\x00")).alias("source"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("block_seq", F.lit(0)).alias("block_seq"), "text")
        .dropDuplicates(["k1", "k2"])
    )


def _keys() -> list[Column]:
    parts = ("source", "page", "block_seq", "text")
    return [F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")]


def noise_parts(blocks: DataFrame) -> dict[str, DataFrame]:
    """Noise of the distinct recognised blocks: `lines` (k1, k2, line_no, noise) and `fixes`."""
    spark = blocks.sparkSession
    scans = cut(recognised(blocks))
    gone = cut(furniture(scans))
    counted = counts(blocks.select("text", "ocr"))
    sure = bounded_sample(blocks.filter("NOT coalesce(ocr, false) AND length(text) > 20").select("text", F.xxhash64("text").alias("_id"), F.lit(1).alias("_s")), "_s", "_id", SAMPLE)
    well = {r["token"] for r in counted.filter(F.col("clean") >= KNOWN).join(sure.select("text").mapInArrow(_count, _COUNTED).select("kind", "token").distinct(), ["kind", "token"], "left_semi").select("token").collect()}
    known = spark.sparkContext.broadcast(well)  # bounded by the sample
    parts = cut(cut_words(scans, gone, counted))
    doubt = doubtful(scans, gone, parts, known)
    fixes = cut(misread_tokens(doubt, counted))
    numbers = doubt.filter("number IS NOT NULL").join(counted.filter(F.col("clean") >= KNOWN).select("kind", "token"), ["kind", "token"], "left_anti")
    hits = doubt.filter("number IS NULL").join(fixes, ["kind", "token"])
    wrong = hits.select("k1", "k2", F.when(F.col("at") < F.col("split"), F.col("line_no")).otherwise(F.col("line_no2")).alias("line_no")).unionByName(numbers.select("k1", "k2", "line_no"))
    lines = gone.unionByName(wrong.distinct().select("k1", "k2", "line_no", F.lit("misread").alias("noise"))).unionByName(parts.select("k1", "k2", "line_no", F.lit("broken_word").alias("noise")))
    return {"scans": scans, "lines": lines, "hits": hits, "numbers": numbers}


def scan_noise(blocks: DataFrame) -> DataFrame:
    """(`block_id`, `line_no`, `noise`): one row a line and kind, for every delivery of a block."""
    lines = noise_parts(blocks)["lines"].distinct()
    copies = blocks.filter("ocr AND text IS NOT NULL AND text <> ''").select("block_id", *_keys())
    return copies.join(lines, ["k1", "k2"]).select("block_id", "line_no", "noise")


def repair(blocks: DataFrame) -> DataFrame:
    """All recognised blocks with `paragraphs`: continuous text without the noise."""
    parts = noise_parts(blocks)
    marks = parts["lines"].groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("noise").isin("running_header", "page_number"), F.col("line_no"))).alias("_q_gone"),
        F.collect_set(F.when(F.col("noise") == "broken_word", F.col("line_no"))).alias("_q_cut"),
    )
    fixes = (
        parts["hits"].select("k1", "k2", "kind", "token", "other").unionByName(parts["numbers"].select("k1", "k2", "kind", "token", F.col("number").alias("other"))).distinct()
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "token", "other")).alias("_q_fix"))
    )

    @F.pandas_udf(T.StringType())
    def paragraphs(text: pd.Series, gone: pd.Series, cuts: pd.Series, fix: pd.Series) -> pd.Series:
        return pd.Series([_paragraphs(t, *(set(x) if x is not None else set() for x in (g, c)), list(f) if f is not None else []) for t, g, c, f in zip(text, gone, cuts, fix)], dtype=object)

    kept = blocks.filter("ocr").withColumns({"_q_k1": _keys()[0], "_q_k2": _keys()[1]})
    on = lambda df: (F.col("_q_k1") == df["k1"]) & (F.col("_q_k2") == df["k2"])
    kept = kept.join(marks, on(marks), "left").drop("k1", "k2").join(fixes, on(fixes), "left").drop("k1", "k2")
    return kept.withColumn("paragraphs", paragraphs("text", "_q_gone", "_q_cut", "_q_fix")).drop("_q_k1", "_q_k2", "_q_gone", "_q_cut", "_q_fix")


def _paragraphs(text: str | None, gone: set[int], cuts: set[int], fixes: list) -> str | None:
    """Running text of a block: furniture out, cut words joined, wrong characters replaced.

    Tokens are those of the search, in the same running text, so that every one
    found is replaced, wherever in its line it stands.
    """
    if not text:
        return text
    joined, starts = body(text, gone, cuts)
    put = {("w", f["token"]) if f["kind"] == "w" else ("t", f["token"]): f["other"] for f in fixes}
    edits = [(i, len(token), put[kind, token]) if kind == "w" else (i, 1, put[kind, token][1]) for kind, token, i, _ in tokens_of(joined) if (kind, token) in put] if put else []
    begins = [at for at, _ in starts]
    ends = [*begins[1:], len(joined)]
    parts, at = [], 0
    edits.sort()
    k = 0
    for begin, end in zip(begins, ends):  # a word over a line end goes with the line it begins in
        part, at = "", max(at, begin)
        while k < len(edits) and edits[k][0] < end:
            i, n, new = edits[k]
            part += joined[at:i] + new
            at, k = i + n, k + 1
        part += joined[at:end]
        at = max(at, end)
        parts.append(part.rstrip())
    width = max((len(p) for p in parts), default=0)
    out = ""
    for k, ((_, no), line) in enumerate(zip(starts, parts)):
        after = next((p for p in parts[k + 1 :] if p), "")
        if no in cuts or not line or not after or line[-1] in CUT_MARKS:
            out += line
            continue
        wide = _HAN.match(line[-1]) or _HAN.match(after[0])
        full = len(line) + (1 if wide else 1 + len(after.split(" ")[0])) > width - (2 if wide else 0)
        out += line + ("" if wide else " ") if full else line + "\n"
    return out
