"""Sentence boundaries across languages and scripts (problem 2).

Method: candidate boundaries (ends of marks with their closing quotes and
brackets, line ends, spaces of scripts that part sentences by spaces) are
classified with a maximum-entropy model over neighbouring tokens, case, length,
digits and script. It is trained on reliable boundaries: ends of texts and of
lines that are not wrapped, against marks followed by lower case and marks that
never end a line.

The model is fitted on a bounded sample of `SAMPLE_PER_LANGUAGE` rows a
language; every candidate of every row is classified.

Defined results
---------------
* null, empty and blank texts have no sentences;
* the units of a text cover all of it but white space between them, in order;
* quoted speech, titles and brackets keep their sentences together; a bracket
  that holds a whole sentence is one of its own;
* an opening quote or bracket that is never closed is ignored;
* repeated rows give the same ends; extra columns are carried through.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded_sample, language

SAMPLE_PER_LANGUAGE = 1200
#: Slots of the hashed features, rounds and step of the training, penalty.
SLOTS, ROUNDS, STEP, PENALTY = 1 << 15, 120, 0.5, 1e-4
#: A kind of mark seen so often without ever ending a line does not end sentences.
NEVER_AFTER = 5

# Marks that may end a sentence, and the pairs that enclose text.
MARKS = ".!?。！？…।؟"
WIDE_MARKS = "。！？।؟…"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "【": "】", "〔": "〕", "[": "]", "〖": "〗"}
BRACKETS = "(（【〔["
CLOSERS = "".join(set(PAIRS.values()))

_MARK = re.compile(f"[{re.escape(MARKS)}]+")
_TOKEN = re.compile(r"[^\s\"'“”„«»‹›「」『』《》()（）【】〔〕\[\],，、;；:：!?。！？…]*$")
_RIGHT = re.compile(r"[^\W\d_]+|\d|\S")
_LIST = re.compile(r"\s*(?:\d+\s?[.、)）]|[(（][一二三四五六七八九十百\d]+[)）]|第[一二三四五六七八九十百零\d]+[章条节篇]|[一二三四五六七八九十]+、|[-–•·*●▪]\s)")


@lru_cache(50_000)
def script_of(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "L" if c.isalpha() else "0" if c.isdigit() else "P"
    for a, b, s in ((0xC0, 0x24F, "L"), (0x370, 0x3FF, "G"), (0x400, 0x52F, "R"), (0x590, 0x6FF, "A"), (0x900, 0x97F, "D"), (0xE00, 0xE7F, "T"), (0x3040, 0x30FF, "J"), (0x3400, 0x9FFF, "H"), (0xAC00, 0xD7AF, "K"), (0xF900, 0xFAFF, "H"), (0x2F00, 0x2FDF, "H")):
        if a <= o <= b:
            return s
    return unicodedata.category(c)[0]


def _cls(c: str) -> str:
    """Class of a character to the right of a candidate."""
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c in PAIRS:
        return "open"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    return "letter" + script_of(c) if c.isalpha() else "other"


class Candidate:
    """A place where a sentence may end: offset, kind of its left side, right side."""

    __slots__ = ("end", "kind", "right", "rcls", "extra", "hard", "start")

    def __init__(self, end, kind, right, rcls, extra, hard=False, start=False):
        self.end, self.kind, self.right, self.rcls, self.extra, self.hard, self.start = end, kind, right, rcls, extra, hard, start


def line_ends(text: str) -> list[tuple[int, tuple[str, ...], int | None]]:
    """For each line end inside a text: offset, features, label (1, 0 or unknown).

    A wrapped line is as full as the text is wide: the next word had no place.
    """
    lines = text.split("\n")
    if len(lines) == 1:
        return []
    width = max(len(x) for x in lines)
    out, at = [], 0
    for i, line in enumerate(lines[:-1]):
        at += len(line)
        left, right = line.rstrip(), lines[i + 1].lstrip()
        if not left or not right:
            out.append((at, ("N:blank",), 1))
        else:
            word = re.match(r"\S*", right).group()
            spaced = script_of(left[-1]) in "L0RPGKDA" and not any(script_of(c) in "HJT" for c in left[-2:] + right[:1])
            fits = len(left) + 1 + len(word) <= width
            shape = "fits" if fits else "full"
            band = "wide" if width > 90 else "mid" if width > 38 else "slim"
            marked = "mark" if _LIST.match(left) else "plain"
            nextm = "mark" if _LIST.match(right) and not right[0].isdigit() else "plain"
            done = "done" if left[-1] in MARKS or (left[-1] in CLOSERS and left[:-1].rstrip()[-1:] in tuple(MARKS)) else "open"
            joined = "hyphen" if left[-1] in "-‐\xad¬" else "no"
            rc = _cls(right[0])
            feats = tuple(
                f"N:{x}"
                for x in (f"s={spaced}", f"{spaced}|{shape}|{band}", f"{spaced}|{shape}|{marked}", f"left={marked}|{shape}", f"right={nextm}", f"{done}|{shape}|{spaced}", f"rc={rc}|{spaced}", f"{rc}|{shape}|{done}", f"{joined}|{spaced}")
            )
            label = None
            if rc == "lower" and spaced and marked == "plain":
                label = 0
            elif (marked == "mark" and shape == "fits") or (not spaced and done == "done") or (done == "done" and shape == "fits") or nextm == "mark":
                label = 1
            out.append((at, feats, label))
        at += 1
    return out


def candidates(text: str, hard: set[int]) -> list[Candidate]:
    """Candidates of a text outside quotes, titles and brackets, in order."""
    out: list[Candidate] = []
    closes = _partners(text, hard)
    n, i, fresh = len(text), 0, True
    while i < n:
        c = text[i]
        if i in closes:
            j = closes[i]
            inner = text[i + 1 : j].rstrip()
            if inner and inner[-1] in MARKS:
                before = text[:i].rstrip()[-1:]
                place = "start" if fresh else "colon" if before and before in ":：,，" else "mid"
                if c in BRACKETS and fresh:
                    place = "whole"
                out.append(_make(text, j + 1, f"Q{c in BRACKETS}|{place}|{inner[-1]}", hard, [f"q={place}", f"q={place}|{script_of(inner[-2:-1] or ' ')}"]))
            i, fresh = j + 1, False
            if inner and inner[-1] in MARKS and out and out[-1].end == j + 1 and place in ("whole", "colon"):
                fresh = True
            continue
        m = _MARK.match(text, i)
        if m:
            j = m.end()
            mark = m.group()
            nxt = text[j : j + 1]
            if not nxt or nxt.isspace() or mark[-1] in WIDE_MARKS:
                token = _TOKEN.search(text, max(0, i - 24), i)
                left = token.group() if token else ""
                sc = script_of(left[-1]) if left else "none"
                if sc in "HJTKDA" and len(left) > 2 and "." not in left:
                    left = left[-1:] if sc in "HJ" else left[-2:]
                key = re.sub(r"\d+", "0", left.lower())
                shape = re.sub(r"(.)\1+", r"\1", "".join("0" if x.isdigit() else "U" if x.isupper() else "u" if x.islower() else "." if x == "." else "x" for x in left[-12:]))
                out.append(_make(text, j, f"{key}{mark[:3]}", hard, [f"shape={shape}{mark[:2]}", f"len={min(len(left), 6)}", f"sc={sc}{mark[0]}"]))
                fresh = True
            i = j
            continue
        if c == " " and i and script_of(text[i - 1]) in "T0LP" and (script_of(text[i - 1]) == "T" or text[i + 1 : i + 2] and script_of(text[i + 1]) == "T"):
            a, b = script_of(text[i - 1]), script_of(text[i + 1 : i + 2] or " ")
            out.append(Candidate(i, f"TH{a}", b, f"TH{b}", [f"th={a}{b}"]))
        if not c.isspace():
            fresh = False
        elif i in hard:
            fresh = True
        i += 1
    return out


def _make(text: str, end: int, kind: str, hard: set[int], extra: list[str]) -> Candidate:
    j = end
    n = len(text)
    stop = False
    while j < n and text[j].isspace():
        stop |= j in hard
        j += 1
    gap = "none" if j == end else "space"
    m = _RIGHT.match(text, j)
    right = m.group() if m else ""
    if right in PAIRS:
        m2 = _RIGHT.match(text, j + 1)
        right += m2.group() if m2 else ""
    if script_of(right[-1:] or " ") in "HJT":
        right = right[:2]
    return Candidate(end, kind, right, _cls(text[j : j + 1]), [*extra, f"gap={gap}"], stop or j >= n)


def _partners(text: str, hard: set[int]) -> dict[int, int]:
    """Opening to closing offsets of the outermost pairs; none spans a hard line end."""
    stack: list[tuple[int, str]] = []
    out: dict[int, int] = {}
    for i, c in enumerate(text):
        if stack and c == stack[-1][1]:
            start, _ = stack.pop()
            out[start] = i
        elif c in PAIRS:
            stack.append((i, PAIRS[c]))
        elif i in hard:
            stack.clear()
        elif c in CLOSERS and any(c == x for _, x in stack):
            while stack[-1][1] != c:
                stack.pop()
            start, _ = stack.pop()
            out[start] = i
    return out


def features(c: Candidate, known: bool) -> tuple[str, ...]:
    return (
        f"k={c.kind}",
        f"r={c.right}",
        f"rc={c.rcls}",
        f"known={known}",
        f"rc={c.rcls}|known={known}",
        f"k={c.kind}|rc={c.rcls}",
        *c.extra,
        *(f"{x}|rc={c.rcls}" for x in c.extra),
    )


@lru_cache(200_000)
def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


class MaxEnt:
    """Binary maximum entropy (logistic) model over hashed features."""

    def __init__(self, weights: np.ndarray, bias: float, starts: frozenset[str]):
        self.w, self.bias, self.starts = weights.tolist(), bias, starts
        self.memo: dict[tuple[str, ...], bool] = {}

    def says(self, feats: tuple[str, ...]) -> bool:
        if (got := self.memo.get(feats)) is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[feats] = got = self.bias + sum(self.w[slot(f)] for f in feats) > 0
        return got

    def hard(self, text: str) -> set[int]:
        return {at for at, feats, _ in line_ends(text) if self.says(feats)}

    def ends(self, text: str | None) -> list[int]:
        """Offsets after the last character of each sentence of a text."""
        if not text or text.isspace():
            return []
        hard = self.hard(text)
        cuts = {len(text)} | hard
        for c in candidates(text, hard):
            if c.hard and not c.kind.startswith("TH") or self.says(features(c, c.right in self.starts)):
                cuts.add(c.end)
        out, last = [], 0
        for cut in sorted(cuts):
            end = last + len(text[last:cut].rstrip())
            if end > last and not text[last:end].isspace():
                out.append(end)
                last = cut
        return out


def fit_rows(rows: list[str]) -> MaxEnt:
    """Train on the reliable boundaries of some texts."""
    examples: Counter = Counter()
    found = []
    starts: Counter = Counter()
    kinds: Counter = Counter()
    ending: Counter = Counter()
    for text in rows:
        ends = line_ends(text)
        for _, feats, label in ends:
            if label is not None:
                examples[feats, label] += 1
        hard = {at for at, _, label in ends if label == 1}
        for s in (0, *(h + 1 for h in hard)):
            m = _RIGHT.match(text, s + len(text[s:]) - len(text[s:].lstrip()))
            if m:
                right = m.group()
                if right in PAIRS:
                    m2 = _RIGHT.match(text, m.end())
                    right += m2.group() if m2 else ""
                starts[right[:2] if script_of(right[-1]) in "HJT" else right] += 1
        for c in candidates(text, hard):
            found.append(c)
            kinds[c.kind] += 1
            ending[c.kind] += bool(c.hard)
    known = frozenset(w for w, n in starts.items())
    for c in found:
        if c.kind.startswith("TH"):
            examples[features(c, c.right in known), int(c.kind == "THT" and c.right == "T")] += 1
            continue
        label = None
        if c.hard:
            label = 1
        elif c.rcls in ("lower",) or (c.right and c.right[0] in ",;:，、；：)）%"):
            label = 0
        elif kinds[c.kind] > NEVER_AFTER and ending[c.kind] == 0:
            label = 0
        elif ending[c.kind] >= 1 and c.right in known:
            label = 1
        if label is not None:
            examples[features(c, c.right in known), label] += 1
    return MaxEnt(*_train(examples), known)


def _train(examples: Counter) -> tuple[np.ndarray, float]:
    """Weighted gradient ascent with per-slot steps on the distinct examples."""
    w, bias = np.zeros(SLOTS), 0.0
    if not examples:
        return w, 1.0
    rows, cols, y, n = [], [], [], []
    for k, ((feats, label), count) in enumerate(sorted(examples.items(), key=lambda x: (x[0][0], x[0][1]))):
        s = {slot(f) for f in feats}
        rows += [k] * len(s)
        cols += s
        y.append(label)
        n.append(1 + np.log(count))
    rows, cols, y, n = np.array(rows), np.array(cols), np.array(y, float), np.array(n)
    n /= n.sum()
    power, gb = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(rows, w[cols], len(y)) + bias
        d = n * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        g = np.bincount(cols, d[rows], SLOTS) - PENALTY * w / len(y)
        power += g * g
        w += STEP * g / np.sqrt(power)
        gb += d.sum() ** 2
        bias += STEP * d.sum() / np.sqrt(gb)
    return w, float(bias)


def fit(texts: DataFrame) -> MaxEnt:
    """The model from a bounded sample of (`_id`, `text`), stratified by language."""
    tagged = texts.filter(F.length(F.trim("text")) > 0).withColumn("_lang", language(F.col("text")))
    return fit_rows(sorted(r["text"] for r in bounded_sample(tagged, "_lang", "_id", SAMPLE_PER_LANGUAGE).select("text").collect()))


def ends_udf(spark: SparkSession, texts: DataFrame):
    """A vectorised function of a text: the ends of its sentences.

    What is sent to executors is bounded by SLOTS and the sample.
    """
    shared = spark.sparkContext.broadcast(fit(texts))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for s in parts:
            yield pd.Series([model.ends(t) for t in s], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


def sentence_ends(blocks: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """(`block_id`, `sent_end`): one row a sentence, by a model fitted on `lessons` or the blocks themselves."""
    lessons = blocks if lessons is None else lessons
    ends = ends_udf(blocks.sparkSession, lessons.select(F.col("block_id").alias("_id"), "text"))
    return blocks.select("block_id", F.explode(ends("text")).alias("sent_end"))


def sentences(blocks: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """All rows of blocks, one for each sentence: `sent_no` from 1, `sent_end`, `sentence`."""
    lessons = blocks if lessons is None else lessons
    ends = ends_udf(blocks.sparkSession, lessons.select(F.col("block_id").alias("_id"), "text"))
    out = blocks.withColumn("_q_ends", ends("text")).select("*", F.posexplode("_q_ends").alias("_q_at", "sent_end"))
    start = F.when(F.col("_q_at") == 0, 0).otherwise(F.element_at("_q_ends", F.greatest(F.col("_q_at"), F.lit(1))))
    return out.withColumn("sent_no", F.col("_q_at") + 1).withColumn(
        "sentence", F.regexp_replace(F.substr("text", start + 1, F.col("sent_end") - start), r"^(?U)\s+", "")
    ).drop("_q_ends", "_q_at")
