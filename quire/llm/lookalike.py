"""Text that looks the same but is written with other characters (problem 5).

Method: transitive look-alike classes are found by union-find over strings and
code points; a class is represented by its most frequent plain member, and
fields are rewritten greedily, longest first, with a multi-pattern automaton.
Whether a letter of another script stands for a like-looking one is decided by
word: words with the same skeleton form a class, and the most frequent spelling
in the corpus represents it.

Counts cover every field of every row. The classes of code points and of strings
up to `LONGEST` of them are bounded by Unicode and are sent to the executors; a
longer string (a letter under many marks) has no other plain member than its own
plain form, which is written where it stands. The classes of words grow with the
corpus and are joined.

Defined results
---------------
* null and empty fields are never named and stay as they are;
* ties between spellings go to the one in fewer scripts, then to the lower one
  in code-point order;
* CJK punctuation, unit signs, circled and Roman numerals are left alone, and
  so is a word of one script in a field that has other real words of it;
* `lookalike_fields` leaves out fields that were decoded wrongly
  (see mojibake.py); `unify` rewrites all fields;
* repeated rows are judged alike; extra columns are carried through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import LETTERS, code_points
from quire.llm.mojibake import wrong_udf
from quire.session import cut

# Radicals without a compatibility mapping, and their ideographs.
RADICALS = dict(zip("⺁⺒⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻰⻳", "厂巳母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐龙龟"))

#: Blocks whose characters are presentation variants of plain ones.
_VARIANT_BLOCKS = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFDFF), (0xFE70, 0xFEFE), (0xFF01, 0xFFDC), (0x2F800, 0x2FA1F), (0x1D400, 0x1D7FF))


def _is_invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" and c not in "؀؁؂؃؄؅۝܏"


def _is_space(c: str) -> bool:
    return c != " " and unicodedata.category(c) == "Zs"


def plain(c: str) -> str | None:
    """What a variant code point stands for; None if it is no variant."""
    if _is_invisible(c):
        return ""
    if _is_space(c):
        return " "
    if c in RADICALS:
        return RADICALS[c]
    o = ord(c)
    if any(a <= o <= b for a, b in _VARIANT_BLOCKS):
        k = unicodedata.normalize("NFKC", c)
        if k != c and unicodedata.category(c)[0] in "LNS" and all(unicodedata.category(x)[0] in "LNM" for x in k):
            return k
    if c == "ｰ":
        return "ー"
    return None


VARIANTS = {c: p for o in (*range(0xA0, 0x3100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0080)) if (p := plain(c := chr(o))) is not None}


def _ranges(chars) -> list[tuple[int, int]]:
    """First and last code points of the runs among some characters."""
    out, at = [], sorted(map(ord, chars))
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1:
            j += 1
        out.append((at[i], at[j]))
        i = j + 1
    return out


_COMBINING = [chr(o) for o in range(0x300, 0x3100) if unicodedata.combining(chr(o)) and (o < 0x370 or o in (0x653, 0x654, 0x655, 0x3099, 0x309A))]
_JAMO = [chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
_SUSPECT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges([*VARIANTS, *_COMBINING, *_JAMO, "ﾞ", "ﾟ", *LETTERS])) + "]|ํา")
#: Whether a code point has to be in a field in question.
_ASKED = np.zeros(0x110000, bool)
_ASKED[[ord(c) for c in (*VARIANTS, *_COMBINING, *_JAMO, "ﾞ", "ﾟ", *LETTERS, "ํ")]] = True
#: Plain forms of more than one character, counted where they stand.
_LONG = sorted({p for p in VARIANTS.values() if len(p) > 1 and p.isascii()})
#: A variant with its marks, or a letter with marks of its own or its jamo.
_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(VARIANTS))
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges([*_COMBINING, "ﾞ", "ﾟ"]))
_STRING = re.compile(f"[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|ํา|[{_CLASS}][{_MARKS}]+|[^{_CLASS}{_MARKS}\\s][{_MARKS}]+|[{_CLASS}]")
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ]+")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Code points of a string that is counted and sent.
LONGEST = 4
_LONG_RUN = re.compile(f"[^\\s][{_MARKS}]{{{LONGEST},}}")


def script(c: str) -> str:
    return "G" if "Ͱ" <= c <= "Ͽ" else "C" if "Ѐ" <= c <= "ԯ" else "L"


def simplest(s: str) -> str | None:
    """The plain form of a look-alike string; None if it is plain already."""
    k = "".join(VARIANTS.get(c, c) for c in s)
    k = unicodedata.normalize("NFC", k.replace("ﾞ", "゙").replace("ﾟ", "゚")).replace("ํา", "ำ")
    return k if k != s and len(k) <= max(len(s), 4) else None


class UnionFind:
    """Classes of strings and code points."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, a: str) -> str:
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a in sorted(self.up):
            out.setdefault(self.find(a), []).append(a)
        return out


def skeletons() -> dict[int, str]:
    """Each letter of a transitive class of look-alikes over all scripts, as the class's Latin member.

    Cyrillic, Greek and width forms of one shape meet in one class through the
    letters that they are each taken for.
    """
    uf = UnionFind()
    for a, b in LETTERS.items():
        uf.join(a, b)
    for a, b in VARIANTS.items():
        if len(b) == 1 and b.isalpha():
            uf.join(a, b)
    out = {}
    for members in uf.classes().values():
        if latin := [m for m in members if m.isascii()]:
            out.update({ord(m): latin[0] for m in members if m not in latin})
    return out


_SKELETON = skeletons()


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Rewriting of look-alike strings to the most frequent plain member of their class."""
    uf = UnionFind()
    for s in counts:
        if (p := simplest(s)) is not None:
            uf.join(s, p)
            for c in s:
                if c in VARIANTS and len(s) == 1:
                    uf.join(c, VARIANTS[c])
    out = {}
    for members in uf.classes().values():
        plain_ones = [m for m in members if simplest(m) is None] or [simplest(m) for m in members]
        best = min(plain_ones, key=lambda m: (-counts.get(m, 0), len(m), m))
        out.update({m: best for m in members if simplest(m) is not None})
    return out


def _scan(columns: tuple[str, ...]):
    """Fields with any look-alike in question; counts of strings and of words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            every = [(b, c, t) for c in columns for b, t in zip(p["block_id"], p[c]) if t]
            if not every:
                continue
            texts = [t for _, _, t in every]
            codes, size = code_points(texts)
            asked = np.logical_or.reduceat(_ASKED[codes], np.cumsum(size) - size).tolist()
            fields = [x for x, a in zip(every, asked) if a and _SUSPECT.search(x[2])]
            text, n = "\n".join(texts), np.bincount(codes)
            strings = Counter({chr(c): int(n[c]) for c in np.flatnonzero(n)})
            strings.update(s for _, _, t in fields for s in _STRING.findall(t) if 1 < len(s) <= LONGEST)
            strings.update({s: text.count(s) for s in _LONG})
            words = Counter(_WORD.findall(text))
            rows = [("f", t, c, b, 0) for b, c, t in fields] + [("s", s, "", 0, n) for s, n in strings.items() if n]
            rows += [("w", w, w.translate(_SKELETON), 0, n) for w, n in words.items()]
            yield pd.DataFrame(rows, columns=["kind", "form", "skeleton", "block_id", "n"])

    return run


def scanned(blocks: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """One pass over all fields: those in question (`block_id`, `field`, `value`), and
    (`kind`, `form`, `skeleton`, `n`), how often every string and word stands in the corpus.
    """
    found = cut(blocks.select("block_id", *columns).mapInPandas(_scan(columns), "kind string, form string, skeleton string, block_id bigint, n bigint"))
    fields = found.filter("kind = 'f'").select("block_id", F.col("skeleton").alias("field"), F.col("form").alias("value"))
    counts = found.filter("kind <> 'f'").groupBy("kind", "form", "skeleton").agg(F.sum("n").alias("n"))
    return fields, cut(counts)


def _can_be(word: str, to: str) -> str | None:
    """The word in one script alone, where look-alikes allow it."""
    back = {"C": _TO_CYRILLIC, "G": _TO_GREEK}
    out = []
    for c in word:
        if script(c) == to:
            out.append(c)
        elif to == "L" and c in LETTERS:
            out.append(LETTERS[c])
        elif to != "L" and (x := back[to].get(LETTERS.get(c, c))):
            out.append(x)
        else:
            return None
    return "".join(out)


_TO_CYRILLIC = {v: k for k, v in LETTERS.items() if script(k) == "C"}
_TO_GREEK = {v: k for k, v in LETTERS.items() if script(k) == "G"}


def _choose(word: str, best: str | None) -> str | None:
    """The spelling that stands for a word: the frequent one, else one of a single script."""
    scripts = Counter(map(script, word))
    if best is not None and best != word and len({script(c) for c in best}) == 1:
        return best
    if len(scripts) > 1:
        for to, _ in sorted(scripts.items(), key=lambda x: (-x[1], x[0] != "L")):
            if (w := _can_be(word, to)) is not None:
                return w
    return None


@F.pandas_udf(T.StringType())
def _choose_udf(word: pd.Series, best: pd.Series) -> pd.Series:
    return pd.Series([_choose(w, b if isinstance(b, str) else None) for w, b in zip(word, best)], dtype=object)


def word_forms(counts: DataFrame) -> DataFrame:
    """(`form`, `_q_best`) of words that are a look-alike spelling of another."""
    words = counts.filter("kind = 'w'")
    foreign = words.filter(F.col("form").rlike("[\\x{370}-\\x{3FF}\\x{400}-\\x{52F}]"))
    single = F.col("form").rlike("^(?:[^\\x{370}-\\x{52F}]+|[\\x{370}-\\x{3FF}]+|[\\x{400}-\\x{52F}]+)$")
    order = F.struct(F.when(single, F.col("n")).otherwise(0).alias("n"), (-F.ascii("form")).alias("a"), F.col("form").alias("form"))
    best = words.join(foreign.select("skeleton").distinct(), "skeleton", "left_semi").groupBy("skeleton").agg(F.max(order).alias("top"))
    return (
        foreign.join(best, "skeleton")
        .select("form", _choose_udf("form", F.col("top.form")).alias("_q_best"))
        .filter(F.col("_q_best").isNotNull())
    )


FORMS = T.StructType([T.StructField("bad", T.BooleanType()), T.StructField("fixed", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


def doubtful(text: str) -> list[str]:
    """Words with letters of another script that may be look-alikes, each once.

    A word of one script counts only where no real word of that script, with
    letters that look like no other, stands in the field.
    """
    words = [w for w in dict.fromkeys(_WORD.findall(text)) if _FOREIGN.search(w)]
    real = {script(w[0]) for w in words if len({script(c) for c in w}) == 1 and any(c not in LETTERS for c in w)}
    return [w for w in words if any(c in LETTERS for c in w) and not (len({script(c) for c in w}) == 1 and (script(w[0]) in real or len(w) == 1))]


def rewrite(text: str, automaton: ahocorasick.Automaton, table: dict[str, str]) -> str:
    """Greedy leftmost-longest replacement of every look-alike string."""
    out, at = [], 0
    for end, s in automaton.iter_long(text):
        start = end - len(s) + 1
        out += [text[at:start], table[s]]
        at = end + 1
    out.append(text[at:])
    return "".join(out)


def automaton_of(table: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in table:
        a.add_word(s, s)
    if table:
        a.make_automaton()
    return a


def forms_udf(spark, counts: DataFrame):
    """A vectorised function: does a field hold look-alike strings, its plain form, its doubtful words."""
    strings = {r["form"]: r["n"] for r in counts.filter("kind = 's'").select("form", "n").collect()}  # up to LONGEST code points: bounded by Unicode
    shared = spark.sparkContext.broadcast(representatives(strings))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        automaton = automaton_of(table)
        for s in parts:
            out = []
            for t in s:
                if not t:
                    out.append((False, t, []))
                    continue
                fixed = t
                if _LONG_RUN.search(t):
                    fixed = _STRING.sub(lambda m: simplest(m.group()) or m.group() if len(m.group()) > LONGEST else m.group(), t)
                fixed = rewrite(fixed, automaton, table) if table else fixed
                fixed = unicodedata.normalize("NFC", fixed) if fixed != t else fixed
                out.append((fixed != t, fixed, doubtful(fixed)))
            yield pd.DataFrame(out, columns=["bad", "fixed", "words"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FORMS)


def judged_fields(blocks: DataFrame, columns: tuple[str, ...] = ("text", "section")) -> DataFrame:
    """(`block_id`, `field`, `value`, `fixed`, `bad`) of all fields with look-alikes in question."""
    fields, counts = scanned(blocks, columns)
    forms = forms_udf(blocks.sparkSession, counts)
    fields = fields.withColumn("j", forms("value")).select("block_id", "field", "value", "j.bad", "j.fixed", "j.words")
    fields = cut(fields.filter(F.col("bad") | (F.size("words") > 0)))
    words = (
        fields.select("block_id", "field", F.explode("words").alias("form"))
        .join(word_forms(counts), "form")
        .groupBy("block_id", "field")
        .agg(F.map_from_entries(F.collect_list(F.struct("form", "_q_best"))).alias("best"))
    )

    @F.pandas_udf(T.StringType())
    def respell(text: pd.Series, best: pd.Series) -> pd.Series:
        return pd.Series([_WORD.sub(lambda m: b.get(m.group(), m.group()), t) if (b := dict(x) if x else None) else t for t, x in zip(text, best)], dtype=object)

    return (
        fields.join(words, ["block_id", "field"], "left")
        .withColumn("fixed", F.when(F.col("best").isNull(), F.col("fixed")).otherwise(respell("fixed", "best")))
        .withColumn("bad", F.col("bad") | F.col("best").isNotNull())
        .filter("bad")
        .select("block_id", "field", "value", "fixed", "bad")
    )


def lookalike_fields(blocks: DataFrame) -> DataFrame:
    """(`block_id`, `field`) of the fields written with other characters.

    Fields that were decoded wrongly are left to problem 4.
    """
    wrong = wrong_udf(blocks.sparkSession, blocks.select(F.col("block_id").alias("_id"), "text", "source"))
    found = judged_fields(blocks.select("block_id", "text", "section")).select("block_id", "field", "value")
    # few fields are left, but each costs much: over all cores again
    found = found.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, "block_id", "field")
    return found.filter(~wrong(F.col("value"))).select("block_id", "field")


def unify(blocks: DataFrame, columns: tuple[str, ...] = ("text", "section")) -> DataFrame:
    """All rows with `<column>_plain` for each of the columns."""
    fixed = judged_fields(blocks, columns).groupBy(F.col("block_id").alias("_q_id")).pivot("field", list(columns)).agg(F.first("fixed"))
    fixed = fixed.select("_q_id", *[F.col(c).alias(f"_q_{c}") for c in columns])
    out = blocks.join(fixed, F.col("block_id") == F.col("_q_id"), "left")
    for c in columns:
        out = out.withColumn(f"{c}_plain", F.coalesce(f"_q_{c}", c))
    return out.drop("_q_id", *[f"_q_{c}" for c in columns])
