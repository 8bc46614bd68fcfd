"""Column expressions and sampling shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Function words that tell four Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the|of|and|to|is|by|for|from|with|are|not|may",
    "fr": "le|la|les|du|de la|une|et|dans|pour|avec|est|sont",
    "de": "der|die|das|und|den|nicht|ein|eine|für|mit|ist|auf",
    "es": "el|los|las|del|y|para|con|una|por|es|su|se",
}

# Scripts that name a language here, tried in this order.
SCRIPT_LANGUAGES = {
    "ko": r"[\x{1100}-\x{11FF}\x{AC00}-\x{D7A3}]",
    "th": r"[\x{0E00}-\x{0E7F}]",
    "hi": r"[\x{0900}-\x{097F}]",
    "ar": r"[\x{0600}-\x{06FF}]",
    "ja": r"[\x{3041}-\x{309F}]",
    "zh": r"[\x{4E00}-\x{9FFF}]",
    "ru": r"[\x{0400}-\x{04FF}]",
}


# Letters of other scripts that look like Latin ones.
LETTERS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "χ": "x",
}


def language(text: Column) -> Column:
    """A coarse language tag of a text from its scripts and function words.

    It only stratifies samples: eight characters of a script, or the most
    frequent function words among four Latin-script languages.
    """
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for lang, cls in SCRIPT_LANGUAGES.items():
        out = out.when(text.rlike(f"(?s)(?:{cls}.{{0,40}}?){{8}}"), F.lit(lang))
    hits = F.array(
        *[
            F.struct(F.regexp_count(text, F.lit(rf"(?iU)\b(?:{words})\b")).alias("n"), F.lit(lang).alias("lang"))
            for lang, words in sorted(FUNCTION_WORDS.items(), reverse=True)
        ]
    )
    return out.otherwise(F.array_max(hits)["lang"])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts one after the other, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


#: Rows that a window keeps of a part of a stratum; up to here Spark limits it before the shuffle.
PART_ROWS = 1000


def bounded_sample(df: DataFrame, strata: str, key: str, per_stratum: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, those with the smallest hash of ``key``.

    The same rows for the same data whatever its partitioning, if ``key`` and then
    ``ties`` tell rows apart; used only to fit models, never to answer for rows.
    Strata are drawn in parts by another hash, each small enough for tasks to drop
    all other rows before the shuffle, so that no stratum is ever gathered in one task.
    """
    parts = -(-per_stratum // PART_ROWS)
    order = W.partitionBy(strata, "_part").orderBy(F.xxhash64(F.col(key)), F.col(key), *ties)
    df = df.withColumn("_part", F.pmod(F.hash(F.col(key)), F.lit(parts)))
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_stratum // parts).drop("_rn", "_part")
