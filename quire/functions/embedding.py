"""Vectors of texts: what makes them is a parameter of the engine."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile("[a-z0-9]+|[\u4e00-\u9fff]+")


class EmbeddingProvider(Protocol):
    """Makes a column of vectors, all of one width, from a column of texts; null for a text without any."""

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    """Unit vectors from hashed words, ideographs and their pairs: the same everywhere, without a model.

    Each distinct token adds one to, or takes one from, a place that its hash names.
    Texts without tokens have no vector.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        return _hashed(self.dimensions)(text)


def provider(name: str, dimensions: int = 64) -> EmbeddingProvider:
    """The provider of a name; a name without one raises."""
    if name == "hash":
        return HashEmbedder(dimensions)
    raise ValueError(f"no provider of embeddings is called {name}")


@lru_cache(1_000_000)
def _place(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


def vector(text: str | None, dimensions: int) -> np.ndarray | None:
    """The hashed vector of one text."""
    tokens: set[str] = set()
    for run in _RUN.findall((text or "").lower()):
        tokens |= {run} if run[0] <= "z" else {run[i : i + n] for n in (1, 2) for i in range(len(run) - n + 1)}
    if not tokens:
        return None
    h = np.array([_place(t) for t in sorted(tokens)], np.uint32)
    out = np.zeros(dimensions)
    np.add.at(out, h % dimensions, np.where(h >> 31, 1.0, -1.0))
    norm = np.sqrt((out**2).sum())
    return (out / norm).astype(np.float32) if norm else None


@lru_cache(8)
def _hashed(dimensions: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([vector(t, dimensions) for t in text], dtype=object)

    return embed
