"""Encoding of a corpus with public byte-level tokenizers (problem 6).

Method: the distinct words of a task's texts are walked as a prefix tree in
depth-first order. Every node keeps the last token of the encoding of its
prefix; the encoding of any word is read back through these states, so a shared
prefix is encoded once. A token is the last one of a prefix exactly when it
stays apart from the last token of the prefix before it, which is looked up in
a table of pairs.

Texts are first parted into clauses at places where no word can span, because
most clauses of a corpus repeat; a clause that was met before isn't read again.

Defined results
---------------
* an empty and a null text give the empty list, blank ones their white space;
* text that looks like a special token is ordinary text;
* code points that cannot be encoded (lone surrogates) count as U+FFFD;
* any length of text is encoded whole; repeated rows give equal lists.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files of the public tokenizers are, on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Distinct clauses and words that a task keeps before it starts afresh.
MOST_CLAUSES, MOST_WORDS = 150_000, 400_000

# How these tokenizers part text into words, and contractions.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Punctuation after which a clause may end.
CLAUSE_ENDS = "。，；！？、：.,;:!?"

_WORDS = regex.compile(WORDS)


def _plain_words() -> re.Pattern:
    """WORDS for texts without code points above 0xFFFF, told by ranges: the same words in less than half the time."""
    plane = "".join(map(chr, range(0x10000)))
    ranges = {c: "".join(rf"\u{ord(m[0][0]):04x}-\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{c}+", plane)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    letter, number, space = ranges.values()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_PLAIN_WORDS = _plain_words()


def words_of(text: str) -> list[str]:
    """The words of a text as the tokenizers part it."""
    plain = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return (_PLAIN_WORDS if plain else _WORDS).findall(text)


def read_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Byte strings and their ids of a `.tiktoken` vocabulary."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


class TrieEncoder:
    """Byte-pair encoding of words by a depth-first walk of their prefix tree."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        # lengths of the tokens that end with two given bytes, so that few suffixes are tried
        sizes: dict[bytes, set[int]] = {}
        for token, i in ranks.items():
            self.lengths[i] = len(token)
            sizes.setdefault(token[-2:], {1}).add(len(token))
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in sizes.items()}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.packed = {token: np.int32(i).tobytes() for token, i in ranks.items()}
        #: Ids of known words, as the bytes of an int32 array: they join fast.
        self.words: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain byte-pair merging, for pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays_apart(self, a: bytes, b: bytes) -> bool:
        got = self.merge(a + b) == [a, b]
        self.apart[a, b] = got
        return got

    def learn(self, words) -> None:
        """Encode words that are not known yet; they share the work on their prefixes."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        if len(self.apart) > MOST_WORDS:
            self.apart.clear()
        known, ranks, sizes, apart, packed, one = self.words, self.ranks, self.sizes, self.apart, self.packed, (1,)
        todo = sorted((w.encode("utf-8", "replace"), w) for w in words if w not in known)
        last: list[bytes] = [b""]  # last token of each prefix of the word before
        before = b""
        for data, word in todo:
            n = len(data)
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for d in range(same + 1, n + 1):
                for size in sizes.get(data[d - 2 : d], one) if d > 1 else one:
                    if size > d:
                        continue
                    t = data[d - size : d]
                    if t in ranks:
                        p = last[d - size]
                        if size == d:
                            if size == 1 or len(self.merge(t)) == 1:
                                break
                        else:
                            got = apart.get((p, t))
                            if got or got is None and self._stays_apart(p, t):
                                break
                last.append(t)
            ids, at = [], n
            while at:
                t = last[at]
                ids.append(packed[t])
                at -= len(t)
            ids.reverse()
            known[word] = b"".join(ids)
            before = data


class Encoder:
    """Encodes whole texts with one or more vocabularies, clause by clause."""

    def __init__(self, names: tuple[str, ...], folder: str = TOKENIZERS):
        self.tries = [TrieEncoder(read_ranks(n, folder)) for n in names]
        self.clauses: list[dict[str, bytes]] = [{} for _ in names]

    @staticmethod
    def clauses_of(text: str) -> list[str]:
        """Pieces of a text that no word of the tokenizers spans.

        After punctuation a word ends unless another sign follows it.
        """
        if "\x00" in text:
            return [text]
        marked = text
        for c in CLAUSE_ENDS:
            if c in marked:
                marked = marked.replace(c, c + "\x00")
        out: list[str] = []
        for piece in marked.split("\x00"):
            if not piece:
                continue
            c = piece[0]
            if not out or c.isalpha() or c in " \n\t\r0123456789":
                out.append(piece)
            else:
                out[-1] += piece
        return out

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Encode the clauses of a batch that are new; returns each text's clauses."""
        if len(self.clauses[0]) > MOST_CLAUSES:
            for known in self.clauses:
                known.clear()
        parted = [self.clauses_of(t) for t in texts]
        new = {c for p in parted for c in p} - self.clauses[0].keys()
        split = {c: words_of(c) for c in new}
        words = {w for ws in split.values() for w in ws}
        for trie, known in zip(self.tries, self.clauses):
            trie.learn(words)
            ids = trie.words.__getitem__
            known.update((c, b"".join(map(ids, ws))) for c, ws in split.items())
        return parted

    def batch(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """For each vocabulary, the ids of each text."""
        parted = self.learn([t or "" for t in texts])
        return [[np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parted] for known in self.clauses]


@lru_cache(4)
def encoder(names: tuple[str, ...], folder: str) -> Encoder:
    """One encoder a Python worker and set of vocabularies."""
    return Encoder(names, folder)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that no part holds much more than so many characters."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > most_chars:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def encode(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(`doc_id`, `ids`): the ids of each document's text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder((name,), folder)
        for batch, texts in slices(batches, "text"):
            ids = enc.batch(texts)[0]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
