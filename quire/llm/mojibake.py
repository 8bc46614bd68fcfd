"""Text that was decoded with the wrong character encoding (problem 4).

Method: every candidate decoding of a field is compressed with zstandard
dictionaries, one a language; the chain of decodings with the least
description length, its own cost included, is chosen, and a field stays as it
is when none is shorter.

The model (dictionaries, character costs and known contexts) is counted over all
rows; every field of every row is judged.

Defined results
---------------
* null and empty fields are never named and come out unchanged;
* a field with U+FFFD, C1 control characters, private-use or unassigned code
  points was decoded wrongly whether or not it can be restored;
* of several chains of equal length the one listed first wins;
* repeated rows are judged alike; extra columns are carried through.
"""

from __future__ import annotations

import codecs
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import FUNCTION_WORDS, LETTERS, SCRIPT_LANGUAGES, code_points
from quire.session import cut

#: Size of a language's dictionary, and of the pieces of most use that it is made from.
DICTIONARY_BYTES, PIECE_BYTES = 40_000, 400_000
#: Code points of a piece, and times that it stands in what the dictionary is made from.
LONGEST_PIECE, MOST_TIMES = 64, 50
#: Cost in bytes of one step of a chain, and of one character that is lost.
CHAIN_COST, LOST_COST = 3.0, 6.0
#: Bits a character must get cheaper before a single-byte map may touch it.
CHEAPER_BITS = 4.0
UNSEEN_BITS = 22.0
#: Rows whose characters cost so many times the median are not learned from.
DEAREST = 1.3
MOST_STEPS = 3
#: Share of a language's rows, two rows at least, that make a character or a context known.
KNOWN_SHARE = 0.0025

# Encodings that texts were written in and wrongly read as.
READ_SINGLE = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r")
READ_DOUBLE = ("gb18030", "big5", "cp932", "cp949")
WRITTEN_SINGLE = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850")
WRITTEN_DOUBLE = ("gb18030", "big5", "cp932", "euc_jp", "cp949")

LOST = "\x00"


def _lossy(error: UnicodeError) -> tuple[bytes, int]:
    return b"\x00" * (error.end - error.start), error.end


codecs.register_error("quire_nul", _lossy)


def _sloppy(name: str) -> tuple[dict[int, int], dict[int, int]]:
    """Byte to code point and back for a single-byte encoding; holes read as C1."""
    there = {}
    for b in range(256):
        try:
            there[b] = ord(bytes([b]).decode(name))
        except UnicodeDecodeError:
            there[b] = b
    return there, {c: b for b, c in there.items()}


_SINGLE = {name: _sloppy(name) for name in {*READ_SINGLE, *WRITTEN_SINGLE}}
_RUNS = {name: re.compile("[%s]+" % re.escape("".join(chr(c) for c in sorted(back) if c != 10))) for name, (_, back) in _SINGLE.items()}
_HIGH = {name: re.compile("[%s]+" % re.escape("".join(chr(c) for c in sorted(back) if c >= 128))) for name, (_, back) in _SINGLE.items()}
_MAPS = {
    (x, y): {c: _SINGLE[y][0][b] for c, b in _SINGLE[x][1].items() if c >= 128 and _SINGLE[y][0][b] != c}
    for x in READ_SINGLE
    for y in WRITTEN_SINGLE
    if x != y
}
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_REPERTOIRE = {name: frozenset(chr(c) for c in back if c >= 128) for name, (_, back) in _SINGLE.items()}
_MIXED = re.compile("[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
#: A letter of the Latin, Greek or Cyrillic blocks with its neighbours is judged in context.
_CONTEXT = re.compile("(?s).?([\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u04ff])")
_LETTERS = frozenset(c for c in map(chr, range(0x500)) if _CONTEXT.match(c))
_TABLES = {name: codecs.charmap_build("".join(chr(there[b]) for b in range(256))) for name, (there, _) in _SINGLE.items()}
_ENCODE = {name: (lambda s, table=table: codecs.charmap_encode(s, "strict", table)[0]) for name, table in _TABLES.items()}


def _class(name: str, first: int, last: int) -> str:
    return "[%s]" % re.escape("".join(chr(_SINGLE[name][0][b]) for b in range(first, last + 1)))


#: What UTF-8 sequences of several bytes look like in a single-byte reading.
_SHAPE = {x: re.compile(f"(?:{_class(x, 0xC2, 0xDF)}{_class(x, 0x80, 0xBF)}|{_class(x, 0xE0, 0xEF)}{_class(x, 0x80, 0xBF)}{{2}}|{_class(x, 0xF0, 0xF4)}{_class(x, 0x80, 0xBF)}{{3}})+") for x in READ_SINGLE}
_LEADS = {x: frozenset(chr(_SINGLE[x][0][b]) for b in range(0xC2, 0xF5)) for x in READ_SINGLE}
_TRAILS = {x: frozenset(chr(_SINGLE[x][0][b]) for b in range(0x80, 0xC0)) for x in READ_SINGLE}
_LEADING = frozenset().union(*_LEADS.values())


def _typed(c: str) -> bool:
    """Variants that writers do type (see lookalike.py): never a reason to doubt a decoding."""
    k = unicodedata.normalize("NFKC", c)
    return unicodedata.category(c) in ("Cf", "Mn", "Zs") or (k != c and (0x2E80 <= ord(c) <= 0x2FDF or 0x1100 <= ord(c) <= 0x11FF or 0xF900 <= ord(c) <= 0xFB06 or 0xFF01 <= ord(c) <= 0xFF9F or 0x2000 <= ord(c) <= 0x206F))


#: Presentation forms, compatibility ideographs, spaces and invisible signs.
TYPED = frozenset(chr(o) for o in (*range(0xA0, 0x370), *range(0x1100, 0x1200), *range(0x2000, 0x2070), *range(0x2E80, 0x3001), *range(0x3099, 0x309B), *range(0xF900, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFEFF, 0xFFA0)) if _typed(chr(o)) or 0x1100 <= o < 0x1200) | frozenset("\x85")
#: Code points that no writer types: lost, control, private use, and U+FFFD read as GB 18030.
_BROKEN = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]|" + ("\ufffd" * 2).encode().decode("gb18030"))


@lru_cache(100_000)
def _assigned(c: str) -> bool:
    return unicodedata.category(c) not in ("Cn", "Co", "Cs")


def _unit(data: bytes, encoding: str) -> str:
    """Decode strictly up to lost pieces, which become LOST."""
    return data.decode(encoding, "replace").replace("�", LOST)


class _Bits(dict):
    """Bits of characters; UNSEEN_BITS of those that are not known."""

    def __missing__(self, c: str) -> float:
        return UNSEEN_BITS


def _cost(bits: _Bits, text: str) -> float:
    return sum(map(bits.get, text, repeat(UNSEEN_BITS)))


def _read_singly(text: str, own: set[str], bits: _Bits) -> set[str]:
    """Characters of passages that are cheaper as the UTF-8 their bytes in a single-byte reading make."""
    out: set[str] = set()
    if own.isdisjoint(_LEADING):
        return out
    for x, shape in _SHAPE.items():
        if _LEADS[x].isdisjoint(own) or _TRAILS[x].isdisjoint(own):
            continue
        for m in shape.finditer(text):
            s = m.group()
            if _cost(bits, _ENCODE[x](s).decode("utf-8", "replace")) < _cost(bits, s) - CHEAPER_BITS:
                out.update(s)
    return out


class Model:
    """Per-language dictionaries, character costs and known contexts of the corpus."""

    def __init__(self, dictionaries: dict[str, bytes], bits: dict[str, float], contexts: set[str]):
        self.bits, self.contexts = _Bits(bits), contexts
        self.cheaper: dict[str, list] = {}
        self.known = frozenset(bits) | TYPED | frozenset(map(chr, range(128)))
        params = zstandard.ZstdCompressionParameters.from_level(1, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.packers = {}
        for lang, data in sorted(dictionaries.items()):
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(data, dict_type=kind)
            d.precompute_compress(compression_params=params)
            self.packers[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def length(self, text: str) -> float:
        """Description length in bytes under the best of all languages."""
        data = text.replace(LOST, "").encode("utf-8", "surrogatepass")
        return min(len(p.compress(data)) for p in self.packers.values()) + LOST_COST * text.count(LOST)

    def cost(self, text: str) -> float:
        return _cost(self.bits, text)

    def odd(self, text: str) -> set[str]:
        """Characters that the corpus has too rarely, or in other or too rare contexts only,
        and such as read as UTF-8 are cheaper, however often the corpus has them.
        """
        own = set(text)
        out = own.difference(self.known)
        for m in _CONTEXT.finditer(text) if not own.isdisjoint(_LETTERS) else ():
            if m.group(1) not in TYPED and m.group(0) + text[m.end() : m.end() + 1] not in self.contexts:
                out.add(m.group(1))
        out |= _read_singly(text, own, self.bits)
        return set() if out <= LETTERS.keys() else out  # look-alikes alone are typed (see lookalike.py)

    # -- one step: every decoding of a text that makes some of it cheaper

    def steps(self, text: str, odd: set[str]) -> Iterator[tuple[str, int]]:
        odds = "".join(odd)
        share = {x: sum(c in _REPERTOIRE[x] for c in odd) for x in READ_SINGLE}
        mixed = len(_MIXED.findall(text))
        # the same readings of the same bytes are tried once, and the same replacements made once
        decoded: dict[tuple, tuple[str, float] | str | None] = {}
        costs: dict[str, float] = {}
        made: dict[tuple, str] = {}
        met: set[tuple] = set()
        same = {ord(c): c for c in set(text)}
        gains: dict[tuple[str, str], dict[int, int]] = {}
        for c in set(text):
            if c > "\x7f" and c not in TYPED and (c in odd or self.bits.get(c, UNSEEN_BITS) >= 12):
                for xy, to in self._cheaper(c):
                    gains.setdefault(xy, {})[ord(c)] = to
        for x in READ_SINGLE:
            if share[x] == 0:
                continue
            encode = _ENCODE[x]
            lines = self._runs(text, _RUNS[x], encode, costs)
            out = self._utf8_pieces(text, lines, decoded)
            if out is not None:
                if x in ("cp1252", "latin_1") and (twice := self._utf8_pieces(out, self._runs(out, _RUNS["cp1252"], _ENCODE["cp1252"], costs), decoded)) is not None:
                    yield twice, 2
                yield out, 1
            for runs in (self._runs(text, _HIGH[x], encode, costs), lines):
                key = tuple((start, data) for start, _, _, data, _ in runs)
                if key not in met:
                    met.add(key)
                    for y in WRITTEN_DOUBLE:
                        if (out := self._pieces(text, runs, y, decoded)) is not None:
                            yield out, 1
            for y in WRITTEN_SINGLE:
                if gain := gains.get((x, y)):
                    if (out := made.get(key := tuple(sorted(gain.items())))) is None:
                        out = made[key] = text.translate(same | gain)
                    if not (n := len(_MIXED.findall(out))) or n < mixed:
                        yield out, 1
        wide = "".join(c for c in odd if c >= "\u2e80" and c != "\ufffd")
        share = {x: len(wide.encode(x, "ignore").decode(x, "ignore")) for x in READ_DOUBLE}
        for x in READ_DOUBLE:
            if share[x] == 0:
                continue
            data = text.encode(x, "quire_nul")
            if _UTF8.search(data) and (out := self._utf8(data, x)) is not None:
                yield out, 1
            wide_runs = [(m.start(), m.end(), s, s.encode(x, "quire_nul")) for m in _NON_ASCII.finditer(text) if (n := len(odd.intersection(s := m.group()))) > 1 or n == 1 and len(s) <= 8]
            wide_runs = [r for r in wide_runs if r[3].count(0) < len(r[2])]
            for y in (*WRITTEN_DOUBLE, "cp1252", "cp1251"):
                if x != y and (out := self._remap(wide_runs, text, y, x, costs)) is not None:
                    yield out, 1
        if (out := self._swap(text, odds)) is not None:
            yield out, 1

    def _cheaper(self, c: str) -> list[tuple[tuple[str, str], int]]:
        """The single-byte readings and writings by which a character gets cheaper, and what it becomes."""
        if (got := self.cheaper.get(c)) is None:
            v = max(self.bits.get(c, UNSEEN_BITS), 14.0) - CHEAPER_BITS
            self.cheaper[c] = got = [(xy, to) for xy, table in _MAPS.items() if (to := table.get(ord(c))) is not None and self.bits.get(chr(to), UNSEEN_BITS) <= v]
        return got

    def _runs(self, text, pattern, encode, costs) -> list[tuple[int, int, str, bytes, float]]:
        """The runs of a text that a single-byte encoding can write, as bytes, with their cost."""
        out = []
        for m in pattern.finditer(text):
            if not (s := m.group()).isascii():
                if (cost := costs.get(s)) is None:
                    costs[s] = cost = self.cost(s)
                out.append((m.start(), m.end(), s, encode(s), cost))
        return out

    @staticmethod
    def _patched(text: str, patches: list[tuple[int, int, str]]) -> str | None:
        if not patches:
            return None
        parts, at = [], 0
        for start, end, t in patches:
            parts += [text[at:start], t]
            at = end
        return "".join(parts) + text[at:]

    def _pieces(self, text, runs, y, decoded) -> str | None:
        """Decode each run of two characters or more where that makes it cheaper."""
        new = [data for _, _, s, data, _ in runs if len(s) > 1 and (data, y) not in decoded]
        # in one go: a line end is never part of another character and no run has one
        for data, t in zip(new, _unit(b"\n".join(new), y).split("\n")):
            decoded[data, y] = (t, math.inf if t.count(LOST) * 10 > len(t) else self.cost(t))
        patches = [(start, end, got[0]) for start, end, s, data, cost in runs if len(s) > 1 and (got := decoded[data, y])[1] < cost - CHEAPER_BITS]
        return self._patched(text, patches)

    def _utf8_pieces(self, text, runs, decoded) -> str | None:
        """Decode the UTF-8 sequences of each run where that makes them cheaper."""
        patches = []
        for start, end, s, data, _ in runs:
            if (s, data) not in decoded:
                decoded[s, data] = self._utf8(data, None, s)
            if (t := decoded[s, data]) is not None:
                patches.append((start, end, t))
        return self._patched(text, patches)

    def _utf8(self, data: bytes, x: str | None, text: str | None = None) -> str | None:
        """Replace the UTF-8 sequences in bytes; the rest goes back to what it read as."""
        parts, at, ok = [], 0, False
        rest = (lambda b: b.decode(x, "replace").replace("\ufffd", LOST)) if x else None
        for m in _UTF8.finditer(data):
            new = m.group().decode("utf-8", "replace").replace("\ufffd", LOST)
            old = rest(m.group()) if rest else text[m.start() : m.end()]
            if self.cost(new) < self.cost(old) - CHEAPER_BITS:
                parts += [rest(data[at : m.start()]) if rest else text[at : m.start()], new]
                at, ok = m.end(), True
        if not ok:
            return None
        return "".join(parts) + (rest(data[at:]) if rest else text[at:])

    def _remap(self, runs, text: str, y: str, x: str, costs) -> str | None:
        """Runs of characters of a double-byte reading, decoded as another writing."""
        get, patches = self.bits.get, []
        for start, end, s, data in runs:
            if (cost := costs.get(s)) is None:
                costs[s] = cost = self.cost(s)
            t = _unit(data, y)
            gain = cost - self.cost(t)
            if gain >= CHEAPER_BITS and gain >= 1.5 * len(s) and t.count(LOST) * 5 <= len(t):
                patches.append((start, end, t))
            elif len(t) == len(s) and x != "gb18030" and y in WRITTEN_DOUBLE:
                new = "".join(b if b != LOST and get(a, UNSEEN_BITS) - get(b, UNSEEN_BITS) >= CHEAPER_BITS else a for a, b in zip(s, t))
                if sum(a != b for a, b in zip(s, new)) >= 2:
                    patches.append((start, end, new))
        return self._patched(text, patches)

    def _swap(self, text: str, odds: str) -> str | None:
        """Code units with their bytes the other way round, over the stretch that gains most."""
        get = self.bits.get
        if sum(get(chr((o & 255) << 8 | o >> 8), UNSEEN_BITS) < 16 for o in map(ord, odds) if o < 0x10000) < 2:
            return None
        other = text.encode("utf-16-le", "surrogatepass").decode("utf-16-be", "replace")
        if len(other) != len(text):
            return None
        best, start, run, span = 0.0, 0, 0.0, (0, 0)
        for i, (a, b) in enumerate(zip(text, other)):
            if run <= 0:
                run, start = 0.0, i
            run += get(a, UNSEEN_BITS) - get(b, UNSEEN_BITS)
            if run > best:
                best, span = run, (start, i + 1)
        return text[: span[0]] + other[span[0] : span[1]] + text[span[1] :] if best >= 3 * CHEAPER_BITS else None

    def restore(self, text: str, odd: set[str]) -> str:
        """The decoding of least description length, or the text itself."""
        for _ in range(MOST_STEPS):
            if not odd:
                break
            offers: dict[str, int] = {}
            for t, n_steps in self.steps(text, odd):
                offers[t] = min(n_steps, offers.get(t, n_steps))
            if not offers:
                break
            best, least = None, self.length(text)
            for t, n_steps in offers.items():
                cost = CHAIN_COST * n_steps
                # what is lost and the chain cost so much whatever the rest packs to
                if cost + LOST_COST * t.count(LOST) < least and (n := self.length(t) + cost) < least:
                    best, least = t, n
            if best is None:
                break
            text = best
            odd = self.odd(text)
        return text.replace(LOST, "\ufffd")

    def wrong(self, text: str | None) -> bool:
        """Whether a field was decoded wrongly: what `judge` says of it, without the restored form.

        A field is named when any chain is shorter than leaving it as it is, so the
        first such chain decides; which one is the shortest makes no difference here.
        """
        if not text or text.isascii():
            return False
        if _BROKEN.search(text):
            return True
        odd = self.odd(text)
        if not odd:
            return False
        if not all(map(_assigned, odd)):
            return True
        whole, met = self.length(text), {text}
        for t, n_steps in self.steps(text, odd):
            if t not in met:
                met.add(t)
                room = whole - CHAIN_COST * n_steps - LOST_COST * t.count(LOST)
                data = t.replace(LOST, "").encode("utf-8", "surrogatepass")
                if room > 0 and any(len(p.compress(data)) < room for p in self.packers.values()):
                    return True
        return False

    def judge(self, text: str | None) -> tuple[bool, str | None]:
        """Whether a field was decoded wrongly, and the field restored."""
        if not text or text.isascii():
            return False, text
        broken = _BROKEN.search(text) is not None
        odd = self.odd(text)
        if not odd:
            return broken, text
        fixed = self.restore(text, odd)
        return broken or fixed != text or not all(map(_assigned, odd)), fixed


#: What is counted in rows of a language: `counts[kind][form]`.
Counts = dict[str, Counter]
#: Counted forms that a task holds before it passes them on.
MOST_FORMS = 400_000


def _chars(counts: Counts, texts: list[str]) -> None:
    """Characters, the rows that have them, and rows."""
    codes, size = code_points(texts)
    n = np.bincount(codes)
    present = np.flatnonzero(n)
    place = np.zeros(len(n), np.uint16 if len(present) <= 65536 else np.uint32)
    place[present] = np.arange(len(present))
    places = place[codes]
    order = np.argsort(places, kind="stable")  # by character, and the rows of each in order
    places, row = places[order], np.repeat(np.arange(len(texts), dtype=np.int32), size)[order]
    first = np.ones(len(row), bool)
    first[1:] = (places[1:] != places[:-1]) | (row[1:] != row[:-1])
    chars = list(map(chr, present.tolist()))
    counts["char"].update(dict(zip(chars, n[present].tolist())))
    counts["having"].update(dict(zip(chars, np.bincount(places[first]).tolist())))
    counts["rows"][""] += len(texts)


class _Prices:
    """Bits a character of each row, in thousandths."""

    def __init__(self, bits: dict[str, float]):
        self.bits = _Bits(bits)
        self.table = np.full(0x110000, UNSEEN_BITS)
        self.table[[ord(c) for c in bits]] = list(bits.values())

    def of(self, texts: list[str]) -> list[int]:
        codes, size = code_points(texts)
        return np.rint(1000 * np.add.reduceat(self.table[codes], np.cumsum(size) - size) / size).astype(int).tolist()

    def count(self, counts: Counts, texts: list[str]) -> None:
        counts["price"].update(map(str, self.of(texts)))


def pieces(texts: list[str]) -> Iterator[str]:
    """Texts cut wherever two characters have a certain hash, so that equal passages give equal pieces."""
    text = "".join(texts)
    codes, size = code_points([text])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    cut_after = np.zeros(len(codes), bool)
    cut_after[1:] = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(29) == 0
    cut_after[ends[:-1]] = False  # the hash of two rows
    cut_after[ends - 1] = True
    at = 0
    for to in (np.flatnonzero(cut_after) + 1).tolist():
        while to - at > LONGEST_PIECE:
            yield text[at : at + LONGEST_PIECE]
            at += LONGEST_PIECE
        yield text[at:to]
        at = to


#: Code points that begin UTF-8 read by single bytes, and those that are judged in context.
_LEADS_READ, _IN_CONTEXT = 1, 2
_FLAGS = np.zeros(0x110000, np.uint8)
_FLAGS[[ord(c) for c in _LEADING]] |= _LEADS_READ
_FLAGS[[ord(c) for c in _LETTERS]] |= _IN_CONTEXT


class _Kept:
    """Characters, contexts and pieces of the rows that are learned from."""

    def __init__(self, bits: dict[str, float], most: dict[str, float]):
        self.prices, self.most = _Prices(bits), most

    def count(self, counts: Counts, texts: list[str], lang: str) -> None:
        bits, most = self.prices.bits, self.most[lang]
        codes, size = code_points(texts)
        flags = np.bitwise_or.reduceat(_FLAGS[codes], np.cumsum(size) - size).tolist()
        kept = []
        for price, flag, t in zip(self.prices.of(texts), flags, texts):
            if price <= most and not (flag & _LEADS_READ and _read_singly(t, set(t), bits)):
                kept.append(t)
                if flag & _IN_CONTEXT:
                    counts["context"].update({m.group(0) + t[m.end() : m.end() + 1] for m in _CONTEXT.finditer(t)})
        if kept:
            _chars(counts, kept)
            counts["piece"].update(pieces(kept))


def _bits(counts: dict[str, Counts]) -> dict[str, float]:
    """Cost of a character where it is likeliest; one in too few rows is not known."""
    out: dict[str, float] = {}
    for c in counts.values():
        total, least = sum(c["char"].values()), max(2, KNOWN_SHARE * c["rows"][""])
        for char in (char for char, k in c["having"].items() if k >= least):
            out[char] = min(out.get(char, UNSEEN_BITS), -math.log2(c["char"][char] / total))
    return out


def _most(prices: Counter) -> float:
    """The dearest price of a row that is learned from."""
    middle, upto = sum(prices.values()) // 2, 0
    for price in sorted(map(int, prices)):
        upto += prices[str(price)]
        if upto > middle:
            return DEAREST * price
    return 0.0


def dictionary(counted: dict[str, int]) -> bytes:
    """A dictionary from pieces, each as often as it stands in the corpus beside the rarest of them."""
    least = min(counted.values(), default=1)
    often = [p.encode("utf-8", "surrogatepass") for p, n in sorted(counted.items()) for _ in range(min(MOST_TIMES, round(n / least)))]
    random.Random(1).shuffle(often)
    data = [b"".join(often[i : i + 30]) for i in range(0, len(often), 30)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data, level=1).as_bytes()
    except zstandard.ZstdError:  # too few of them: the pieces themselves
        return b"".join(data)[-DICTIONARY_BYTES:].ljust(8, b" ")


def _learned(tally: Callable[[Callable], dict[str, Counts]]) -> tuple:
    """The model's parts; `tally` counts in all rows what it is told to."""
    bits = _bits(tally(lambda counts, texts, lang: _chars(counts, texts)))
    prices = _Prices(bits)
    most = {lang: _most(c["price"]) for lang, c in tally(lambda counts, texts, lang: prices.count(counts, texts)).items()}
    kept = tally(_Kept(bits, most).count)
    # a row by itself, or a few that are decoded wrongly alike, make no context known
    contexts = {k for c in kept.values() for k, n in c["context"].items() if n >= max(2, KNOWN_SHARE * c["rows"][""])}
    return {lang: dictionary(c["piece"]) for lang, c in kept.items()}, _bits(kept), contexts


def _gain(n: int, size: int) -> int:
    """Step of the bytes that a piece has in the corpus."""
    return int(8 * math.log2(n * size))


def _room(steps: dict[int, int]) -> tuple[int, float]:
    """The step down to which pieces fit PIECE_BYTES, and the share of that last step that fits."""
    room = PIECE_BYTES
    for step in sorted(steps, reverse=True):
        if steps[step] > room:
            return step, room / steps[step]
        room -= steps[step]
    return min(steps, default=0), 1.0


def train(by: dict[str, list[str]]) -> tuple:
    """The model's parts from rows at hand, all of them."""

    def tally(count: Callable) -> dict[str, Counts]:
        out: dict[str, Counts] = {lang: defaultdict(Counter) for lang in by}
        for lang, rows in by.items():
            if texts := [t for t in rows if t]:
                count(out[lang], texts, lang)
            if held := out[lang].get("piece"):
                size = {p: len(p.encode("utf-8", "surrogatepass")) for p in held}
                steps = Counter()
                for p, n in held.items():
                    steps[_gain(n, size[p])] += size[p]
                last, share = _room(steps)
                rest = sorted(p for p, n in held.items() if _gain(n, size[p]) == last)
                rest = set(rest[: math.ceil(share * len(rest))])
                out[lang]["piece"] = Counter({p: n for p, n in held.items() if _gain(n, size[p]) > last or p in rest})
        return out

    return _learned(tally)


def _tables() -> tuple[np.ndarray, dict[str, str]]:
    """The script of each code point by its place among SCRIPT_LANGUAGES, and the language of each function word."""
    script = np.zeros(0x110000, np.uint8)
    for i, cls in enumerate(SCRIPT_LANGUAGES.values(), 1):
        ends = [int(x, 16) for x in re.findall(r"x\{(\w+)\}", cls)]
        for first, last in zip(ends[::2], ends[1::2]):
            script[first : last + 1] = i
    script[[0xFFFD, *range(0x80, 0x85), *range(0x86, 0xA0), *range(0xE000, 0xF900)]] = len(SCRIPT_LANGUAGES) + 1
    return script, {word: lang for lang, words in FUNCTION_WORDS.items() for word in words.split("|")}


_SCRIPT, _WORD_OF = _tables()


def parted(texts: list[str], lang: str | None = None) -> dict[str, list[str]]:
    """Texts without broken code points by a coarse language tag, or under the one given.

    Eight characters of a script tell it, else the most frequent function words.
    """
    out: dict[str, list[str]] = defaultdict(list)
    if not texts:
        return out
    codes, size = code_points(texts)
    kinds = len(SCRIPT_LANGUAGES) + 2
    n = np.bincount(np.repeat(np.arange(len(texts)) * kinds, size) + _SCRIPT[codes], minlength=kinds * len(texts)).reshape(-1, kinds)
    many = n[:, 1:-1] >= 8
    langs = list(SCRIPT_LANGUAGES)
    for t, broken, found, first in zip(texts, n[:, -1].tolist(), many.any(1).tolist(), many.argmax(1).tolist()):
        if not broken:
            if found or lang:
                out[lang or langs[first]].append(t)
            else:
                hits = Counter(map(_WORD_OF.get, t.lower().split()))
                out[max(FUNCTION_WORDS, key=lambda x: (hits[x], x))].append(t)
    return out


def _counted(rows: DataFrame, count: Callable) -> DataFrame:
    """(`lang`, `kind`, `form`, `n`): what `count` counts in all rows (`text`, `lang` or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = defaultdict(lambda: defaultdict(Counter))

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, kinds in held.items():
                for kind, forms in kinds.items():
                    names = [pa.array([x] * len(forms), pa.string()) for x in (lang, kind)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64())], names=["lang", "kind", "form", "n"])
            held.clear()

        for batch in batches:
            by = defaultdict(list)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by[lang].append(text)
            for name, of in by.items():
                for lang, texts in parted(of, name).items():
                    count(held[lang], texts, lang)
            if sum(len(forms) for kinds in held.values() for forms in kinds.values()) > MOST_FORMS:
                yield from passed_on()
        yield from passed_on()

    return rows.mapInArrow(run, "lang string, kind string, form string, n bigint").groupBy("lang", "kind", "form").agg(F.sum("n").alias("n"))


def fit(fields: DataFrame) -> tuple:
    """The model's parts from all rows of (`_id`, `text`, `source`).

    Rows with broken code points are left out, and so are the dearest rows of
    each language under a first estimate of the costs and those with passages that
    are cheaper as UTF-8, which is where wrongly decoded rows are. Names of sources are a stratum of their own.
    Counts are summed where the rows lie; the driver gets those of characters, prices
    and known contexts, bounded by Unicode and KNOWN_SHARE, and PIECE_BYTES of pieces a language.
    """
    names = cut(fields.select(F.col("source").alias("text")).filter(F.length("text") > 0).distinct())
    rows = fields.select("text", F.lit(None).cast("string").alias("lang")).filter(F.length("text") >= 12).unionByName(names.withColumn("lang", F.lit("source")))

    def tally(count: Callable) -> dict[str, Counts]:
        out: dict[str, Counts] = defaultdict(lambda: defaultdict(Counter))
        found = _counted(rows, count)
        if isinstance(getattr(count, "__self__", None), _Kept):
            found = cut(found)
            of = found.filter("kind = 'rows'").select("lang", F.col("n").alias("_of"))
            known = found.filter("kind = 'context'").join(F.broadcast(of), "lang").filter(F.col("n") >= F.greatest(F.lit(2), KNOWN_SHARE * F.col("_of"))).drop("_of")
            size = F.octet_length("form")
            held = found.filter("kind = 'piece'").withColumn("_step", F.floor(8 * F.log2(F.col("n") * size)))
            steps: dict[str, dict[int, int]] = defaultdict(dict)
            for lang, step, n in held.groupBy("lang", "_step").agg(F.sum(size)).collect():
                steps[lang][step] = n
            last = [(lang, *_room(s)) for lang, s in steps.items()]
            last = fields.sparkSession.createDataFrame(last, "lang string, _last bigint, _share double")
            # of the last step as many as fit, by their hash: they are worth the same
            fits = (F.col("_step") > F.col("_last")) | (F.col("_step") == F.col("_last")) & (F.pmod(F.xxhash64("form"), F.lit(1000)) < 1000 * F.col("_share"))
            held = held.join(F.broadcast(last), "lang").filter(fits).drop("_step", "_last", "_share")
            found = found.filter("kind NOT IN ('context', 'piece')").unionByName(known).unionByName(held)
        for lang, kind, form, n in found.collect():
            out[lang][kind][form] = n
        return out

    return _learned(tally)


JUDGED = T.StructType([T.StructField("bad", T.BooleanType()), T.StructField("fixed", T.StringType())])
#: Answers about fields that a task keeps, because fields repeat.
MEMO = 20_000


def _field_udf(spark: SparkSession, fields: DataFrame, ask, kind: T.DataType):
    """A vectorised function of a string column: what a fitted model says of each field.

    What is sent to every executor is bounded: DICTIONARY_BYTES a language and
    one number for each code point of the corpus.
    """
    shared = spark.sparkContext.broadcast(fit(fields))

    def answers(parts: Iterator[pd.Series]) -> Iterator[list]:
        model = Model(*shared.value)
        memo: dict[str | None, object] = {}
        for s in parts:
            out = []
            for t in s:
                if t not in memo:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[t] = ask(model, t)
                out.append(memo[t])
            yield out

    if isinstance(kind, T.StructType):

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for out in answers(parts):
                yield pd.DataFrame(out, columns=kind.names)

        run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, kind)

    def plain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for out in answers(parts):
            yield pd.Series(out)

    plain.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(plain, kind)


def judge_udf(spark: SparkSession, fields: DataFrame):
    """Was a field decoded wrongly, and its restored form."""
    return _field_udf(spark, fields, Model.judge, JUDGED)


def wrong_udf(spark: SparkSession, fields: DataFrame):
    """Was a field decoded wrongly."""
    return _field_udf(spark, fields, Model.wrong, T.BooleanType())


def restore_fields(blocks: DataFrame, columns: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """All rows with `<column>_bad` and `<column>_fixed` for each of the columns."""
    judged = judge_udf(blocks.sparkSession, blocks.select(F.col("block_id").alias("_id"), "text", "source"))
    out = blocks
    for c in columns:
        out = out.withColumn(f"_q_{c}", judged(F.col(c)))
    for c in columns:
        out = out.withColumn(f"{c}_bad", F.col(f"_q_{c}.bad")).withColumn(f"{c}_fixed", F.col(f"_q_{c}.fixed")).drop(f"_q_{c}")
    return out


def wrong_fields(blocks: DataFrame) -> DataFrame:
    """(`block_id`, `field`) of the fields that were decoded wrongly: those that `restore_fields` finds bad."""
    wrong = wrong_udf(blocks.sparkSession, blocks.select(F.col("block_id").alias("_id"), "text", "source"))
    judged = blocks.select("block_id", *[wrong(F.col(c)).alias(c) for c in ("text", "source")])
    named = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("text", "source")]))
    return judged.select("block_id", F.explode(named).alias("field"))
