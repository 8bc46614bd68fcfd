"""Splitting oversized texts at natural boundaries (problem 8).

Method: a text becomes a string of one letter a token, which says how strong
the boundary after the token is. A regular expression with bounded quantifiers
takes pieces from it: its alternatives are ordered by boundary strength, each
consumes up to the limit, and the last ones fall back to any whole character.
Offsets looked back from each cut give the overlap, with array functions.

Defined results
---------------
* texts within the limit, null and empty texts give no pieces;
* a piece holds at most `max_tokens` tokens of its own encoding;
* consecutive pieces share `overlap_tokens` tokens, and up to three more where
  that place is inside a character; without overlap they abut;
* where the limit leaves less than `SPARE` new tokens beside the overlap, the
  limit holds and a piece shares what it has room for;
* pieces cover the text; between two boundaries of equal strength the later wins;
* a boundary is taken only in the second half of the room, so that no strong
  boundary makes pieces tiny, except where none is there;
* a profile with `max_tokens` below `SPARE`, which cannot hold any character, or
  not above its overlap raises ValueError before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZERS, encoder, slices

#: Tokens kept free, because a character holds up to four.
SPARE = 4
#: Pieces of a text whose ends are summed one after the other.
RUN = 512

# Boundary letters from strong to weak, and the marks before them.
STRENGTHS = "plscwx"  # paragraph, line, sentence, clause, word, character; b: inside a character
SENTENCE_MARKS = "。！？…।؟"
SPACED_MARKS = ".!?"
CLAUSE_MARKS = "，、；：,;:)）】」』》”"


_SENTENCE, _SPACED, _CLAUSE, _SPACE, _LINE = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    """Kind of each code point, for one look-up a character."""
    out = np.zeros(0x110000, np.uint8)
    for chars, kind in ((SENTENCE_MARKS, _SENTENCE), (SPACED_MARKS, _SPACED), (CLAUSE_MARKS, _CLAUSE), (" \t\r\u00a0\u2003\u2009\u3000", _SPACE), ("\n", _SPACE | _LINE)):
        out[[ord(c) for c in chars]] = kind
    return out


def _letters() -> np.ndarray:
    """Letter of the boundary between two kinds of characters."""
    out = np.full((32, 32), ord("x"), np.uint8)
    for a in range(32):
        for b in range(32):
            if (a | b) & _SPACE:
                out[a, b] = ord("w")
            if a & _CLAUSE:
                out[a, b] = ord("c")
            if a & _SENTENCE or a & _SPACED and b & _SPACE:
                out[a, b] = ord("s")
            if a & _LINE:
                out[a, b] = ord("x") if b & _LINE else ord("l")
    return out.ravel()


_KIND, _LETTER = _kinds(), _letters()


def boundaries(text: str) -> np.ndarray:
    """Letter of the boundary after each character of a text, as bytes."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _KIND[code]
    at = np.full(len(k), ord("x"), np.uint8)
    at[:-1] = _LETTER[(k[:-1].astype(np.uint16) << 5) | k[1:]]
    done = at[:-1] == ord("s")
    at[1:][done & (k[1:] == _SPACE)] = ord("s")  # the space after a sentence goes with it
    line = k == _SPACE | _LINE
    blank = line[1:] & line[:-1] & (at[1:] == ord("l"))
    if "\r" in text:
        blank[1:] |= line[2:] & (code[1:-1] == 13) & line[:-2] & (at[2:] == ord("l"))
    at[1:][blank] = ord("p")
    at[-1:] = ord("p")
    return at


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all offsets in the bytes of texts, one after the other: letters and places, and where each text begins.

    A place is the bytes up to the offset times 2^32 plus the characters, within its
    text; inside a character the letter is b and the place -1. One zero stands
    between texts, so that no boundary is made by the characters of two.
    """
    joined = "\x00".join([*texts, ""])
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # one a character
    chars = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(chars) - chars
    at = boundaries(joined)
    at[begins + chars - 2] = ord("p")  # of an empty text, that of the zero before it, which no text asks for
    letters = np.full(len(data), ord("b"), np.uint8)
    letters[starts[1:]] = at[:-1]
    place = np.full(len(data), -1, np.int64)
    place[starts] = (starts << 32 | np.arange(len(starts))) - np.repeat(starts[begins] << 32 | begins, chars)
    return letters, place, starts[begins]


def shapes(documents: DataFrame, tokenizers: dict[str, int], folder: str = TOKENIZERS) -> DataFrame:
    """(`doc_id`, `tokenizer`, `shape`, `ends`, `text`) of texts above the least limit of each tokenizer.

    `shape` has a boundary letter for each token, and `ends` the bytes up to its end
    times 2^32 plus the characters; -1 where a token ends inside a character. `text`
    comes as bytes, of which a piece is taken without counting characters.
    """
    names = tuple(sorted(tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(names, folder)
        for batch, texts in slices(batches, "text", 1_000_000):
            encoded = enc.batch(texts)
            rows = [(i, k) for i in range(len(texts)) for k, name in enumerate(names) if len(encoded[k][i]) > tokenizers[name]]
            if not rows:
                continue
            large = list(dict.fromkeys(i for i, _ in rows))
            letters, place, begins = places([texts[i] for i in large])
            begin = dict(zip(large, begins))
            upto = np.cumsum([0, *(len(encoded[k][i]) for i, k in rows)])
            shape, ends = np.empty(upto[-1], np.uint8), np.empty(upto[-1], np.int64)
            for (i, k), a, b in zip(rows, upto, upto[1:]):
                at = np.cumsum(enc.tries[k].lengths[encoded[k][i]], dtype=np.int64)
                at += begin[i]
                shape[a:b], ends[a:b] = letters[at], place[at]
            upto = pa.array(upto, pa.int32())
            docs = batch.take(pa.array([i for i, _ in rows]))
            yield pa.RecordBatch.from_arrays(
                [docs.column("doc_id"), pa.array([names[k] for _, k in rows]), pa.StringArray.from_buffers(len(rows), upto.buffers()[1], pa.py_buffer(shape)), pa.ListArray.from_arrays(upto, pa.array(ends)), docs.column("text").cast(pa.binary())],
                names=["doc_id", "tokenizer", "shape", "ends", "text"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokenizer string, shape string, ends array<bigint>, text binary")


def pattern(room: int) -> str:
    """Alternatives from strong to weak boundaries, up to `room` tokens each.

    The half in which no strong boundary counts is passed once for all of them, the
    rest of a shape is taken only as a whole, and the dot needn't ask for line ends.
    """
    half = room // 2
    strong = "|".join(f".{{0,{room - 1 - half}}}{s}" for s in STRENGTHS[:-1])
    return f"(?s).{{1,{room}}}+$|.{{{half}}}(?:{strong})|.{{0,{room - 1}}}[{STRENGTHS}]|.{{1,{room}}}"


def ends_of(takes: Column) -> Column:
    """Token offsets where pieces end: the running sum of their lengths.

    Summed in runs of RUN pieces and then over runs, so that the cost of a text
    of very many pieces stays in proportion to them.
    """
    empty = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    summed = lambda xs, of: F.aggregate(xs, empty, lambda acc, x: F.concat(acc, F.array(last(acc) + of(x))))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(takes), F.lit(1)) - 1) / RUN).cast("int")), lambda k: summed(F.slice(takes, k * RUN + 1, RUN), F.length))
    long = F.flatten(F.zip_with(runs, summed(runs, last), lambda run, upto: F.transform(run, lambda x: x + upto - last(run))))
    return F.when(F.size(takes) <= RUN, summed(takes, F.length)).otherwise(long)


def split(documents: DataFrame, profiles: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(`profile`, `doc_id`, `piece_no`, `char_start`, `char_end`, `n_tokens`, `piece`).

    One row a piece; offsets count code points, `char_end` is exclusive. The
    profiles are parameters (a handful of rows) and are read on the driver.
    """
    settings = profiles.select("profile", "tokenizer", "max_tokens", "overlap_tokens").collect()
    for r in settings:
        if r["max_tokens"] < SPARE or r["overlap_tokens"] < 0 or r["max_tokens"] <= r["overlap_tokens"]:
            raise ValueError(f"profile {r['profile']}: a limit of {r['max_tokens']} tokens leaves no room beside an overlap of {r['overlap_tokens']}")
    least: dict[str, int] = {}
    for r in settings:
        least[r["tokenizer"]] = min(r["max_tokens"], least.get(r["tokenizer"], 2**31))
    spark = documents.sparkSession
    schema = "profile string, doc_id bigint, piece_no int, char_start int, char_end int, n_tokens int, piece string"
    if not settings:
        return spark.createDataFrame([], schema)
    shaped = shapes(documents, least, folder)
    cases = []
    tight = any(r["max_tokens"] < r["overlap_tokens"] + 2 * SPARE for r in settings)
    for r in settings:
        room = max(SPARE, r["max_tokens"] - r["overlap_tokens"] - SPARE)
        takes = F.regexp_extract_all("shape", F.lit(pattern(room)), F.lit(0))
        cases.append(
            F.when(
                (F.col("tokenizer") == r["tokenizer"]) & (F.length("shape") > r["max_tokens"]),
                F.struct(F.lit(r["profile"]).alias("profile"), F.lit(int(r["overlap_tokens"])).alias("overlap"), F.lit(int(r["max_tokens"])).alias("most"), takes.alias("takes")),
            )
        )
    # exploded with what the pattern took, which would else be looked for anew wherever it is used
    columns = ("doc_id", "text", "ends")
    one = shaped.select(*columns, F.explode(F.array_compact(F.array(*cases))).alias("p")).select(*columns, "p.profile", "p.overlap", "p.most", "p.takes")
    # a row's pieces are made inside it, so that no row carries its text once a piece
    return one.select("profile", "doc_id", F.explode(pieces_of(ends_of(F.col("takes")), tight)).alias("p")).select(
        "profile", "doc_id", F.col("p.piece_no").cast("int").alias("piece_no"), "p.char_start", "p.char_end", F.col("p.n_tokens").cast("int").alias("n_tokens"), "p.piece"
    )


def pieces_of(cuts: Column, tight: bool) -> Column:
    """The pieces between cuts of a row's `text`.

    A step's results are held as the elements of an array, because an expression
    inside a lambda is worked out anew for each mention.
    """

    def first(cuts, to, i):
        before = F.when(i == 0, 0).otherwise(F.get(cuts, i - 1))
        return before, F.greatest(F.lit(0), before - F.col("overlap")), to, i

    def begun(x):
        before, back, to = x["before"], x["back"], x["to"]
        out = F.when(back == 0, 0)
        for k in range(SPARE):  # out of a character, to where it begins
            out = out.when(F.get("ends", back - (k + 1)) >= 0, back - k)
        return F.struct(before.alias("before"), out.otherwise(0).alias("first"), to.alias("to"), x["i"].alias("i"))

    def fitting(x):
        """The limit holds: to the first character that it leaves room for."""
        before, at, to = x["before"], x["first"], x["to"]
        low = to - F.col("most")
        fits = F.when(at >= low, at)
        for k in range(SPARE):
            fits = fits.when((low + k <= before) & (F.get("ends", low + (k - 1)) >= 0), low + k)
        return F.struct(before.alias("before"), fits.otherwise(before).alias("first"), to.alias("to"), x["i"].alias("i"))

    def placed(x):
        start = F.when(x["first"] == 0, F.lit(0).cast("bigint")).otherwise(F.get("ends", x["first"] - 1))
        return F.struct((x["i"] + 1).alias("no"), (x["to"] - x["first"]).alias("n"), start.alias("start"), F.get("ends", x["to"] - 1).alias("end"))

    def piece(x):
        byte, char = (lambda e: F.shiftright(e, 32).cast("int")), (lambda e: e.bitwiseAND(0xFFFFFFFF).cast("int"))
        text = F.substr("text", byte(x["start"]) + 1, byte(x["end"]) - byte(x["start"])).cast("string")
        return F.struct(x["no"].alias("piece_no"), char(x["start"]).alias("char_start"), char(x["end"]).alias("char_end"), x["n"].alias("n_tokens"), text.alias("piece"))

    held = F.flatten(F.transform(F.array(cuts), lambda c: F.transform(c, lambda to, i: F.struct(*(v.alias(n) for v, n in zip(first(c, to, i), ("before", "back", "to", "i")))))))
    for step in (begun, *([fitting] if tight else ()), placed, piece):
        held = F.transform(held, step)
    return held
