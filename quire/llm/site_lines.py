"""Lines that belong to a site and not to its documents (problem 3).

Method: lines are masked (dates, numbers, names), clustered within their
source by locality-sensitive hashing of character shingles, and clusters of
near-duplicates with a high document frequency are removed from every block.

A cluster is a connected component: masked lines of a source that share a band
and are alike by `SIMILARITY` are linked. All lines of a bucket are compared;
a bucket above `CHUNK` lines is compared chunk against chunk in several groups,
so that none is cut off and no task holds more than two chunks. A cluster is
heavy by the distinct blocks of its verified lines.

Defined results
---------------
* null, empty and blank texts have no lines; such blocks come out unchanged;
* a null source is a source of its own (null) and never a site: no line of it
  is named, because there is no site to repeat it;
* a line, and a cluster, counts once a block, however often it stands there, but
  every occurrence is named;
* blocks delivered twice count twice (``block_id`` is the unit of counting);
* extra columns are carried through, and helper columns start with ``_q_``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut

#: Least blocks and least share of a source's blocks that make a line furniture.
MIN_BLOCKS = 8
MIN_SHARE = 0.05
#: Shingle length in characters, bands and rows of the signature: a pair of
#: similarity 0.8 shares a band with probability 0.94, one of 1.0 always does.
SHINGLE, BANDS, ROWS = 3, 4, 3
SIMILARITY = 0.8
#: Lines of a bucket that meet in one group.
CHUNK = 4096
#: Members of a group that are compared without an index of their shingles.
FEW = 12

# Labels after which a person or site is named.
NAME_LABELS = "责任编辑|编辑|供稿|作者|来源|审核|撰稿|分享人|发布人|联系人|记者|通讯员|校对|by|author|editor|source|contact"


def exact_key(line: Column) -> Column:
    """The line without white space, each run of ASCII digits read as one sign."""
    return F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", ""), "[0-9]+", "0")


def mask(key: Column) -> Column:
    """Dates, numbers and names of a keyed line become one sign each."""
    dates = r"0年0月(?:0日)?|0[-/.]0[-/.]0(?:0:0(?::0)?)?"
    out = F.regexp_replace(key, dates, "\u0001")
    out = F.regexp_replace(out, rf"(?i)((?:{NAME_LABELS})[:：])[^（(|，。,]{{1,24}}", "$1\u0002")
    out = F.regexp_replace(out, "“[^”]{1,40}”", "“\u0002”")
    return F.regexp_replace(out, r"(?:www\.|@)[\w.]+", "\u0003")


_ODD = np.random.default_rng(20240229).integers(1, 2**63, size=(BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and where each line's begin."""
    lens = np.fromiter((max(len(s), SHINGLE) for s in lines), np.int64, len(lines))
    chars = np.frombuffer("".join(s.ljust(SHINGLE, "\x00") for s in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = chars.copy()
    for i in range(1, SHINGLE):
        grams[: len(chars) - i] = grams[: len(chars) - i] * np.uint64(0x9E3779B97F4A7C15) + chars[i:]
    ends = np.cumsum(lens)
    keep = np.ones(len(chars), bool)
    for i in range(1, SHINGLE):
        keep[ends - i] = False
    counts = lens - SHINGLE + 1
    return grams[keep], np.cumsum(counts) - counts


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BANDS band hashes for each line."""
    if not lines:
        return np.zeros((0, BANDS), np.int64)
    grams, starts = _shingles(lines)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        mult, add = _ODD[k]
        h = grams * mult + add
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.minimum.reduceat(h, starts)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ low) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
    return out.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(lines: pd.Series) -> pd.Series:
    return pd.Series(list(signatures(lines.tolist())))


def _alike(x: set, y: set) -> bool:
    a, b = len(x), len(y)
    if min(a, b) < SIMILARITY * max(a, b):
        return False
    both = len(x & y)
    return both >= SIMILARITY * (a + b - both)


def _set(mask: str) -> set[str]:
    return {mask[i : i + SHINGLE] for i in range(max(1, len(mask) - SHINGLE + 1))}


def linked(members: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Links that join all alike members of a group: a forest, never all pairs.

    Two sets alike by `SIMILARITY` share one of the rarest shingles of each, as
    many as may be missing and one more, so only members that do are compared;
    a few members are simply compared with each other.
    """
    if len(members) <= FEW:
        few = [(m, _set(mask)) for m, mask in members]
        part = list(range(len(few)))
        found = []
        for i, (m, x) in enumerate(few):
            for j in range(i):
                if part[i] != part[j] and _alike(x, few[j][1]):
                    found.append((m, few[j][0]))
                    old, new = part[i], part[j]
                    part = [new if p == old else p for p in part]
        return found
    sets = sorted(((len(g := _set(mask)), m, g) for m, mask in members), key=lambda x: x[:2])
    often = Counter(g for *_, s in sets for g in s)
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    seen: dict[str, list[int]] = {}
    out = []
    for i, (n, m, grams) in enumerate(sets):
        rare = sorted(grams, key=lambda g: (often[g], g))[: n - math.ceil(SIMILARITY * n) + 1]
        for j in dict.fromkeys(j for g in rare for j in seen.get(g, ())):
            if sets[j][0] >= SIMILARITY * n and find(i) != find(j) and _alike(grams, sets[j][2]):
                up[find(j)] = find(i)
                out.append((m, sets[j][1]))
        for g in rare:
            seen.setdefault(g, []).append(i)
    return out


def _link(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups whose rows come one after the other."""
    group, members = None, {}
    out: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for p in parts:
        out = []
        rows = zip(*(p.column(c).to_pylist() for c in ("_q_bucket", "_q_lo", "_q_hi", "_q_m", "_q_mask")))
        for bucket, lo, hi, m, mask in rows:
            if group != (bucket, lo, hi):
                if len(members) > 1:
                    out += linked(list(members.items()))
                group, members = (bucket, lo, hi), {}
            members[m] = mask
        yield batch()
    out = linked(list(members.items())) if len(members) > 1 else []
    yield batch()


def components(links: DataFrame) -> DataFrame:
    """(`u`, `root`) of every node of (`u`, `v`) links: the least node of its component.

    Stars are drawn larger and smaller in turn until nothing moves; each round is
    two joins on the links, written to the shared folder.
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            return edges.select("u", F.col("v").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.filter("u <> v").distinct())


def _ids(source: Column, key: Column) -> list[Column]:
    """A line of a source as 96 bits, so that shuffles needn't carry its text."""
    return [F.xxhash64(source, key).alias("_q_a"), F.hash(source, key).alias("_q_b")]


def block_lines(blocks: DataFrame) -> DataFrame:
    """Non-blank lines of blocks with a source, numbered from 1, by their ids."""
    return (
        blocks.filter(F.col("source").isNotNull() & F.col("text").isNotNull())
        .select("block_id", "source", F.posexplode(F.transform(F.split("text", "\n"), exact_key)).alias("_q_pos", "_q_key"))
        .filter(F.col("_q_key") != "")
        .select("block_id", (F.col("_q_pos") + 1).cast("int").alias("line_no"), *_ids(F.col("source"), F.col("_q_key")))
    )


def shared_buckets(members: DataFrame) -> DataFrame:
    """(`_q_m`, `_q_bucket`, `_q_size`), each once, of the buckets that have two masks at least.

    Members are shuffled once; what follows keeps to the buckets.
    """
    size = F.count("*").over(W.partitionBy("_q_bucket"))
    return members.repartition("_q_bucket").distinct().withColumn("_q_size", size).filter("_q_size > 1")


def site_clusters(blocks: DataFrame) -> DataFrame:
    """Lines (`_q_a`, `_q_b`, `root`, `blocks`, `source_blocks`) of clusters that may repeat enough.

    One row a distinct line of a source whose cluster `root` has lines in at least
    MIN_BLOCKS blocks and MIN_SHARE of the source's blocks, each line counted for
    itself: an upper bound of the cluster's own blocks, so no cluster is lost.
    Counting is by hash partitions with partial sums, so a source that holds a
    third of all rows spreads over tasks by its lines. What buckets are counted
    by are numbers; texts follow only for buckets of several lines.
    """
    sources = blocks.filter(F.col("source").isNotNull()).groupBy(F.col("source").alias("_q_source")).agg(F.count("*").cast("int").alias("_q_n"))
    sources = sources.filter(F.col("_q_n") >= MIN_BLOCKS)
    keys = F.array_distinct(F.transform(F.split("text", "\n"), exact_key))
    lines = (
        blocks.filter(F.col("source").isNotNull() & F.col("text").isNotNull())
        .select(F.col("source").alias("_q_source"), F.explode(keys).alias("_q_key"))
        .filter(F.col("_q_key") != "")
        .groupBy("_q_source", "_q_key")
        .agg(F.count("*").cast("int").alias("_q_df"))
        .join(sources, "_q_source")
        .select(*_ids(F.col("_q_source"), F.col("_q_key")), "_q_source", mask(F.col("_q_key")).alias("_q_mask"), "_q_df", "_q_n")
        .withColumn("_q_m", F.xxhash64("_q_source", "_q_mask"))
        .withColumn("_q_bands", _bands("_q_mask"))
        .withColumn("_q_bands", F.transform("_q_bands", lambda h, i: F.xxhash64("_q_source", i, h)))
        .drop("_q_source")
    )
    lines = cut(lines)
    near = shared_buckets(lines.select("_q_m", F.explode("_q_bands").alias("_q_bucket")))
    chunks = F.ceil(F.col("_q_size") / CHUNK)
    mine = F.pmod(F.xxhash64(F.col("_q_m")), chunks)
    near = near.withColumn("_q_mine", mine).withColumn("_q_other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    near = near.select("_q_m", "_q_bucket", F.least("_q_mine", "_q_other").alias("_q_lo"), F.greatest("_q_mine", "_q_other").alias("_q_hi"))
    groups = near.join(lines.select("_q_m", "_q_mask"), "_q_m").repartition("_q_bucket", "_q_lo", "_q_hi").sortWithinPartitions("_q_bucket", "_q_lo", "_q_hi")
    roots = components(groups.select("_q_bucket", "_q_lo", "_q_hi", "_q_m", "_q_mask").mapInArrow(_link, "u bigint, v bigint"))
    placed = lines.select("_q_a", "_q_b", "_q_m", "_q_df", "_q_n").join(roots.withColumnRenamed("u", "_q_m"), "_q_m", "left").withColumn("root", F.coalesce("root", "_q_m")).drop("_q_m")
    total = placed.groupBy("root").agg(F.sum("_q_df").alias("_q_total"), F.max("_q_n").alias("_q_of")).filter(_heavy("_q_total", "_q_of")).select("root")
    return cut(placed.join(total, "root", "left_semi").select("_q_a", "_q_b", "root", F.col("_q_df").alias("blocks"), F.col("_q_n").alias("source_blocks")))


def _heavy(blocks: str, of: str) -> Column:
    return (F.col(blocks) >= MIN_BLOCKS) & (F.col(blocks) >= MIN_SHARE * F.col(of))


def repeated_lines(blocks: DataFrame) -> DataFrame:
    """(`block_id`, `line_no`) of the lines that repeat exactly within their source.

    Rows come from the clusters above; the exact check on the line's own count
    follows (white space out, digit runs as one sign).
    """
    named = site_clusters(blocks).filter(_heavy("blocks", "source_blocks"))
    return block_lines(blocks).join(named.select("_q_a", "_q_b"), ["_q_a", "_q_b"], "left_semi").select("block_id", "line_no")


def strip_site_lines(blocks: DataFrame) -> DataFrame:
    """All blocks with `clean_text`: the text without the lines of repeated clusters."""
    found = cut(block_lines(blocks).join(site_clusters(blocks), ["_q_a", "_q_b"]).select("block_id", "line_no", "root", "source_blocks"))
    counted = found.select("root", "block_id", "source_blocks").distinct().groupBy("root").agg(F.count("*").alias("_q_blocks"), F.max("source_blocks").alias("_q_of"))
    gone = (
        found.join(counted.filter(_heavy("_q_blocks", "_q_of")).select("root"), "root", "left_semi")
        .groupBy("block_id")
        .agg(F.collect_list("line_no").alias("_q_gone"))
        .withColumnRenamed("block_id", "_q_id")
    )
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_q_gone"), (i + 1).cast("int")))
    return (
        blocks.join(gone, F.col("block_id") == F.col("_q_id"), "left")
        .withColumn("clean_text", F.when(F.col("_q_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_q_id", "_q_gone")
    )
