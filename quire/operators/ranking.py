"""Combining ranked lists: fusion, interleaving, expansion and completion."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import DEFAULTS, SECTION_STOPWORDS, EngineConfig
from quire.functions import text as T
from quire.functions.best import Best, places
from quire.operators import dense
from quire.operators.dense import CELLS
from quire.session import cut


def fuse(lists: list[DataFrame], query_id: str, id_col: str, k: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion of (`query_id`, `id`, `rank`) lists with equal weights."""
    every = reduce(DataFrame.unionByName, [x.select(query_id, id_col, "rank") for x in lists])
    score = F.round(F.sum(F.lit(config.fusion_weight) / (F.col("rank") + config.fusion_constant)), 9)
    best = W.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return every.groupBy(query_id, id_col).agg(score.alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def interleave(lists: list[DataFrame], query_id: str, id_col: str, limit: int) -> DataFrame:
    """Round robin over ranked lists: first places first; a text keeps its first place."""
    every = reduce(DataFrame.unionByName, [x.select(query_id, id_col, "rank").withColumn("turn", F.lit(i)) for i, x in enumerate(lists)])
    first = every.groupBy(query_id, id_col).agg(F.min(F.struct("rank", "turn")).alias("at"))
    order = W.partitionBy(query_id).orderBy("at.rank", "at.turn", id_col)
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select(query_id, id_col, "position")


def relevant_only(hits: DataFrame, dense: DataFrame, keys: list[str]) -> DataFrame:
    """Hits that are also among the dense hits above the threshold."""
    return hits.join(dense.select(*keys), keys, "left_semi")


def _section_grams(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"[\x{4E00}-\x{9FFF}]+|[A-Za-z0-9]{2,}"), F.lit(0))
    cut_ = lambda n: F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(r) if n == 2 else F.array().cast("array<string>")).when(F.length(r) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n))))))
    return F.array_distinct(F.concat(cut_(2), cut_(3)))


def section_weights(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """(`question_id`, `section`, `weight`): sections that contain parts of a question.

    Every run of two and three ideographs or word of a question that stands in a
    section adds the square of its length; words that only ask count for nothing.
    Runs meet sections on equal strings (an inverted join), each section once, never
    all against all.
    """
    asked = questions.select("question_id", F.explode(_section_grams(F.col("question"))).alias("gram")).filter(~F.col("gram").isin(*SECTION_STOPWORDS))
    names = sections.filter("section IS NOT NULL AND section <> ''").select("section").distinct()
    names = names.select("section", F.explode(_section_grams(F.col("section"))).alias("gram"))
    return asked.join(names, "gram").groupBy("question_id", "section").agg(F.sum(F.length("gram") * F.length("gram")).alias("weight"))


def question_grams(question: Column) -> Column:
    """The parts of a question that sections are looked through for (see `section_weights`)."""
    return F.filter(_section_grams(question), lambda g: ~g.isin(*SECTION_STOPWORDS))


def heaviest_blocks(groups: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(`question_id`, `block_id`, `weight`): the k blocks in scope whose paths weigh most for a question; ties go to the lower id.

    `groups` (`path`, `tier`, `home`, `ids`) has the first k blocks of each path in a
    tier, in order; `questions` (`question_id`, `grams`, `kind`, `tier_found`) is a stated
    set that is sent to the groups, QUERY_BLOCK at a time, equal ones once. Weights are
    as of `section_weights`; of all pairs only those that can be among the k best
    leave a task.
    """
    best = W.partitionBy("question_id").orderBy(F.desc("weight"), "block_id")
    rows = groups.select(_section_grams(F.col("path")).alias("grams"), "tier", "home", "ids")
    asked = questions.filter("size(grams) > 0").select("question_id", F.array_sort("grams").alias("grams"), "kind", "tier_found")
    first, equal = dense.stands(asked, "question_id", ["grams", "kind", "tier_found"])

    def meet(block: DataFrame) -> tuple[DataFrame, Broadcast] | None:
        # grams hold letters and digits only, so one string carries those of a question
        cases = block.select("question_id", F.array_join("grams", " ").alias("grams"), "kind", "tier_found").collect()
        if not cases:
            return None
        task, shared = _meet_groups(groups.sparkSession, cases, k)
        met = rows.mapInArrow(task, "question_id bigint, block_id bigint, weight bigint")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), shared

    met = dense.in_passes(first, "question_id", meet)
    if met is None:
        return groups.sparkSession.createDataFrame([], "question_id bigint, block_id bigint, weight bigint, rank int")
    return met.withColumnRenamed("question_id", "_first").join(equal, "_first").select("question_id", "block_id", "weight", "rank")


def _meet_groups(spark: SparkSession, cases: list, k: int) -> tuple[Callable, Broadcast]:
    """What a task does with its groups of blocks: weigh their paths for all questions, keep the k best blocks of each; and what is sent for it."""
    grams: dict[str, array] = {}
    for i, case in enumerate(cases):
        for g in case["grams"].split(" "):
            grams.setdefault(g, array("q")).append(i)
    kinds, tiers = [c["kind"] for c in cases], [c["tier_found"] for c in cases]
    shared = spark.sparkContext.broadcast((
        np.array([c["question_id"] for c in cases], np.int64),
        {g: i for i, g in enumerate(grams)},
        np.array([len(g) ** 2 for g in grams], np.float64),
        np.cumsum([0, *map(len, grams.values())]),
        np.concatenate([np.frombuffer(x, np.int64) for x in grams.values()]),
        np.array([kind == "all" for kind in kinds]),
        np.array([kind == "local" for kind in kinds]),
        np.array([tier if kind == "tier" and tier is not None else "" for kind, tier in zip(kinds, tiers)], object),
        np.array([kind == "tier" and tier is not None for kind, tier in zip(kinds, tiers)]),
    ))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stands, known, squares, begins, askers, free, local, tiers, tiered = shared.value
        n = len(stands)
        best, step = Best(n, k), max(1, CELLS // n)
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                m = len(batch)
                pairs = [(r, v) for r, gs in enumerate(batch.column("grams").to_pylist()) for g in gs or () if (v := known.get(g)) is not None]
                if not pairs:
                    continue
                r, v = np.array(pairs, np.int64).T
                many = begins[v + 1] - begins[v]
                # every gram of a path meets all who ask for it
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cell = np.repeat(r, many) + m * askers[np.repeat(begins[v], many) + place]
                weight = np.bincount(cell, np.repeat(squares[v], many), n * m).reshape(n, m)
                home, tier = np.array(batch.column("home").to_pylist(), bool), np.array(batch.column("tier").to_pylist(), object)
                fits = free[:, None] | local[:, None] & home[None] | tiered[:, None] & (tiers[:, None] == tier[None])
                q, r = np.nonzero((weight > 0) & (weight >= best.edge[:, None]) & fits)
                w = weight[q, r]
                ids = batch.column("ids")
                starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
                size = np.diff(starts)
                # a group that k others stand before has no block among the best
                order = np.lexsort((flat[starts[:-1]][r], -w, q))
                q, r, w = q[order], r[order], w[order]
                kept = places(q) < k
                q, r, w = q[kept], r[kept], w[kept]
                part = max(1, CELLS // k)
                for a in range(0, len(q), part):
                    each = size[r[a : a + part]]
                    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    best.offer(np.repeat(q[a : a + part], each), np.repeat(w[a : a + part], each), flat[np.repeat(starts[:-1][r[a : a + part]], each) + place])
        q, w, i = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(stands[q], pa.int64()), pa.array(i, pa.int64()), pa.array(w.astype(np.int64))], names=["question_id", "block_id", "weight"])

    return meet, shared


def section_hits(sections: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(`question_id`, `block_id`, `weight`, `rank`): the k blocks whose sections weigh most for a question."""
    weights = section_weights(sections, questions)
    # blocks of one section weigh the same, so only its first k can be among the best
    within = W.partitionBy("section").orderBy("block_id")
    first = sections.select("block_id", "section").withColumn("n", F.row_number().over(within)).filter(F.col("n") <= k).drop("n")
    return top(weights.join(first, "section").select("question_id", "block_id", "weight"), ["question_id"], "weight", "block_id", k)


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds `position` from 1 within groups."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))


def top(rows: DataFrame, groups: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest score in each group, with `rank`; ties go to the lower `tie`."""
    best = W.partitionBy(*groups).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def expand_small_sources(hits: DataFrame, chunks: DataFrame, limit: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Hits in order, each with all blocks of its source where the source is small.

    `hits` (`question_id`, `block_id`, `rank`), `chunks` (`block_id`, `source`).
    Sources above the gate are never expanded, so no source's size matters.
    """
    small = chunks.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") <= config.small_source_max).select("source")
    found = hits.join(chunks.select("block_id", "source"), "block_id")
    members = chunks.join(small, "source", "left_semi").select("source", F.col("block_id").alias("member"))
    more = found.join(members, "source").select("question_id", F.col("member").alias("block_id"), "rank", F.lit(0).alias("stage"))
    own = found.select("question_id", "block_id", "rank", F.lit(1).alias("stage"))
    first = more.unionByName(own).groupBy("question_id", "block_id").agg(F.min(F.struct("rank", "stage")).alias("at"))
    order = W.partitionBy("question_id").orderBy("at.rank", "block_id")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("question_id", "block_id", "position")


def complete_sources(hits: DataFrame, chunks: DataFrame, limit: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`question_id`, `block_id`, `position`): all blocks of the sources that were hit, sources by first hit, up to a limit.

    `chunks` has `block_id`, `source`, `page`, `path`, `section` and `text`. A source
    with more blocks than `summary_full_source_max` gives only blocks whose path
    begins with the path of a hit in it or begins one; if no hit in it has a path, all.
    Blocks without a path always count. Within a source blocks go by page (none last),
    path, section and text, then id.

    Blocks are put in order once, for all questions, which then carry numbers and no
    texts. Sources that begin after the limit is reached are left out before any block
    is met. Large sources are narrowed by their distinct paths, and blocks then meet what
    is left on equality; only sources within the gate meet hits whole.
    """
    chunks = chunks.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("path", "section")}).filter("source IS NOT NULL")
    found = hits.join(chunks.select("block_id", "source", "path"), "block_id")
    first = found.groupBy("question_id", "source").agg(F.min("rank").alias("first_hit"), F.collect_set(F.when(F.col("path") != "", F.col("path"))).alias("hits"))
    sizes = chunks.groupBy("source").agg(F.count("*").alias("n"))
    # a small source gives all its blocks, a large one at least the one that was hit
    least = F.when(F.col("n") <= config.summary_full_source_max, F.col("n")).otherwise(1)
    before = F.sum(least).over(W.partitionBy("question_id").orderBy("first_hit", "source").rowsBetween(W.unboundedPreceding, -1))
    first = first.join(sizes, "source").withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < limit).drop("_before")
    place = (F.col("page").isNull(), F.coalesce("page", F.lit(0)), "path", "section", F.coalesce("text", F.lit("")), "block_id")
    kept = ["question_id", "first_hit", "source", "block_id", "place"]
    chunks = cut(chunks.orderBy("source", *place).select("source", "path", "block_id", F.monotonically_increasing_id().alias("place")))
    small = first.filter(F.col("n") <= config.summary_full_source_max).join(chunks, "source").select(*kept)
    large = first.filter(F.col("n") > config.summary_full_source_max)
    # which paths of a source belong to a path that was hit, once for all questions that hit it
    named = chunks.select("source", "path").distinct()
    asked = large.select("question_id", "first_hit", "source", F.explode("hits").alias("hit"))
    belong = asked.select("source", "hit").distinct().join(named, "source").filter(F.col("path").startswith(F.col("hit")) | F.col("hit").startswith(F.col("path")))
    paths = asked.join(belong, ["source", "hit"]).select("question_id", "first_hit", "source", "path").distinct()
    paths = paths.unionByName(large.filter(F.size("hits") == 0).join(named, "source").select("question_id", "first_hit", "source", "path"))
    # no more than the first `limit` blocks of a path of a source can be kept
    heads = chunks.join(sizes.filter(F.col("n") > config.summary_full_source_max).select("source"), "source", "left_semi").withColumn("_k", F.row_number().over(W.partitionBy("source", "path").orderBy("place"))).filter(F.col("_k") <= limit).drop("_k")
    rows = small.unionByName(paths.join(heads, ["source", "path"]).select(*kept))
    order = W.partitionBy("question_id").orderBy("first_hit", "source", "place")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("question_id", "block_id", "position")


def append_new(hits: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """(`question_id`, `block_id`, `position`): hits in order, then what `more` (by `rank`) has beside them."""
    both = hits.select("question_id", "block_id", F.lit(0).alias("part"), F.col("position").alias("at")).unionByName(more.select("question_id", "block_id", F.lit(1).alias("part"), F.col("rank").alias("at")))
    first = both.groupBy("question_id", "block_id").agg(F.min(F.struct("part", "at")).alias("m"))
    order = W.partitionBy("question_id").orderBy("m.part", "m.at", "block_id")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("question_id", "block_id", "position")


def contexts(hits: DataFrame, chunks: DataFrame, by: str = "position") -> DataFrame:
    """(`question_id`, `context`, `sources`): labelled texts in order, and sources by first use.

    The lists are bounded by the limit that made the hits.
    """
    label = T.context_label(F.col("source"), F.col("page"), F.col("tier"), F.col("section"))
    rows = hits.join(chunks, "block_id").withColumn("piece", F.concat(label, F.lit("\n"), F.coalesce("text", F.lit(""))))
    parts = F.sort_array(F.collect_list(F.struct(by, "piece", "source")))
    out = rows.groupBy("question_id").agg(parts.alias("p"))
    return out.select("question_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"), F.array_distinct(F.transform("p", lambda x: x["source"])).alias("sources"))
