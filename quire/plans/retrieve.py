"""Finding the blocks that questions are answered from: scope, two kinds of search, merging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.functions import text as T
from quire.functions.embedding import EmbeddingProvider, HashEmbedder
from quire.operators import dense, lexical, ranking, scope
from quire.session import cut


@dataclass(frozen=True)
class Corpus:
    """What is searched: `blocks` (`block_id`, `source`, `page`, `tier`, `section`, `path`, `text`), their lexical index, and vectors."""

    blocks: DataFrame
    index: lexical.Index
    vectors: DataFrame
    embedder: EmbeddingProvider


def corpus(blocks: DataFrame, embedder: EmbeddingProvider | None = None, config: EngineConfig = DEFAULTS, index: lexical.Index | None = None) -> Corpus:
    """Indexes blocks once, in the shared folder, for any number of questions; an `index` that is there is taken."""
    embedder = embedder or HashEmbedder(config.embedding_dimensions)
    blocks = blocks.select("block_id", "source", "page", "tier", "section", "path", "text")
    vectors = cut(blocks.select(F.col("block_id").alias("vec_id"), "source", "tier", embedder.embed(F.col("text")).alias("embedding")))
    return Corpus(blocks, index or lexical.build(blocks.select("block_id", "text"), "block_id", config=config), vectors, embedder)


def scopes(blocks: DataFrame, questions: DataFrame, config: EngineConfig = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with their classes, `kind` of scope and `within`, the sources that are named, and the local sources.

    `kind` is `named` where files are named (local ones first, all where none is
    local), within a tier if one was found too; else `tier`; else `local`, unless the
    question is about other regions or no source is local: then `all`. Local scope is
    kept as a kind, and the named sources (`within`, `only_tier`, `source`) once for all
    questions that name the same in the same way, the first of which is `within`; so no
    list of sources is made for each question.
    """
    classes = scope.question_classes(questions, config)
    local = cut(scope.local_sources(blocks, config))
    titles = F.array_sort(F.array_distinct(F.transform(T.quoted_titles(F.col("question")), T.squeeze)))
    naming = questions.join(classes, "question_id").select("question_id", titles.alias("titles"), "tier_found", "wants_other").filter("size(titles) > 0")
    first, alike = dense.stands(naming, "question_id", ["titles", "tier_found", "wants_other"])
    names = scope.named_files(questions.join(first.select("question_id"), "question_id", "left_semi"), blocks.select("source").distinct())
    named = scope.scoped_sources(cut(names), local, classes.join(first.select("question_id"), "question_id", "left_semi"))
    named = cut(named.join(first.select("question_id", F.col("tier_found").alias("only_tier")), "question_id").withColumnRenamed("question_id", "within"))
    within = alike.withColumnRenamed("_first", "within").join(named.select("within").distinct(), "within", "left_semi")
    some = not local.isEmpty()
    kind = F.when(F.col("within").isNotNull(), "named").when(F.col("tier_found").isNotNull(), "tier").when(~F.col("wants_other") & F.lit(some), "local").otherwise("all")
    asked = questions.select("question_id", "question").join(classes, "question_id").join(within, "question_id", "left").withColumn("kind", kind)
    return cut(asked), named, local


def section_places(found: Corpus, questions: DataFrame, asked: DataFrame, named: DataFrame, local: DataFrame, depth: int) -> DataFrame:
    """(`question_id`, `block_id`, `weight`, `rank`): the blocks in scope whose paths weigh most for a question.

    Questions are sent to the paths, each with the first `depth` of its blocks in a
    tier, and only what can be among the best of a question leaves a task. What is
    named is met as a tier of its own, in which stand the blocks of the named files.
    """
    grams = questions.select("question_id", ranking.question_grams(F.col("question")).alias("grams"))
    grams = cut(grams.join(asked.select("question_id", "kind", "tier_found", "within"), "question_id"))
    blocks = found.blocks.filter("path IS NOT NULL AND path <> ''").select("block_id", "source", "path", F.coalesce("tier", F.lit("")).alias("tier"))
    blocks = cut(blocks.join(local.withColumn("home", F.lit(True)), "source", "left").withColumn("home", F.coalesce("home", F.lit(False))))
    part = ["path", "tier", "home"]
    heads = lambda rows: ranking.numbered(rows, part, ["block_id"]).filter(F.col("position") <= depth).groupBy(*part).agg(F.sort_array(F.collect_list("block_id")).alias("ids"))
    wide = ranking.heaviest_blocks(cut(heads(blocks)), grams.filter("kind <> 'named'"), depth)
    own = blocks.join(named, "source").filter("only_tier IS NULL OR tier = only_tier").select("block_id", "path", F.col("within").cast("string").alias("tier"), F.lit(False).alias("home"))
    asked_own = grams.filter("kind = 'named'").select("question_id", "grams", F.lit("tier").alias("kind"), F.col("within").cast("string").alias("tier_found"))
    return wide.unionByName(ranking.heaviest_blocks(cut(heads(own)), asked_own, depth))


def ranked_lists(found: Corpus, queries: DataFrame, asked: DataFrame, named: DataFrame, local: DataFrame, depth: int, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`question_id`, `turn`, `block_id`, `rank`): a ranked list for each query (`question_id`, `turn`, `query`).

    In a scope it is the vectors of the scope by relevance, from the threshold on, up
    to `depth`: the words of a query can add nothing that they do not have. Without
    one, lexical and dense hits are fused, `summary_floor` of each for summaries and
    reports and `top_k` for others.
    """
    queries = queries.join(asked.select("question_id", "kind", "tier_found", "within", (F.col("is_summary") | F.col("is_report")).alias("many")), "question_id")
    queries = cut(queries.withColumn("vec_id", F.xxhash64("question_id", "turn")).withColumn("embedding", found.embedder.embed(F.col("query"))))
    limit = config.score_threshold if config.score_threshold > 0 else None
    own = lambda kind: queries.filter(F.col("kind") == kind)
    kinds = {r["kind"] for r in queries.select("kind").distinct().collect()}
    held = lambda kind, vectors: cut(vectors) if kind in kinds else vectors
    back = queries.select(F.col("vec_id").alias("query_id"), "question_id", "turn")
    tiers = dense.nearest(found.vectors.withColumn("s", F.coalesce("tier", F.lit(""))), own("tier").withColumn("s", F.col("tier_found")), depth, limit, "s")
    home = dense.nearest(held("local", found.vectors.join(local, "source", "left_semi").select("vec_id", "embedding")), own("local"), depth, limit)
    # files that questions name: their vectors once for each scope that names them
    near = found.vectors.join(named, "source").filter("only_tier IS NULL OR coalesce(tier, '') = only_tier").select("vec_id", "embedding", "within")
    few = dense.nearest(held("named", near), own("named"), depth, limit, "within")
    free = own("all")
    k = lambda df: df.filter(F.col("rank") <= F.when(F.col("many"), config.summary_floor).otherwise(config.top_k))
    many = free.select(F.col("vec_id").alias("query_id"), "many")
    words = k(lexical.search(found.index, free.select(F.col("vec_id").alias("query_id"), F.col("query").alias("question")), "block_id", "query_id", config.summary_floor, config=config).join(many, "query_id"))
    close = k(dense.nearest(found.vectors, free, config.summary_floor, limit).withColumnRenamed("vec_id", "block_id").join(many, "query_id"))
    fused = ranking.fuse([words, close], "query_id", "block_id", depth, config)
    lists = [x.select("query_id", F.col("vec_id").alias("block_id"), "rank") for x in (tiers, home, few)] + [fused.select("query_id", "block_id", "rank")]
    return reduce(DataFrame.unionByName, lists).join(back, "query_id").drop("query_id")


def retrieve(found: Corpus, questions: DataFrame, queries: DataFrame | None = None, config: EngineConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(`question_id`, `block_id`, `position`) for each question, and the questions with their classes.

    `queries` (`question_id`, `turn`, `query`) are what a question is searched by, the
    question itself where it is None. Lists of a question's queries are interleaved up
    to `retrieve_limit` hits, `summary_seed_limit` for summaries and reports. Unless a
    question asks for a summary in so many words, what is left must be among the
    `recheck_depth` nearest of its first query above the threshold. Small sources come
    whole, then sections that name parts of the first query fill up to the limit.
    Summaries and reports complete their sources; others are expanded once more.
    """
    asked, named, local = scopes(found.blocks, questions, config)
    queries = questions.select("question_id", F.lit(1).alias("turn"), F.col("question").alias("query")) if queries is None else queries
    queries = cut(queries.filter("query IS NOT NULL AND trim(query) <> ''"))
    summary = (F.col("is_summary") | F.col("is_report")).alias("summary")
    kinds = asked.select("question_id", summary, "is_summary_style")
    most = F.when(F.col("summary"), config.summary_seed_limit).otherwise(config.retrieve_limit)
    lists = ranked_lists(found, queries, asked, named, local, max(config.summary_seed_limit, config.retrieve_limit), config)
    first = lists.groupBy("question_id", "block_id").agg(F.min(F.struct("rank", "turn")).alias("at"))
    hits = ranking.numbered(first, ["question_id"], ["at.rank", "at.turn", "block_id"]).join(kinds, "question_id").filter(F.col("position") <= most)
    if config.score_threshold > 0:
        start = queries.groupBy("question_id").agg(F.min(F.struct("turn", "query"))["query"].alias("query"))
        start = start.select(F.xxhash64("question_id").alias("vec_id"), found.embedder.embed(F.col("query")).alias("embedding"), "question_id")
        start = cut(start)
        allowed = dense.nearest(found.vectors, start, config.recheck_depth, config.score_threshold).select(F.col("query_id").alias("_q"), F.col("vec_id").alias("block_id"))
        allowed = allowed.join(start.select(F.col("vec_id").alias("_q"), "question_id"), "_q").select("question_id", "block_id", F.lit(True).alias("allowed"))
        hits = hits.join(allowed, ["question_id", "block_id"], "left").filter(F.col("is_summary_style") | F.col("allowed"))
    hits = cut(hits.select("question_id", "block_id", F.col("position").alias("rank")))
    depth = max(config.summary_seed_limit, config.retrieve_limit)
    whole = ranking.expand_small_sources(hits, found.blocks.select("block_id", "source"), depth, config)
    places = section_places(found, queries.filter("turn = 1").select("question_id", F.col("query").alias("question")), asked, named, local, depth)
    merged = ranking.append_new(whole, places, depth).join(kinds, "question_id").filter(F.col("position") <= most)
    merged = cut(merged)
    seeds = merged.filter("summary").select("question_id", "block_id", F.col("position").alias("rank"))
    done = ranking.complete_sources(seeds, found.blocks, config.summary_retrieve_limit, config)
    rest = merged.filter("NOT summary").select("question_id", "block_id", F.col("position").alias("rank"))
    return cut(done.unionByName(ranking.expand_small_sources(rest, found.blocks.select("block_id", "source"), config.retrieve_limit, config))), asked
