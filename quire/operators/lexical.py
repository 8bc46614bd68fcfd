"""Okapi BM25 over an index that is built once and read by every search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.functions import text as T
from quire.session import cut, cut_by

#: Asked terms up to so many rows are sent to all tasks; more are joined by a shuffle.
SMALL = 200_000
#: Texts that a bucket of the postings holds, about.
BUCKET_TEXTS = 50_000


@dataclass(frozen=True)
class Index:
    """Postings (`scope...`, `id`, `term`, `tf`, `dl`) bucketed by id, terms (`scope...`, `term`, `df`, `idf`), pool (`scope...`, `n_docs`, `avgdl`)."""

    postings: DataFrame
    terms: DataFrame
    pool: DataFrame


def postings(texts: DataFrame, id_col: str, scope: list[str] | None = None) -> DataFrame:
    """(`scope...`, `id`, `term`, `tf`): term frequencies, summed before the shuffle."""
    keep = [*(scope or []), id_col]
    return texts.select(*keep, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("tf"))


def build(texts: DataFrame, id_col: str, scope: list[str] | None = None, config: EngineConfig = DEFAULTS) -> Index:
    """The index of all texts, written to the shared folder.

    One shuffle of the texts by id; postings, lengths and the buckets they are
    written in follow from it, so a search needs no shuffle to sum up a text.
    """
    scope = scope or []
    texts = texts.select(*scope, id_col, "text")
    buckets = max(1, -(-texts.count() // BUCKET_TEXTS), texts.sparkSession.sparkContext.defaultParallelism)
    rows = texts.repartition(buckets, id_col).select(*scope, id_col, T.tokens(F.col("text")).alias("t"))
    posted = rows.select(*scope, id_col, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(id_col, *scope, "term", "dl").agg(F.count("*").cast("int").alias("tf"))
    posted = cut_by(posted, id_col, buckets, "term")
    pool = cut(texts.select(*scope, F.size(T.tokens(F.col("text"))).alias("dl")).groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
    return Index(posted, cut(idf(posted, pool, scope, config)), pool)


def idf(posted: DataFrame, pool: DataFrame, scope: list[str], config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`scope...`, `term`, `df`, `idf`); a negative idf becomes epsilon times the mean idf of the scope's vocabulary."""
    df = posted.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    df = (df.join(pool, scope) if scope else df.crossJoin(F.broadcast(pool))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    df = cut(df)
    mean = df.groupBy(*scope).agg(F.avg("raw").alias("mean_idf"))
    df = df.join(mean, scope) if scope else df.crossJoin(F.broadcast(mean))
    value = F.when(F.col("raw") < 0, F.col("mean_idf") * config.bm25_epsilon).otherwise(F.col("raw"))
    return df.select(*scope, "term", "df", value.alias("idf"))


def search(index: Index, queries: DataFrame, id_col: str, query_id: str, k: int, scope: list[str] | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`query_id`, `id`, `score`, `rank`): the k best texts of each query.

    With a scope, a query meets only texts of its own scope, under that scope's
    statistics. Texts without any term of the query are not listed. Scores are
    rounded to six places before they are ranked; ties go to the lower id. The
    asked terms go to the postings, which are summed where they lie; every task
    passes on its k best of a query.
    """
    scope = scope or []
    asked = queries.select(*scope, query_id, F.explode(T.tokens(F.col("question"))).alias("term")).groupBy(*scope, query_id, "term").agg(F.count("*").alias("times"))
    asked = cut(asked)
    small = F.broadcast if asked.count() <= SMALL else lambda df: df
    weighed = index.terms.join(small(asked), [*scope, "term"])
    weighed = weighed.join(index.pool, scope) if scope else weighed.crossJoin(F.broadcast(index.pool))
    weighed = cut(weighed.select(*scope, query_id, "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl"))
    hits = index.postings.join(small(weighed), [*scope, "term"])
    k1, b = config.bm25_k1, config.bm25_b
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(id_col, query_id).agg(F.round(F.sum(part), 6).alias("score"))
    best = W.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def bm25(texts: DataFrame, queries: DataFrame, id_col: str, query_id: str, k: int, scope: list[str] | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Builds the index of some texts and searches it once."""
    return search(build(texts, id_col, scope, config), queries, id_col, query_id, k, scope, config)
