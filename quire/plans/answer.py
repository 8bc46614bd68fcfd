"""Answering questions: scope, retrieval, expansion, context, in one plan of DataFrames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, UNKNOWN_ANSWER, WEB_FAILED, WEB_NOTICE, WEB_OFFER, EngineConfig
from quire.functions import text as T
from quire.operators import ranking
from quire.plans.retrieve import Corpus, retrieve
from quire.session import cut


class AnswerProvider(Protocol):
    """Makes an answer column from a question and its context."""

    def answer(self, question: Column, context: Column) -> Column: ...


class Extractive:
    """The first line of the context that is no label; needs no model."""

    def answer(self, question: Column, context: Column) -> Column:
        return F.get(F.split(F.coalesce(context, F.lit("")), "\n"), F.lit(1))


def answers(found: Corpus, questions: DataFrame, config: EngineConfig = DEFAULTS, provider: AnswerProvider | None = None, queries: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """(`question_id`, `answer`, `sources`, `unknown`) for a batch of questions.

    What is found (see `retrieve`) becomes a labelled context for the provider, whose
    answer is made fit to show. A question without hits is answered from `history`
    (`question_id`, `answer`, `sources`), unless it asks for a report; without that,
    or with an empty or blank question, it is unknown and offers a search.
    """
    provider = provider or Extractive()
    asked_for = questions.filter("trim(question) <> ''").select("question_id", "question")
    stands = alike(asked_for, queries)
    first = stands.filter("question_id = first_id").select("question_id")
    hits, asked = retrieve(found, asked_for.join(first, "question_id", "left_semi"), None if queries is None else queries.join(first, "question_id", "left_semi"), config)
    # what is given is made once for all that ask the same, whose words are equal
    given = F.nullif(T.strip(T.outside_titles(provider.answer(F.col("question"), F.col("context")), config.sanitize_rules)), F.lit(""))
    made = asked.select("question_id", "question", "is_report").join(ranking.contexts(hits, found.blocks.drop("path")), "question_id", "left")
    made = made.select(F.col("question_id").alias("first_id"), "is_report", "sources", F.col("context").isNotNull().alias("hit"), F.when(F.col("context").isNotNull(), given).alias("given"))
    out = questions.select("question_id").join(stands, "question_id", "left").join(made, "first_id", "left")
    none = F.array().cast("array<string>")
    if history is None:
        out = out.withColumns({"past": F.lit(None).cast("string"), "past_sources": none})
    else:
        out = out.join(history.select("question_id", F.col("answer").alias("past"), F.col("sources").alias("past_sources")), "question_id", "left")
    past = F.when(~F.coalesce("is_report", F.lit(False)), T.outside_titles(F.col("past"), config.sanitize_rules))
    answer = F.when(F.col("hit"), F.col("given")).otherwise(past)
    sources = F.when(F.col("hit"), F.col("sources")).otherwise(F.col("past_sources"))
    out = out.select("question_id", answer.alias("answer"), sources.alias("sources"))
    unknown = F.col("answer").isNull() | T.squeeze(F.col("answer")).isin(*["".join(u.split()) for u in config.unknown_answers])
    return out.select("question_id", F.when(unknown, F.lit(UNKNOWN_ANSWER + WEB_OFFER)).otherwise(F.col("answer")).alias("answer"), F.when(unknown, none).otherwise(F.coalesce("sources", none)).alias("sources"), unknown.alias("unknown"))


def alike(questions: DataFrame, queries: DataFrame | None) -> DataFrame:
    """(`question_id`, `first_id`): the first of the questions with the same words and the same queries, which find the same blocks."""
    if queries is None:
        rows = questions.withColumn("listed", F.lit(None).cast("string"))
    else:
        listed = queries.groupBy("question_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "query")))).alias("listed"))
        rows = questions.join(listed, "question_id", "left")
    rows = rows.select("question_id", F.struct("question", "listed").alias("asks"))
    return cut(rows.join(rows.groupBy("asks").agg(F.min("question_id").alias("first_id")), "asks").select("question_id", "first_id"))


def web_answers(searches: DataFrame, results: DataFrame, config: EngineConfig = DEFAULTS, provider: AnswerProvider | None = None) -> DataFrame:
    """(`conv_id`, `turn`, `answer`, `unknown`) of searches on the web (`conv_id`, `turn`, `query`), from merged results.

    Results (`query_text`, `position`, `title`, `url`, `snippet`) become a numbered
    context; an answer carries a notice that it is no file's content. A search without
    results or answer is unknown and says that it failed.
    """
    provider = provider or Extractive()
    piece = F.concat(F.col("position").cast("string"), F.lit(". 标题："), "title", F.lit("\n   链接："), "url", F.lit("\n   摘要："), F.coalesce("snippet", F.lit("")))
    found = results.groupBy(F.col("query_text").alias("query")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))
    out = searches.join(found, "query", "left")
    given = F.nullif(T.strip(T.outside_titles(provider.answer(F.col("query"), F.col("context")), config.sanitize_rules)), F.lit(""))
    unknown = F.col("context").isNull() | given.isNull()
    return out.select("conv_id", "turn", F.when(unknown, F.lit(WEB_FAILED)).otherwise(F.concat(F.lit(WEB_NOTICE + "\n\n"), given)).alias("answer"), unknown.alias("unknown"))
