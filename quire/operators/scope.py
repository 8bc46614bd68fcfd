"""Which part of a corpus a question is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.functions import text as T


def in_scope(tier: str | None = None, sources: tuple[str, ...] = ()) -> Column:
    """Tier equality and source membership, each optional; a missing tier reads as empty."""
    out = F.lit(True)
    if tier:
        out = out & (F.coalesce("tier", F.lit("")) == tier)
    if sources:
        out = out & F.col("source").isin(*sources)
    return out


def detect_tier(question: Column, config: EngineConfig = DEFAULTS) -> Column:
    """The tier of the first alias in list order that the question contains; none where it names a region."""
    out = F.lit(None).cast("string")
    for alias, tier in reversed(config.tier_aliases):
        out = F.when(question.contains(alias), F.lit(tier)).otherwise(out)
    return F.when(~T.any_of(question, config.regions), out)


def question_classes(questions: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """What kinds of question each is.

    `is_list`; `is_summary`, which a list question is too; `is_summary_style`, asked
    for in so many words; `is_report`; `wants_other`, about other regions; `tier_found`.
    """
    q = F.col("question")
    is_list, style = T.any_of(q, config.list_words), T.any_of(q, config.summary_words)
    return questions.select(
        "question_id",
        is_list.alias("is_list"),
        (is_list | style).alias("is_summary"),
        style.alias("is_summary_style"),
        T.any_of(q, config.report_words).alias("is_report"),
        T.any_of(q, config.other_words + config.other_markers).alias("wants_other"),
        detect_tier(q, config).alias("tier_found"),
    )


def local_sources(blocks: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Sources that are local: by name, and by tier or by what their texts mention."""
    facts = blocks.filter("source IS NOT NULL AND source <> ''").groupBy("source").agg(
        F.bool_or(F.coalesce("tier", F.lit("")) != config.other_tier).alias("in_tier"),
        F.bool_or(T.any_of(F.col("text"), config.other_markers)).alias("other"),
        F.bool_or(T.any_of(F.col("text"), config.local_markers)).alias("local"),
    )
    return facts.filter(~T.any_of(F.col("source"), config.other_markers) & (F.col("in_tier") | ~(F.col("other") & ~F.col("local")))).select("source")


def named_files(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(`question_id`, `source`): files whose name contains a title that a question quotes, or the reverse.

    Compared without white space and without the suffix of a text file. The one that
    is contained is looked up by its first two characters among all pairs of
    neighbours of the other (an inverted join); what meets is then compared whole, so
    no title is tried against every name. Empty titles and names name nothing.
    """
    asked = questions.select("question_id", F.explode(T.quoted_titles(F.col("question"))).alias("title")).select("question_id", T.squeeze(F.col("title")).alias("title")).filter("title <> ''")
    names = files.filter("source IS NOT NULL").select("source").distinct().select("source", T.squeeze(T.without_extension(F.col("source"))).alias("name")).filter("name <> ''")
    titles = asked.select("title").distinct()
    key = lambda c: F.substring(c, 1, 2).alias("gram")

    def grams(c: str) -> Column:
        at = F.sequence(F.lit(1), F.length(c))
        return F.explode(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substr(c, i, F.lit(1)), F.substr(c, i, F.lit(2))))))).alias("gram")

    inside = titles.select("title", key("title")).join(names.select("source", "name", grams("name")), "gram").filter(F.col("name").contains(F.col("title")))
    around = names.select("source", "name", key("name")).join(titles.select("title", grams("title")), "gram").filter(F.col("title").contains(F.col("name")))
    met = inside.select("title", "source").unionByName(around.select("title", "source"))
    return asked.join(met, "title").select("question_id", "source").distinct()


def scoped_sources(named: DataFrame, local: DataFrame, classes: DataFrame) -> DataFrame:
    """(`question_id`, `source`): the sources that a question is limited to; questions without rows are not.

    A question without a tier that is not about other regions is limited to the
    named files that are local, to all named ones if none is, and to the local
    sources if it names none. Other questions are limited to what they name.
    """
    home = classes.filter("tier_found IS NULL AND NOT wants_other").select("question_id")
    own = named.join(home, "question_id", "left_semi").join(local, "source", "left_semi").select("question_id", "source")
    rest = named.join(own.select("question_id").distinct(), "question_id", "left_anti")
    return own.unionByName(rest)
