"""Conversations: cleaning, windows of history, topics, consent, what to ask next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import DEFAULTS, SEARCH_STRIP, WEB_OFFER, EngineConfig
from quire.functions import text as T


def normal_turns(turns: DataFrame) -> DataFrame:
    """User and assistant turns with content, roles in lower case; each turn of a
    conversation once, as first delivered.
    """
    rows = turns.withColumn("role", F.lower(F.trim("role"))).withColumn("content", T.strip(F.col("content")))
    rows = rows.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    first = rows.groupBy("conv_id", "turn").agg(F.min("turn_id").alias("turn_id"))
    return rows.join(first.select("turn_id"), "turn_id", "left_semi")


def recent(turns: DataFrame, messages: int = DEFAULTS.history_messages) -> DataFrame:
    """The last messages of each conversation, numbered from the oldest kept."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = normal_turns(turns).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= messages)
    return rows.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "position", "role", "content")


def is_unknown(config: EngineConfig = DEFAULTS) -> Column:
    """Is an assistant turn no answer: marked so, or one of the fixed texts but for white space."""
    text = T.squeeze(F.coalesce("content", F.lit("")))
    return F.coalesce("unknown", F.lit(False)) | text.isin(*["".join(u.split()) for u in config.unknown_answers])


def without_unknown(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Turns without unanswered ones: an unknown answer goes, with the question before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    unknown = is_unknown(config)
    rows = normal_turns(turns).withColumn("next_role", F.lead("role").over(order)).withColumn("next_unknown", F.lead(unknown).over(order))
    assistant = (F.col("role") == "assistant") & ~unknown
    user = (F.col("role") == "user") & (F.col("next_role").isNull() | ((F.col("next_role") == "assistant") & ~F.col("next_unknown")))
    return rows.filter(assistant | user).select("conv_id", "turn", "role", "content")


def own_topic(config: EngineConfig = DEFAULTS) -> Column:
    """The topic of a user turn that refers to nothing; null for all other turns."""
    return F.when((F.col("role") == "user") & ~F.col("content").rlike(config.referents), T.topic(F.col("content")))


def history_topics(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`conv_id`, `topic`): of the last messages, the topic of the latest user turn that refers to nothing and has one."""
    rows = recent(turns, config.history_messages).withColumn("topic", own_topic(config)).filter("topic IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.max(F.struct("turn", "topic"))["topic"].alias("topic"))


def _before(config: EngineConfig):
    """The messages that a turn knows: the last ones of its conversation before it."""
    return W.partitionBy("conv_id").orderBy("turn").rowsBetween(-config.history_messages, -1)


def _resolved(turns: DataFrame, config: EngineConfig) -> DataFrame:
    """Normal turns with `question`, what a user turn asks when what it refers to is put in, and `last_user`."""
    rows = normal_turns(turns).withColumn("own", own_topic(config))
    rows = rows.withColumn("topic", F.coalesce(T.local_topic(F.col("content"), config.referents), F.last("own", True).over(_before(config))))
    rows = rows.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("content")), True).over(_before(config)))
    quoted = F.replace(F.replace(F.col("topic"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    filled = F.regexp_replace(F.col("content"), F.lit(config.referents), quoted)
    return rows.withColumn("question", F.when(F.col("topic").isNotNull() & F.col("content").rlike(config.referents), filled).otherwise(F.col("content")))


def resolved(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`conv_id`, `turn`, `question`): user turns with what they refer to put in.

    The topic is that of the last sentence of the turn before it first refers to
    something, else of the nearest earlier user turn among the last messages that
    refers to nothing; without one a question stays as it is.
    """
    return _resolved(turns, config).filter("role = 'user'").select("conv_id", "turn", "question")


def conversation_queries(turns: DataFrame, config: EngineConfig = DEFAULTS, expand=None) -> DataFrame:
    """(`conv_id`, `turn`, `position`, `query`): what is searched for each user turn, in order.

    The resolved question; the user's last question and it, where there is one; and
    what `expand`, a function from the question column to an array of strings, adds.
    """
    more = F.array().cast("array<string>") if expand is None else expand(F.col("question"))
    both = F.array_compact(F.array("question", F.when(F.col("last_user").isNotNull(), F.concat_ws(" ", "last_user", "question"))))
    rows = _resolved(turns, config).filter("role = 'user'").select("conv_id", "turn", F.posexplode(F.concat(both, more)).alias("position", "query"))
    return rows.withColumn("position", F.col("position") + 1)


def consents(config: EngineConfig = DEFAULTS) -> Column:
    """Does a message only agree: one of the set phrases, or a short one that begins so."""
    text = T.bare(F.col("content"))
    starts = F.lit(False)
    for w in config.consent_starts:
        starts = starts | text.startswith(w)
    return text.isin(*config.consents) | (starts & (F.length(text) <= 12))


def pending_consent(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`conv_id`, `turn`, `consents`): user turns right after an unknown answer, and
    whether they consent to a search on the web.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = normal_turns(turns).withColumn("before", F.lag(F.struct("role", is_unknown(config).alias("unknown"))).over(order))
    return rows.filter("role = 'user' AND before.role = 'assistant' AND before.unknown").select("conv_id", "turn", consents(config).alias("consents"))


def web_searches(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`conv_id`, `turn`, `query`): user turns that ask for a search on the web, and what for.

    A turn asks by saying so, or by consenting right after an unknown answer or one
    that offers a search. What consents searches for the question before it, others
    for what is left of them without the words that ask; an empty query finds nothing.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = _resolved(turns, config)
    offered = (F.col("role") == "assistant") & (F.col("content").contains(WEB_OFFER) | is_unknown(config))
    rows = rows.withColumn("offered", F.coalesce(F.lag(offered).over(order), F.lit(False))).withColumn("agrees", consents(config))
    rows = rows.filter((F.col("role") == "user") & (T.any_of(F.col("content"), config.search_words) | (F.col("agrees") & F.col("offered"))))
    marks = "[，。！？!?、 \t\r\n]+"
    left = F.regexp_replace(F.regexp_replace("question", SEARCH_STRIP, ""), f"^{marks}|{marks}$", "")
    query = F.when(F.col("agrees"), F.coalesce("last_user", F.lit(""))).otherwise(F.when(left != "", left).otherwise(F.col("question")))
    return rows.select("conv_id", "turn", query.alias("query"))


def answers_from_history(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(`conv_id`, `answer`, `sources`): the last known answer among the recent messages, with all sources named in them.

    What a question without any hit is answered from; conversations without a known answer have no row.
    """
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = normal_turns(turns).withColumn("back", F.row_number().over(back)).filter((F.col("back") <= config.history_messages) & (F.col("role") == "assistant"))
    known = rows.filter(~is_unknown(config)).groupBy("conv_id").agg(F.max(F.struct("turn", "content"))["content"].alias("answer"))
    named = F.array_sort(F.collect_list(F.struct("turn", "sources")))
    sources = rows.groupBy("conv_id").agg(F.array_distinct(F.filter(F.flatten(F.transform(named, lambda x: F.coalesce(x["sources"], F.array().cast("array<string>")))), lambda s: F.trim(s) != "")).alias("sources"))
    return known.join(sources, "conv_id")


def history_sources(turns: DataFrame) -> DataFrame:
    """(`conv_id`, `source`, `position`): sources of answers by first appearance.

    Ranked from one row a source, so a source that is everywhere costs nothing.
    """
    rows = normal_turns(turns).filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("sources").alias("at", "source")).filter("source IS NOT NULL AND source <> ''")
    first = rows.groupBy("conv_id", "source").agg(F.min(F.struct("turn", "at")).alias("m"))
    return first.select("conv_id", "source", F.row_number().over(W.partitionBy("conv_id").orderBy("m.turn", "m.at", "source")).alias("position"))


def transcripts(turns: DataFrame, messages: int = DEFAULTS.history_messages) -> DataFrame:
    """(`conv_id`, `history`): the recent messages of a conversation as one labelled text."""
    label = F.when(F.col("role") == "user", "用户：").otherwise("助手：")
    rows = recent(turns, messages).withColumn("line", F.concat(label, "content"))
    parts = F.sort_array(F.collect_list(F.struct("position", "line")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("history"))
