"""The queries of the core operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULTS, SEARCH_STRIP, SECTION_STOPWORDS, TOPIC_ENDS, TOPIC_PARTS, WEB_OFFER
from quire.functions import text as T
from quire.operators import chunking, dense, dialog, index, lexical, ranking, scope, web
from quire.plans import answer, retrieve
from quire.session import once, table
from quire.streaming import landing

Query = Callable[[SparkSession, str], DataFrame]

#: The settings with the places that the given tables are at home in.
TABLES = replace(DEFAULTS, local_markers=(*DEFAULTS.local_markers, "云岭", "澄湖", "泊云园区", "雁栖湾园区"))

# ---------------------------------------------------------------- sources


def file_listing(spark, d):
    return index.listed_files(table(spark, d, "source_files")).drop("loaded_at")


def page_cache_keys(spark, d):
    rows = table(spark, d, "source_files")
    return rows.select("source", "loaded_at", T.cache_key(F.col("rel_path"), F.col("n_blocks"), F.unix_micros(F.col("modified_at").cast("timestamp"))).alias("key"))


def reading_order(spark, d):
    boxes = F.struct(F.col("block_seq").cast("double").alias("y"), F.length("text").cast("double").alias("x"), F.col("text").alias("text"))
    rows = table(spark, d, "blocks").filter("ocr AND page IS NOT NULL AND text IS NOT NULL").select("source", "page", boxes.alias("b"))
    return rows.groupBy("source", "page").agg(T.reading_order(F.collect_list("b")).alias("text"))


# ---------------------------------------------------------------- structure


def block_deduplication(spark, d):
    return chunking.current_blocks(table(spark, d, "blocks")).select("block_id", "source", "block_seq")


def line_explode(spark, d):
    return chunking.heading_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "line_no", F.length("line").alias("n_chars"), "is_heading")


def block_assembly(spark, d):
    return chunking.assembled(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "block_no", "section", F.length("text").alias("n_chars"))


def section_path(spark, d):
    return chunking.section_paths(chunking.current_blocks(table(spark, d, "blocks").select("block_id", "source", "block_seq", "section", "text")))


def chunk_merge(spark, d):
    return chunking.merge_chunks(chunking.current_blocks(table(spark, d, "blocks").select("block_id", "source", "block_seq", "page", "section", "text")))


def repeated_lines_collapsed(spark, d):
    rows = table(spark, d, "blocks").select("block_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    from pyspark.sql import Window as W

    before = F.lag("line").over(W.partitionBy("block_id").orderBy("p"))
    return rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("line"))).groupBy("block_id").agg(F.count("*").alias("lines"))


# ---------------------------------------------------------------- index


def term_frequencies(spark, d):
    posted = lexical.postings(table(spark, d, "blocks").select("block_id", "text"), "block_id")
    return posted.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def _index(spark, d):
    """The index of all blocks, built once an application and read by every search."""
    return once(spark, ("bm25", d), lambda: lexical.build(table(spark, d, "blocks").select("block_id", "text"), "block_id"))


def _tier_index(spark, d):
    return once(spark, ("bm25 tier", d), lambda: lexical.build(table(spark, d, "blocks").filter("tier IS NOT NULL").select("block_id", "tier", "text"), "block_id", ["tier"]))


def bm25_statistics(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return lexical.search(_index(spark, d), table(spark, d, "questions").select("question_id", "question"), "block_id", "question_id", DEFAULTS.top_k)


def bm25_scoped(spark, d):
    asked = table(spark, d, "questions").filter("tier IS NOT NULL").select("question_id", "question", "tier")
    return lexical.search(_tier_index(spark, d), asked, "block_id", "question_id", DEFAULTS.top_k, ["tier"])


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 100 = 0")


def dense_topk(spark, d):
    return dense.nearest(*_vectors(spark, d), k=DEFAULTS.summary_top_k)


def dense_threshold(spark, d):
    return dense.nearest(*_vectors(spark, d), k=DEFAULTS.recheck_depth, threshold=DEFAULTS.score_threshold)


def dense_scoped(spark, d):
    return dense.nearest(*_vectors(spark, d), k=DEFAULTS.top_k, same="label")


def section_hits(spark, d):
    return ranking.section_hits(table(spark, d, "blocks").select("block_id", "section"), table(spark, d, "questions"), DEFAULTS.top_k)


# ---------------------------------------------------------------- ranking


def _corpus(spark, d):
    """Blocks with the paths that the table has, their lexical index and their vectors."""
    return once(spark, ("corpus", d), lambda: retrieve.corpus(table(spark, d, "blocks").withColumn("path", F.col("section_path")), index=_index(spark, d)))


def _nearest_blocks(spark, d, k):
    found = _corpus(spark, d)
    asked = table(spark, d, "questions").select(F.col("question_id").alias("vec_id"), found.embedder.embed(F.col("question")).alias("embedding"))
    return dense.nearest(found.vectors, asked, k, DEFAULTS.score_threshold).select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("block_id"), "relevance", "rank")


def dense_blocks(spark, d):
    return _nearest_blocks(spark, d, DEFAULTS.top_k)


def rank_fusion(spark, d):
    return ranking.fuse([bm25_topk(spark, d), dense_blocks(spark, d)], "question_id", "block_id", DEFAULTS.top_k)


def round_robin(spark, d):
    return ranking.interleave([bm25_topk(spark, d), section_hits(spark, d)], "question_id", "block_id", DEFAULTS.top_k)


def relevant_hits(spark, d):
    hits = bm25_topk(spark, d).select("question_id", "block_id", "rank")
    return ranking.relevant_only(hits, _nearest_blocks(spark, d, DEFAULTS.recheck_depth), ["question_id", "block_id"])


def small_source_expansion(spark, d):
    return ranking.expand_small_sources(bm25_topk(spark, d), table(spark, d, "blocks").select("block_id", "source"), DEFAULTS.retrieve_limit)


def source_completion(spark, d):
    chunks = table(spark, d, "blocks").select("block_id", "source", "page", F.col("section_path").alias("path"), "section", "text")
    return ranking.complete_sources(bm25_topk(spark, d), chunks, DEFAULTS.summary_retrieve_limit)


def retrieved_blocks(spark, d):
    return retrieve.retrieve(_corpus(spark, d), table(spark, d, "questions"), config=TABLES)[0]


def answer_contexts(spark, d):
    chunks = table(spark, d, "blocks").select("block_id", "source", "page", "tier", "section", "text")
    return ranking.contexts(bm25_topk(spark, d).withColumnRenamed("rank", "position"), chunks).select("question_id", F.length("context").alias("n_chars"), F.array_join("sources", "|").alias("sources"))


def answered_questions(spark, d):
    return answer.answers(_corpus(spark, d), table(spark, d, "questions"), TABLES)


# ---------------------------------------------------------------- scope


def scope_filter(spark, d):
    return table(spark, d, "blocks").filter(scope.in_scope("市级政策")).select("block_id", "source")


def question_classes(spark, d):
    return scope.question_classes(table(spark, d, "questions"))


def local_sources(spark, d):
    return scope.local_sources(table(spark, d, "blocks").select("source", "tier", "text"), TABLES)


def named_files(spark, d):
    return scope.named_files(table(spark, d, "questions"), table(spark, d, "source_files").select("source"))


def scoped_sources(spark, d):
    classes = scope.question_classes(table(spark, d, "questions"), TABLES)
    return scope.scoped_sources(named_files(spark, d), local_sources(spark, d), classes)


# ---------------------------------------------------------------- dialogue


def _turns(spark, d):
    return table(spark, d, "turns")


def history_window(spark, d):
    return dialog.recent(_turns(spark, d))


def answered_turns(spark, d):
    return dialog.without_unknown(_turns(spark, d))


def history_topics(spark, d):
    return dialog.history_topics(_turns(spark, d))


def resolved_questions(spark, d):
    return dialog.resolved(_turns(spark, d))


def conversation_queries(spark, d):
    return dialog.conversation_queries(_turns(spark, d))


def pending_consent(spark, d):
    return dialog.pending_consent(_turns(spark, d))


def web_searches(spark, d):
    return dialog.web_searches(_turns(spark, d))


def answers_from_history(spark, d):
    return dialog.answers_from_history(_turns(spark, d)).select("conv_id", "answer", F.array_join("sources", "|").alias("sources"))


def history_sources(spark, d):
    return dialog.history_sources(_turns(spark, d))


def transcripts(spark, d):
    return dialog.transcripts(_turns(spark, d))


def turn_activity(spark, d):
    out = landing.turn_activity(_turns(spark, d).filter("conv_id IS NOT NULL").withColumn("asked_at", F.col("asked_at").cast("timestamp")).groupBy("conv_id", "turn").agg(F.min(F.struct("turn_id", "asked_at", "role")).alias("m")).select("conv_id", "turn", "m.asked_at", "m.role"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "role", "turns")


def answer_lines(spark, d):
    rows = dialog.normal_turns(_turns(spark, d)).filter("role = 'assistant'").select("turn_id", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    return rows.select("turn_id", F.col("p").alias("line_no"), T.line_kind(F.col("line")).alias("kind"), T.escape_xml(F.col("line")).alias("line"))


def sanitized_answers(spark, d):
    return dialog.normal_turns(_turns(spark, d)).filter("role = 'assistant'").select("turn_id", T.outside_titles(F.col("content"), DEFAULTS.sanitize_rules).alias("content"))


def answer_sentences(spark, d):
    return dialog.normal_turns(_turns(spark, d)).select("turn_id", F.posexplode(T.sentences(F.col("content"))).alias("sentence_no", "sentence"))


# ---------------------------------------------------------------- web and upkeep


def web_merge(spark, d):
    return web.merged(table(spark, d, "web_results"))


def web_query_urls(spark, d):
    return table(spark, d, "web_results").select("query_text").distinct().select("query_text", F.url_encode("query_text").alias("encoded"))


def append_new_sources(spark, d):
    files = table(spark, d, "source_files").select("source", "rel_path")
    return index.new_rows(files, table(spark, d, "blocks").filter("source IS NOT NULL"))


def audit_counts(spark, d):
    return index.audit_counts(table(spark, d, "source_files"), table(spark, d, "blocks").select("source", "block_seq"))


def audit_totals(spark, d):
    return index.audit_totals(table(spark, d, "source_files"), table(spark, d, "blocks").select("source", "block_seq"))


def document_chunks(spark, d):
    """Every document as a file of one page, structured and cut into chunks."""
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("section_path"), "text", "tier", F.lit(None).cast("int").alias("slide"), F.lit(None).cast("boolean").alias("ocr"), F.lit(None).cast("string").alias("converted_from"))
    return chunking.chunks_of(pages).select("source", "segment", "chunk_seq", "section", "path", "tier", "text")


def conversation_answers(spark, d):
    """An answer to the last question of each conversation, after the messages before it."""
    turns = _turns(spark, d)
    last = dialog.normal_turns(turns).filter("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "content")).alias("m")).select("conv_id", "m.turn", F.col("m.content").alias("question"))
    last = last.join(dialog.web_searches(turns).select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    queries = dialog.conversation_queries(turns).join(last.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    queries = queries.select(F.col("conv_id").alias("question_id"), F.col("position").alias("turn"), "query")
    history = dialog.answers_from_history(turns).withColumnRenamed("conv_id", "question_id")
    return answer.answers(_corpus(spark, d), last.select(F.col("conv_id").alias("question_id"), "question"), TABLES, queries=queries, history=history)


def audit_missing_lines(spark, d):
    blocks = table(spark, d, "blocks").select("block_id", "source", "block_seq", "page", "section", "text")
    return index.missing_lines(blocks, chunking.merge_chunks(chunking.current_blocks(blocks)))


_ALL: tuple[Query, ...] = (
    file_listing, page_cache_keys, reading_order, block_deduplication, line_explode, block_assembly, section_path, chunk_merge, document_chunks, repeated_lines_collapsed,
    term_frequencies, bm25_statistics, bm25_topk, bm25_scoped, dense_topk, dense_threshold, dense_scoped, dense_blocks, section_hits,
    rank_fusion, round_robin, relevant_hits, small_source_expansion, source_completion, retrieved_blocks, answer_contexts, answered_questions, conversation_answers,
    scope_filter, question_classes, local_sources, named_files, scoped_sources,
    history_window, answered_turns, history_topics, resolved_questions, conversation_queries, pending_consent, web_searches, answers_from_history, history_sources, transcripts, turn_activity, answer_lines, sanitized_answers, answer_sentences,
    web_merge, web_query_urls, append_new_sources, audit_counts, audit_totals, audit_missing_lines,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the context that would answer them."""
    return answer_contexts(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


# ---------------------------------------------------------------- SQL

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"
_STRIP = rf"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.replace("{0}", c)


_TOKENS = """flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+|[\\x{4E00}-\\x{9FFF}]+'), lambda r:
    CASE WHEN length(r) = 1 OR regexp_matches(r, '^[a-z0-9]') THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"""


def _tokens(c: str) -> str:
    return _TOKENS.replace("{0}", c)


def _bm25(scoped: bool) -> str:
    s, g = ("tier, ", "USING (tier)") if scoped else ("", "ON true")
    on = "tier, term" if scoped else "term"
    where = "WHERE tier IS NOT NULL" if scoped else ""
    c = DEFAULTS
    return f"""
        b AS (SELECT {s} block_id, {_tokens("text")} AS toks FROM blocks {where}),
        p AS (SELECT {s} block_id, term, count(*) AS tf FROM (SELECT {s} block_id, unnest(toks) AS term FROM b) GROUP BY ALL),
        l AS (SELECT {s} block_id, len(toks) AS dl FROM b),
        pool AS (SELECT {s} count(*) AS n_docs, avg(dl) AS avgdl FROM l GROUP BY ALL),
        dfs AS (SELECT {s} term, count(*) AS df FROM p GROUP BY ALL),
        raw AS (SELECT dfs.*, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN pool {g}),
        mean AS (SELECT {s} avg(raw) AS m FROM raw GROUP BY ALL),
        idf AS (SELECT {s} term, df, CASE WHEN raw < 0 THEN m * {c.bm25_epsilon} ELSE raw END AS idf FROM raw JOIN mean {g}),
        q AS (SELECT {s} question_id, term, count(*) AS times FROM (SELECT {s} question_id, unnest({_tokens("question")}) AS term FROM questions {where}) GROUP BY ALL),
        sc AS (SELECT question_id, block_id, round(sum(times * idf * tf * {c.bm25_k1 + 1} / (tf + {c.bm25_k1} * ({1 - c.bm25_b} + {c.bm25_b} * dl / avgdl))), 6) AS score
               FROM q JOIN idf USING ({on}) JOIN p USING ({on}) JOIN l USING ({s} block_id) JOIN pool {g} GROUP BY question_id, block_id),
        bm AS (SELECT question_id, block_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, block_id) AS rank FROM sc QUALIFY rank <= {c.top_k})"""


def _dense(k: int, extra: str = "", where: str = "") -> str:
    return f"""
        v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        r AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / sqrt(2), 6) AS relevance
              FROM v AS q JOIN v ON true {extra} WHERE q.vec_id % 100 = 0),
        dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS rank FROM r {where} QUALIFY rank <= {k})"""


_GRAMS = """list_distinct(flatten(list_transform(regexp_extract_all({0}, '[\\x{4E00}-\\x{9FFF}]+|[A-Za-z0-9]{2,}'), lambda r:
    CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [r]
    ELSE list_concat(CASE WHEN length(r) >= 2 THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE []::VARCHAR[] END,
                     CASE WHEN length(r) >= 3 THEN list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3)) ELSE []::VARCHAR[] END) END)))"""

_SECTION = f"""
        qa AS (SELECT question_id, unnest({_GRAMS.replace("{0}", "question")}) AS gram FROM questions),
        sa AS (SELECT section, unnest({_GRAMS.replace("{0}", "section")}) AS gram FROM (SELECT DISTINCT section FROM blocks WHERE section <> '')),
        sw AS (SELECT question_id, section, sum(length(gram) * length(gram)) AS weight FROM qa JOIN sa USING (gram) WHERE gram NOT IN ({", ".join(repr(w) for w in SECTION_STOPWORDS)}) GROUP BY ALL),
        sh AS (SELECT question_id, block_id, CAST(weight AS BIGINT) AS weight, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, block_id) AS rank
               FROM sw JOIN blocks USING (section) QUALIFY rank <= {DEFAULTS.top_k})"""

_VECTOR_TOKENS = """list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+|[\\x{4E00}-\\x{9FFF}]+'), lambda r:
    CASE WHEN regexp_matches(r, '^[a-z0-9]') THEN [r] ELSE list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) END)))"""


def _vectors_of(name: str, id_: str, text: str, of: str) -> str:
    """Hashed unit vectors of a text column as rows (`id`, `dim`, `x`), and their squared lengths."""
    return f"""
        {name}h AS (SELECT id, ('0x' || substring(md5(tok), 1, 8))::BIGINT AS h FROM (SELECT {id_} AS id, unnest({_VECTOR_TOKENS.replace("{0}", text)}) AS tok FROM {of})),
        {name}p AS (SELECT id, h % {DEFAULTS.embedding_dimensions} AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}h GROUP BY ALL),
        {name}n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}p GROUP BY id HAVING sum(v * v) > 0),
        {name} AS (SELECT id, dim, (v / n)::FLOAT::DOUBLE AS x FROM {name}p JOIN {name}n USING (id) WHERE v <> 0),
        {name}s AS (SELECT id, sum(x * x) AS s FROM {name} GROUP BY id)"""


def _near(k: int, name: str) -> str:
    return f"""
        {name} AS (SELECT question_id, block_id, relevance, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, block_id) AS rank
              FROM rel WHERE relevance >= {DEFAULTS.score_threshold} QUALIFY rank <= {k})"""


_BLOCK_VECTORS = f"""{_vectors_of("bv", "block_id", "text", "blocks")}, {_vectors_of("qv", "question_id", "question", "questions")},
        dot AS (SELECT qv.id AS question_id, bv.id AS block_id, sum(qv.x * bv.x) AS dot FROM qv JOIN bv USING (dim) GROUP BY ALL),
        rel AS (SELECT question_id, block_id, round(1 - greatest(qvs.s + bvs.s - 2 * dot, 0) / sqrt(2), 6) AS relevance FROM dot JOIN qvs ON qvs.id = question_id JOIN bvs ON bvs.id = block_id)"""

_TURNS = f"""
        nt0 AS (SELECT turn_id, conv_id, turn, lower(trim(role)) AS role, {_strip("content")} AS content, sources,
                       coalesce("unknown", false) OR regexp_replace(coalesce(content, ''), '{_WS}+', '', 'g') IN ({", ".join(f"'{u}'" for u in DEFAULTS.unknown_answers)}) AS unk FROM turns),
        nt AS (SELECT * FROM nt0 WHERE role IN ('user', 'assistant') AND coalesce(content, '') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn_id) = 1)"""

_REF = DEFAULTS.referents


def _sentences(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[{T.SENTENCE_MARKS}\\n]+'), lambda s: {_strip('s')}), lambda s: s <> '')"


def _topic(c: str) -> str:
    """The topic of a question as SQL; `x`, `i` and `s` name what its lambdas take."""
    first = f"coalesce({_sentences(c)}[1], '')"
    cleaned = f"regexp_replace({first}, '(?:[？?！!。，,.、；;：:]|{_WS})+', '', 'g')"
    cleaned = f"regexp_replace({cleaned}, '({'|'.join(TOPIC_ENDS)})$', '')"
    cleaned = f"regexp_replace({cleaned}, '^[的是了在]+|[的是了在]+$', '', 'g')"
    parts = f"list_filter(regexp_split_to_array({cleaned}, '{'|'.join(TOPIC_PARTS)}'), lambda x: length(x) >= 2)"
    longest = f"list_max(list_transform({parts}, lambda x, i: {{'n': length(x), 'at': -i, 'x': x}})).x"
    titles = f"regexp_extract_all({c}, '《([^》]+)》', 1)"
    return f"CASE WHEN len({titles}) > 0 THEN regexp_replace({titles}[-1], '{_WS}+', '', 'g') ELSE {longest} END"


#: Normal turns with their own topic, the topic that what they refer to has, and the resolved question.
_RESOLVED = f"""
        ow AS (SELECT *, CASE WHEN role = 'user' AND NOT regexp_matches(content, '{_REF}') THEN {_topic("content")} END AS own FROM nt),
        se AS (SELECT turn_id, unnest({_sentences("content")}) AS sentence, generate_subscripts({_sentences("content")}, 1) AS n FROM nt WHERE regexp_matches(content, '{_REF}')),
        rf AS (SELECT turn_id, min(n) AS upto FROM se WHERE regexp_matches(sentence, '{_REF}') GROUP BY turn_id),
        lt AS (SELECT turn_id, arg_max(topic, n) AS near FROM (SELECT turn_id, n, {_topic("sentence")} AS topic FROM se JOIN rf USING (turn_id) WHERE n < upto) WHERE topic IS NOT NULL GROUP BY turn_id),
        rs0 AS (SELECT ow.*, last_value(own IGNORE NULLS) OVER w AS far, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w AS last_user,
                       coalesce(lag(role = 'assistant' AND (unk OR contains(content, '{WEB_OFFER}'))) OVER (PARTITION BY conv_id ORDER BY turn), false) AS offered
                FROM ow WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {DEFAULTS.history_messages} PRECEDING AND 1 PRECEDING)),
        rs AS (SELECT rs0.*, CASE WHEN coalesce(near, far) IS NOT NULL AND regexp_matches(content, '{_REF}') THEN regexp_replace(content, '{_REF}', coalesce(near, far), 'g') ELSE content END AS question
               FROM rs0 LEFT JOIN lt USING (turn_id))"""

_BARE = f"regexp_replace(regexp_replace(content, '{_WS}+', '', 'g'), '[，。！？!?、；;]+', '', 'g')"
_AGREES = (
    f"({_BARE} IN ({', '.join(repr(w) for w in DEFAULTS.consents)}) OR ("
    + " OR ".join(f"starts_with({_BARE}, '{w}')" for w in DEFAULTS.consent_starts)
    + f") AND length({_BARE}) <= 12)"
)


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(coalesce({c}, ''), '{w}')" for w in words) + ")"


#: The entities that stand in the given results; the ampersand last.
_ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&hellip;", "…"), ("&amp;", "&"))


def _replaced(c: str, rules) -> str:
    for a, b in rules:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _classes(c) -> str:
    aliases = " ".join(f"WHEN contains(question, '{a}') THEN '{t}'" for a, t in c.tier_aliases)
    return f"""question_id, {_any("question", c.list_words)} AS is_list, {_any("question", c.list_words + c.summary_words)} AS is_summary, {_any("question", c.summary_words)} AS is_summary_style,
        {_any("question", c.report_words)} AS is_report, {_any("question", c.other_words + c.other_markers)} AS wants_other, CASE WHEN {_any("question", c.regions)} THEN NULL {aliases} END AS tier_found"""


_LOCAL = f"""
        lf0 AS (SELECT source, bool_or(coalesce(tier, '') <> '{TABLES.other_tier}') AS in_tier, bool_or({_any("text", TABLES.other_markers)}) AS other, bool_or({_any("text", TABLES.local_markers)}) AS home
                FROM blocks WHERE source <> '' GROUP BY source),
        loc AS (SELECT source FROM lf0 WHERE NOT {_any("source", TABLES.other_markers)} AND (in_tier OR NOT (other AND NOT home)))"""

_NAMED = f"""
        qt AS (SELECT question_id, regexp_replace(unnest(regexp_extract_all(question, '《([^》]+)》', 1)), '{_WS}+', '', 'g') AS title FROM questions),
        fn AS (SELECT DISTINCT source, regexp_replace(regexp_replace(source, '{T.NAME_SUFFIX}', ''), '{_WS}+', '', 'g') AS name FROM source_files),
        named AS (SELECT DISTINCT question_id, source FROM qt JOIN fn ON contains(name, title) OR contains(title, name) WHERE title <> '' AND name <> '')"""


def _clean(c: str) -> str:
    for entity, sign in _ENTITIES:
        c = f"replace({c}, '{entity.replace(chr(39), chr(39) * 2)}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    c = DEFAULTS
    lines = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: x <> '')"
    heading, top = c.heading, c.top_heading
    lined = f"ln AS (SELECT doc_id, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS line_no FROM documents WHERE text IS NOT NULL)"
    current = "cb AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY source, block_seq, text ORDER BY block_id) = 1)"
    rank = "CASE engine " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(c.engines)) + f" ELSE {len(c.engines)} END"
    files = "lf AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY source ORDER BY loaded_at DESC, rel_path, n_blocks) = 1)"
    return {
        "file_listing": rf"""
            WITH {files} SELECT source, regexp_extract(rel_path, '[^/]*$') AS name, lower(regexp_extract(rel_path, '(\.[^./]+)$', 1)) AS suffix,
                   trim(regexp_replace(trim(CASE WHEN contains(rel_path, '/') THEN regexp_extract(rel_path, '([^/]*)/[^/]*$', 1) ELSE '' END), '{T.TIER_NUMBER}', '')) AS path_tier, n_blocks FROM lf""",
        "page_cache_keys": "SELECT source, loaded_at, substring(sha1(concat_ws('|', rel_path, n_blocks::VARCHAR, epoch_us(modified_at)::VARCHAR)), 1, 20) AS key FROM source_files",
        "reading_order": "SELECT source, page, string_agg(text, chr(10) ORDER BY block_seq, length(text), text) AS text FROM blocks WHERE ocr AND page IS NOT NULL AND text IS NOT NULL GROUP BY source, page",
        "block_deduplication": f"WITH {current} SELECT block_id, source, block_seq FROM cb",
        "line_explode": f"WITH {lined} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars, regexp_matches(line, '{heading}') AS is_heading FROM ln",
        "block_assembly": f"""
            WITH {lined}, h AS (SELECT *, regexp_matches(line, '{heading}') AS head FROM ln),
            n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM h)
            SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, coalesce(max(CASE WHEN head THEN substring(line, 1, 80) END), '') AS section,
                   CAST(length(string_agg(line, chr(10) ORDER BY line_no)) AS INTEGER) AS n_chars FROM n GROUP BY doc_id, block_no""",
        "section_path": f"""
            WITH {current}, r AS (SELECT block_id, source, block_seq, coalesce(trim(section), '') AS h, regexp_matches(coalesce(trim(section), ''), '{top}') AS top FROM cb),
            g AS (SELECT *, sum(top::INT) OVER (PARTITION BY source ORDER BY block_seq, block_id) AS g, (h <> '' AND NOT top)::INT AS sub FROM r),
            w AS (SELECT *, first_value(CASE WHEN top THEN h END IGNORE NULLS) OVER o AS t, sum(sub) OVER o AS k, first_value(CASE WHEN sub = 1 THEN h END IGNORE NULLS) OVER o AS s1,
                         nth_value(CASE WHEN sub = 1 THEN h END, 2 IGNORE NULLS) OVER o AS s2, last_value(CASE WHEN sub = 1 THEN h END IGNORE NULLS) OVER o AS last
                  FROM g WINDOW o AS (PARTITION BY source, g ORDER BY block_seq, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT block_id, CASE WHEN t IS NOT NULL THEN concat_ws(' > ', t, s1, CASE WHEN k >= 2 THEN last END) ELSE concat_ws(' > ', s1, s2, CASE WHEN k >= 3 THEN last END) END AS path FROM w""",
        "repeated_lines_collapsed": """
            WITH l AS (SELECT block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM blocks WHERE text IS NOT NULL),
            b AS (SELECT *, lag(line) OVER (PARTITION BY block_id ORDER BY p) AS before FROM l)
            SELECT block_id, count(*) AS lines FROM b WHERE before IS NULL OR before <> line GROUP BY block_id""",
        "term_frequencies": f"WITH p AS (SELECT block_id, term, count(*) AS tf FROM (SELECT block_id, unnest({_tokens('text')}) AS term FROM blocks) GROUP BY ALL) SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM p GROUP BY term",
        "bm25_statistics": f"WITH {_bm25(False)} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk": f"WITH {_bm25(False)} SELECT question_id, block_id, score, CAST(rank AS INTEGER) AS rank FROM bm",
        "bm25_scoped": f"WITH {_bm25(True)} SELECT question_id, block_id, score, CAST(rank AS INTEGER) AS rank FROM bm",
        "dense_topk": f"WITH {_dense(c.summary_top_k)} SELECT query_id, vec_id, relevance, CAST(rank AS INTEGER) AS rank FROM dn",
        "dense_threshold": f"WITH {_dense(c.recheck_depth, where=f'WHERE relevance >= {c.score_threshold}')} SELECT query_id, vec_id, relevance, CAST(rank AS INTEGER) AS rank FROM dn",
        "dense_scoped": f"WITH {_dense(c.top_k, 'AND q.label = v.label')} SELECT query_id, vec_id, relevance, CAST(rank AS INTEGER) AS rank FROM dn",
        "section_hits": f"WITH {_SECTION} SELECT question_id, block_id, weight, CAST(rank AS INTEGER) AS rank FROM sh",
        "dense_blocks": f"WITH {_BLOCK_VECTORS}, {_near(c.top_k, 'nb')} SELECT question_id, block_id, relevance, CAST(rank AS INTEGER) AS rank FROM nb",
        "rank_fusion": f"""
            WITH {_bm25(False)}, {_BLOCK_VECTORS}, {_near(c.top_k, "nb")}, u AS (SELECT question_id, block_id, rank FROM bm UNION ALL SELECT question_id, block_id, rank FROM nb),
            f AS (SELECT question_id, block_id, round(sum({c.fusion_weight} / (rank + {c.fusion_constant})), 9) AS score FROM u GROUP BY ALL)
            SELECT question_id, block_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM f QUALIFY rank <= {c.top_k}""",
        "round_robin": f"""
            WITH {_bm25(False)}, {_SECTION}, u AS (SELECT question_id, block_id, rank, 0 AS turn FROM bm UNION ALL SELECT question_id, block_id, rank, 1 FROM sh),
            f AS (SELECT question_id, block_id, min(rank * 10 + turn) AS pos FROM u GROUP BY ALL)
            SELECT question_id, block_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pos, block_id) AS INTEGER) AS position FROM f QUALIFY position <= {c.top_k}""",
        "relevant_hits": f"WITH {_bm25(False)}, {_BLOCK_VECTORS}, {_near(c.recheck_depth, 'nb')} SELECT question_id, block_id, CAST(rank AS INTEGER) AS rank FROM bm SEMI JOIN nb USING (question_id, block_id)",
        "small_source_expansion": f"""
            WITH {_bm25(False)}, s AS (SELECT source FROM blocks GROUP BY source HAVING count(*) <= {c.small_source_max}),
            f AS (SELECT question_id, bm.block_id, rank, source FROM bm JOIN blocks USING (block_id)),
            u AS (SELECT question_id, m.block_id, rank, 0 AS stage FROM f JOIN s USING (source) JOIN blocks AS m USING (source) UNION ALL SELECT question_id, block_id, rank, 1 FROM f),
            a AS (SELECT question_id, block_id, min(rank) AS rank FROM u GROUP BY ALL)
            SELECT question_id, block_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, block_id) AS INTEGER) AS position FROM a QUALIFY position <= {c.retrieve_limit}""",
        "source_completion": f"""
            WITH {_bm25(False)}, ch AS (SELECT block_id, source, page, trim(coalesce(section_path, '')) AS path, trim(coalesce(section, '')) AS section, coalesce(text, '') AS text FROM blocks WHERE source IS NOT NULL),
            f AS (SELECT question_id, rank, source, path FROM bm JOIN ch USING (block_id)),
            a AS (SELECT question_id, source, min(rank) AS first_hit FROM f GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM ch GROUP BY source),
            hs AS (SELECT DISTINCT question_id, source, path FROM f WHERE path <> ''),
            rows AS (SELECT question_id, block_id, first_hit, source, page, n, path, section, text FROM a JOIN n USING (source) JOIN ch USING (source))
            SELECT question_id, block_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY first_hit, source, page IS NULL, coalesce(page, 0), path, section, text, block_id) AS INTEGER) AS position
            FROM rows WHERE n <= {c.summary_full_source_max} OR NOT EXISTS (SELECT 1 FROM hs WHERE hs.question_id = rows.question_id AND hs.source = rows.source)
               OR EXISTS (SELECT 1 FROM hs WHERE hs.question_id = rows.question_id AND hs.source = rows.source AND (starts_with(rows.path, hs.path) OR starts_with(hs.path, rows.path)))
            QUALIFY position <= {c.summary_retrieve_limit}""",
        "answer_contexts": f"""
            WITH {_bm25(False)}, pc AS (SELECT question_id, rank, source, '[来源: ' || coalesce(source, '未知来源') || CASE WHEN page IS NULL THEN '' ELSE '（第 ' || page::VARCHAR || ' 页）' END ||
                   CASE WHEN coalesce(tier, '') || coalesce(section, '') = '' THEN '' ELSE '【' || concat_ws('】【', nullif(tier, ''), nullif(section, '')) || '】' END || ']' || chr(10) || coalesce(text, '') AS piece
                   FROM bm JOIN blocks USING (block_id)),
            pf AS (SELECT question_id, source, min(rank) AS pos FROM pc GROUP BY ALL), ps AS (SELECT question_id, string_agg(source, '|' ORDER BY pos) AS sources FROM pf GROUP BY ALL)
            SELECT question_id, CAST(length(string_agg(piece, chr(10) || chr(10) ORDER BY rank)) AS INTEGER) AS n_chars, any_value(sources) AS sources FROM pc JOIN ps USING (question_id) GROUP BY question_id""",
        "scope_filter": "SELECT block_id, source FROM blocks WHERE coalesce(tier, '') = '市级政策'",
        "question_classes": f"SELECT {_classes(c)} FROM questions",
        "local_sources": f"WITH {_LOCAL} SELECT source FROM loc",
        "named_files": f"WITH {_NAMED} SELECT question_id, source FROM named",
        "scoped_sources": f"""
            WITH {_NAMED}, {_LOCAL}, k AS (SELECT {_classes(c)} FROM questions),
            own AS (SELECT question_id, source FROM named SEMI JOIN (SELECT question_id FROM k WHERE tier_found IS NULL AND NOT wants_other) USING (question_id) SEMI JOIN loc USING (source))
            SELECT question_id, source FROM own UNION ALL SELECT question_id, source FROM named ANTI JOIN own USING (question_id)""",
        "history_window": f"""
            WITH {_TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM nt)
            SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, role, content FROM b WHERE back <= {c.history_messages}""",
        "answered_turns": f"""
            WITH {_TURNS}, n AS (SELECT *, lead(role) OVER o AS nr, lead(unk) OVER o AS nu FROM nt WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
            SELECT conv_id, turn, role, content FROM n WHERE (role = 'assistant' AND NOT unk) OR (role = 'user' AND (nr IS NULL OR (nr = 'assistant' AND NOT nu)))""",
        "history_topics": f"""
            WITH {_TURNS}, {_RESOLVED}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ow)
            SELECT conv_id, arg_max(own, turn) AS topic FROM l WHERE back <= {c.history_messages} AND own IS NOT NULL GROUP BY conv_id""",
        "resolved_questions": f"WITH {_TURNS}, {_RESOLVED} SELECT conv_id, turn, question FROM rs WHERE role = 'user'",
        "conversation_queries": f"""
            WITH {_TURNS}, {_RESOLVED} SELECT conv_id, turn, 1 AS position, question AS query FROM rs WHERE role = 'user'
            UNION ALL SELECT conv_id, turn, 2, last_user || ' ' || question FROM rs WHERE role = 'user' AND last_user IS NOT NULL""",
        "pending_consent": f"""
            WITH {_TURNS}, b AS (SELECT *, lag(role) OVER o AS pr, lag(unk) OVER o AS pu FROM nt WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
            SELECT conv_id, turn, {_AGREES} AS consents FROM b WHERE role = 'user' AND pr = 'assistant' AND pu""",
        "web_searches": f"""
            WITH {_TURNS}, {_RESOLVED}, a AS (SELECT *, {_AGREES} AS agrees, regexp_replace(regexp_replace(question, '{SEARCH_STRIP}', ''), '^[，。！？!?、 \\t\\r\\n]+|[，。！？!?、 \\t\\r\\n]+$', '', 'g') AS rest FROM rs)
            SELECT conv_id, turn, CASE WHEN agrees THEN coalesce(last_user, '') WHEN rest <> '' THEN rest ELSE question END AS query
            FROM a WHERE role = 'user' AND ({_any("content", c.search_words)} OR agrees AND offered)""",
        "answers_from_history": f"""
            WITH {_TURNS}, b AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {c.history_messages}),
            k AS (SELECT conv_id, arg_max(content, turn) AS answer FROM b WHERE role = 'assistant' AND NOT unk GROUP BY conv_id),
            e AS (SELECT conv_id, turn, unnest(sources) AS source, generate_subscripts(sources, 1) AS pos FROM b WHERE role = 'assistant'),
            f AS (SELECT conv_id, source, min(turn * 100000 + pos) AS m FROM e WHERE trim(source) <> '' GROUP BY ALL),
            g AS (SELECT conv_id, string_agg(source, '|' ORDER BY m) AS sources FROM f GROUP BY conv_id)
            SELECT conv_id, answer, coalesce(sources, '') AS sources FROM k LEFT JOIN g USING (conv_id)""",
        "history_sources": f"""
            WITH {_TURNS}, e AS (SELECT conv_id, turn, unnest(sources) AS source, generate_subscripts(sources, 1) AS pos FROM nt WHERE role = 'assistant'),
            f AS (SELECT conv_id, source, min(turn * 100000 + pos) AS m FROM e WHERE source <> '' GROUP BY ALL)
            SELECT conv_id, source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY m, source) AS INTEGER) AS position FROM f""",
        "transcripts": f"""
            WITH {_TURNS}, b AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {c.history_messages})
            SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || content, chr(10) ORDER BY turn) AS history FROM b GROUP BY conv_id""",
        "turn_activity": """
            WITH t AS (SELECT * FROM turns WHERE conv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn_id) = 1)
            SELECT date_trunc('hour', asked_at)::TIMESTAMP AS hour, lower(role) AS role, count(*) AS turns FROM t GROUP BY ALL""",
        "answer_lines": rf"""
            WITH {_TURNS}, l AS (SELECT turn_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM nt WHERE role = 'assistant')
            SELECT turn_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,4}}\s') THEN 'heading' || least(length(regexp_extract(line, '^(#{{1,4}})\s', 1)), 3)::VARCHAR
                   WHEN regexp_matches(line, '^\s*[-*•]\s') THEN 'bullet' WHEN regexp_matches(line, '^\s*[0-9]+[.、)]\s*') THEN 'numbered' ELSE 'body' END AS kind,
                   replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS line FROM l""",
        "sanitized_answers": f"""
            WITH {_TURNS} SELECT turn_id, array_to_string(list_transform(regexp_extract_all(content, '《[^》]*》|[^《]+|《'), lambda x:
                   CASE WHEN starts_with(x, '《') AND ends_with(x, '》') THEN x ELSE {_replaced("x", c.sanitize_rules)} END), '') AS content FROM nt WHERE role = 'assistant'""",
        "answer_sentences": f"""
            WITH {_TURNS}, s AS (SELECT turn_id, list_filter(list_transform(regexp_split_to_array(content, '[{T.SENTENCE_MARKS}\\n]+'), lambda x: {_strip("x")}), lambda x: x <> '') AS ss FROM nt)
            SELECT turn_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sentence_no, unnest(ss) AS sentence FROM s""",
        "web_merge": f"""
            WITH r AS (SELECT query_text, {_clean("coalesce(title, '')")} AS title, url, {_clean("coalesce(snippet, '')")} AS snippet, {rank} AS e, result_rank, result_id FROM web_results WHERE regexp_matches(url, '^https?://') AND query_text IS NOT NULL),
            f AS (SELECT * FROM r WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY query_text, url, title ORDER BY e, result_rank, result_id) = 1)
            SELECT query_text, CAST(row_number() OVER (PARTITION BY query_text ORDER BY e, result_rank, result_id) AS INTEGER) AS position, title, url, snippet FROM f QUALIFY position <= {c.web_results}""",
        "web_query_urls": "SELECT DISTINCT query_text, replace(url_encode(query_text), '%20', '+') AS encoded FROM web_results",
        "append_new_sources": "SELECT source, rel_path FROM source_files WHERE source NOT IN (SELECT source FROM blocks WHERE source IS NOT NULL)",
        "audit_totals": f"""
            WITH {files}, s AS (SELECT source, count(DISTINCT block_seq) AS stored FROM blocks GROUP BY source),
            j AS (SELECT coalesce(lf.source, s.source) AS source, n_blocks AS listed, stored FROM lf FULL JOIN s ON lf.source = s.source),
            e AS (SELECT count(*) - count(DISTINCT source) AS twice FROM source_files WHERE source IS NOT NULL)
            SELECT count(*) AS checked, count_if(stored IS NULL OR listed IS NULL OR listed <> stored)::BIGINT AS issues, any_value(twice) AS listed_again FROM j, e""",
        "audit_counts": f"""
            WITH {files}, s AS (SELECT source, count(DISTINCT block_seq) AS stored FROM blocks GROUP BY source),
            j AS (SELECT coalesce(lf.source, s.source) AS source, n_blocks AS listed, stored FROM lf FULL JOIN s ON lf.source = s.source)
            SELECT source, listed, stored, CASE WHEN stored IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' ELSE 'count' END AS issue FROM j WHERE stored IS NULL OR listed IS NULL OR listed <> stored""",
    }
