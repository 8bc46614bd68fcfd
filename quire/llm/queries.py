"""The queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import lookalike, mixing, mojibake, pieces, scans, sentences, site_lines, tokens
from quire.session import table

NOT_SCANNED = "NOT coalesce(ocr, false)"


SCAN_COLUMNS = ("block_id", "source", "page", "block_seq", "text", "ocr")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(table(spark, sf_dir, "blocks").select(*SCAN_COLUMNS))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "blocks").select(*SCAN_COLUMNS)).select("block_id", "paragraphs")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter("doc_kind = 'bulletin'").select("block_id", "text")
    return sentences.sentence_ends(blocks, blocks)


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every block, by the model of `p2_found`: bulletins are in all eleven languages."""
    blocks = table(spark, sf_dir, "blocks")
    lessons = blocks.filter("doc_kind = 'bulletin'").select("block_id", "text")
    return sentences.sentences(blocks.select("block_id", "text"), lessons).select("block_id", "sent_no", "sent_end", "sentence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter(NOT_SCANNED)
    return site_lines.repeated_lines(blocks.select("block_id", "source", "text"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block; recognised ones have no site lines and come out as they are."""
    blocks = table(spark, sf_dir, "blocks")
    clean = site_lines.strip_site_lines(blocks.filter(NOT_SCANNED).select("block_id", "source", "text")).select("block_id", "clean_text")
    return clean.unionByName(blocks.filter("ocr").select("block_id", F.col("text").alias("clean_text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.wrong_fields(table(spark, sf_dir, "blocks").select("block_id", "text", "source"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mojibake.restore_fields(table(spark, sf_dir, "blocks").select("block_id", "text", "source"))
    return out.select("block_id", F.col("text_fixed").alias("text"), F.col("source_fixed").alias("source"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_fields(table(spark, sf_dir, "blocks").select("block_id", "text", "section", "source"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookalike.unify(table(spark, sf_dir, "blocks").select("block_id", "text", "section"))
    return out.select("block_id", F.col("text_plain").alias("text"), F.col("section_plain").alias("section"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*(table(spark, sf_dir, t) for t in ("documents", "mix_plans", "mix_targets")))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_profiles"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_sentences, p3_found, p3_clean, p4_found, p4_restored, p5_found, p5_unified, p6_ids, p7_mixture, p7_shares, p8_pieces)}


#: White space as the operator takes it out.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": rf"""
            WITH b AS (SELECT block_id, source, string_split(text, chr(10)) AS ls FROM blocks
                       WHERE NOT coalesce(ocr, false) AND source IS NOT NULL),
            l AS (SELECT block_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM b WHERE ls IS NOT NULL),
            k AS (SELECT block_id, source, line_no,
                         regexp_replace(regexp_replace(line, '{_SPACE}', '', 'g'), '[0-9]+', '0', 'g') AS key FROM l),
            n AS (SELECT source, count(*) AS n FROM b GROUP BY source),
            d AS (SELECT source, key, count(DISTINCT block_id) AS df FROM k WHERE key <> '' GROUP BY source, key)
            SELECT k.block_id, CAST(k.line_no AS INTEGER) AS line_no
            FROM k JOIN d USING (source, key) JOIN n USING (source)
            WHERE df >= 8 AND df >= 0.05 * n""",
    }
