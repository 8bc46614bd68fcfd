"""Building and extending an index, and auditing it against the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T


def listed_files(files: DataFrame) -> DataFrame:
    """Each listed file once, as last loaded: name, suffix, tier from its path."""
    last = W.partitionBy("source").orderBy(F.desc("loaded_at"), "rel_path", "n_blocks")
    rows = files.withColumn("n", F.row_number().over(last)).filter("n = 1")
    return rows.select("source", T.basename(F.col("rel_path")).alias("name"), T.suffix(F.col("rel_path")).alias("suffix"), T.tier_from_path(F.col("rel_path")).alias("path_tier"), "n_blocks", "loaded_at")


def new_rows(incoming: DataFrame, indexed_sources: DataFrame) -> DataFrame:
    """Rows whose source is not indexed yet."""
    return incoming.join(indexed_sources.select("source").distinct(), "source", "left_anti")


def append(incoming: DataFrame, path: str) -> int:
    """Add rows of new sources to a table of rows, which is made if it is not there; returns rows added.

    What is added is counted by the write itself.
    """
    spark = incoming.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        incoming = new_rows(incoming, spark.read.parquet(path).select("source"))
    count = Observation()
    incoming.observe(count, F.count("*").alias("n")).write.mode("append").parquet(path)
    return count.get["n"]


def _audited(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every listed or stored source with its numbers of blocks on both sides and what is amiss."""
    stored = blocks.groupBy("source").agg(F.countDistinct("block_seq").alias("stored"))
    both = listed_files(files).select("source", F.col("n_blocks").alias("listed")).join(stored, "source", "full_outer")
    issue = F.when(F.col("stored").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("stored"), "count")
    return both.select("source", "listed", "stored", issue.alias("issue"))


def audit_counts(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(`source`, `listed`, `stored`, `issue`): sources whose block counts differ or that miss on a side."""
    return _audited(files, blocks).filter("issue IS NOT NULL")


def audit_totals(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(`checked`, `issues`, `listed_again`): sources looked at, those with an issue, and listings beyond the first of a source."""
    totals = _audited(files, blocks).agg(F.count("*").alias("checked"), F.count_if(F.col("issue").isNotNull()).alias("issues"))
    again = files.filter("source IS NOT NULL").groupBy("source").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed_again"))
    return totals.crossJoin(again)  # one row each


def missing_lines(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(`source`, `line`): lines of eight or more characters that no chunk of the source has.

    Both sides are cut to lines without white space and meet on equality; a line
    cut by an oversize split is compared by its sentences.
    """
    keyed = lambda df: df.select("source", F.explode(T.lines(F.col("text"))).alias("line")).select("source", T.squeeze(F.col("line")).alias("line"))
    parts = lambda df: df.select("source", F.explode(F.split("line", "[。；，！？]")).alias("line")).filter(F.length("line") >= 8)
    raw, have = keyed(blocks.filter("text IS NOT NULL")), keyed(chunks)
    lost = raw.filter(F.length("line") >= 8).distinct().join(have.distinct(), ["source", "line"], "left_anti")
    return parts(lost).distinct().join(parts(have).distinct(), ["source", "line"], "left_anti")
