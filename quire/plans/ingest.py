"""From a folder of files to an index of chunks, new files only."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULTS, EngineConfig
from quire.operators import chunking
from quire.session import cut
from quire.sources.listing import described, list_files, load_pages

#: New files that one job reads; their paths are all that the driver holds at once.
BATCH = 20_000


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of an index; one that was never made raises."""
    if not exists(spark, f"{index}/chunks"):
        raise FileNotFoundError(f"no index in {index}; ingest a folder first")
    return spark.read.parquet(f"{index}/chunks")


def new_files(listed: DataFrame, index: str) -> DataFrame:
    """Listed files whose source has no chunk in the index; only names are compared, nothing is read."""
    spark = listed.sparkSession
    if not exists(spark, f"{index}/chunks"):
        return listed
    return listed.join(spark.read.parquet(f"{index}/chunks").select("source").distinct(), "source", "left_anti")


def add_files(files: DataFrame, index: str, config: EngineConfig = DEFAULTS) -> int:
    """Parses files, makes their chunks and adds them to the index; returns how many.

    What cannot be read goes to `errors`, apart from the chunks, so the next run
    tries it again. The number comes from the write itself.
    """
    pages = cut(load_pages(files))
    bad = pages.filter("error IS NOT NULL").select("source", "path", "error", F.current_timestamp().alias("seen_at"))
    if not bad.isEmpty():
        bad.write.mode("append").parquet(f"{index}/errors")
    chunks = chunking.chunks_of(pages.filter("error IS NULL"), config)
    chunks = chunks.select(F.xxhash64("source", "segment", "chunk_seq").alias("block_id"), "*")
    count = Observation()
    chunks.observe(count, F.count("*").alias("n")).write.mode("append").parquet(f"{index}/chunks")
    return count.get["n"]


def _batches(paths: Iterator[str], n: int) -> Iterator[list[str]]:
    while batch := list(islice(paths, n)):
        yield batch


def ingest(spark: SparkSession, root: str, index: str, rebuild: bool = False, config: EngineConfig = DEFAULTS) -> int:
    """Adds the files of a folder that are new, or all of them to a new index; returns the chunks added.

    The listing meets the index by source first, and only new files are opened. A
    rebuild first writes everything beside the old index and then takes its place.
    """
    listed = list_files(spark, root).drop("content")
    target = f"{index}/rebuilt" if rebuild else index
    todo = cut((listed if rebuild else new_files(listed, index)).select("path").orderBy("path"))
    added = 0
    for paths in _batches((r["path"] for r in todo.toLocalIterator()), BATCH):
        files = spark.read.format("binaryFile").load([_escaped(p) for p in paths])
        added += add_files(described(files, root), target, config)
    if rebuild:
        _replace(spark, index)
    return added


def _escaped(path: str) -> str:
    """A path whose glob signs are taken as they are."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def _replace(spark: SparkSession, index: str) -> None:
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = path(index).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in ("chunks", "errors"):
        files.delete(path(f"{index}/{part}"), True)
        if files.exists(path(f"{index}/rebuilt/{part}")):
            files.rename(path(f"{index}/rebuilt/{part}"), path(f"{index}/{part}"))
    files.delete(path(f"{index}/rebuilt"), True)
