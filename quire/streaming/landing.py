"""Ingesting what lands in a folder, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.config import DEFAULTS, EngineConfig
from quire.operators.index import append
from quire.plans.ingest import add_files, new_files
from quire.sources.listing import described


def ingest_files(spark: SparkSession, landing: str, index: str, checkpoint: str, config: EngineConfig = DEFAULTS) -> StreamingQuery:
    """Chunks of files that are new in `landing` go to `index`; ends when all are in.

    The file source remembers what it has read in `checkpoint`, and each batch is
    joined against the indexed sources before it is parsed, so a restart adds
    nothing twice. Tiers come from folders, and lock files stay out, as in `ingest`.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(landing)

    def add(batch: DataFrame, _: int) -> None:
        add_files(new_files(described(batch, landing), index), index, config)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_rows(spark: SparkSession, folder: str, schema, index: str, checkpoint: str) -> StreamingQuery:
    """Parquet rows that land in a folder go to an index if their source is new."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(lambda batch, _: append(batch, index) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turn_activity(turns: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(`window`, `role`, `turns`): a stream of turns counted by hour, deliveries of a turn once.

    Late turns are waited for as long as the watermark says.
    """
    rows = turns.withWatermark("asked_at", late).withColumn("role", F.lower("role"))
    rows = rows.dropDuplicatesWithinWatermark(["conv_id", "turn"]) if rows.isStreaming else rows.dropDuplicates(["conv_id", "turn"])
    return rows.groupBy(F.window("asked_at", width), "role").agg(F.count("*").alias("turns"))
