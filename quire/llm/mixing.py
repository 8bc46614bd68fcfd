"""Mixing sources to target weights (problem 7).

Method: weighted fair queueing. The records of a source are shuffled by a hash;
the virtual finish time of a record's copy is the source's cumulative tokens up
to it, divided by the source's weight; the copies of all sources are sorted by
finish time and cut off at the plan's budget.

Prefix sums are taken in two levels, by hash buckets within a source and by the
parts of a global range sort of all copies by finish time, whose boundaries are
quantiles, so that no source or plan is ever in one task however its weights
differ. The number of parts follows the counted rows.

Defined results
---------------
* null and empty texts have no tokens and are never used;
* a source without documents, a null source and sources outside a plan add
  nothing; a source that has used all its repeats leaves its share to the rest;
* ties of finish time go by source, then document, then copy;
* the budget is `size_factor` times the tokens of the plan's sources taken once;
  the mixture is the longest prefix that stays within it;
* weights of zero or less, and repeats below one, exclude a source;
* a document delivered twice under one `doc_id` counts as two records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZERS, encoder, slices
from quire.session import cut

#: Rows that a bucket of a prefix sum holds, about.
BUCKET_ROWS = 50_000
#: Plans and targets of up to so many rows are sent to all tasks; larger ones are joined.
SMALL_PLAN = 100_000


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Adds `n_tokens` to rows of (`doc_id`, `source`, `text`, `tokenizer`); drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            names = np.array(batch.column("tokenizer").to_pylist(), object)
            counts = np.zeros(len(texts), np.int64)
            for name in sorted(set(names)):
                at = np.flatnonzero(names == name)
                enc = encoder((name,), folder)
                parted = enc.learn([texts[i] or "" for i in at])
                counts[at] = [sum(len(enc.clauses[0][c]) for c in p) // 4 for p in parted]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tokenizer"), pa.array(counts)], names=["doc_id", "source", "tokenizer", "n_tokens"])

    columns = documents.select("doc_id", "source", "text", "tokenizer")
    return columns.mapInArrow(run, "doc_id bigint, source string, tokenizer string, n_tokens bigint")


def _running(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the running sum of `value` within `groups`, by buckets that keep the order."""
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_q_sum"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_q_before", F.coalesce(F.sum("_q_sum").over(before), F.lit(0))).drop("_q_sum")
    inside = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(sums, [*groups, bucket]).withColumn(out, F.sum(value).over(inside) + F.col("_q_before")).drop("_q_before")


def mixture(documents: DataFrame, plans: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(`mix_name`, `doc_id`, `copy`, `source`, `n_tokens`, `finish`): the records of each plan's mixture."""
    wanted = targets.filter("target_weight > 0 AND max_repeats >= 1 AND source IS NOT NULL").select(
        "mix_name", "source", F.col("target_weight").alias("_q_w"), F.col("max_repeats").alias("_q_rep")
    )
    plans = plans.select("mix_name", "tokenizer", F.col("size_factor").alias("_q_factor"))
    small = F.broadcast if targets.count() + plans.count() <= SMALL_PLAN else lambda df: df
    asked = small(wanted.join(plans, "mix_name").select("source", "tokenizer").distinct())
    plans, wanted = small(plans), small(wanted)
    texts = documents.select("doc_id", "source", "text").filter("text IS NOT NULL AND text <> ''")
    sized = cut(token_counts(texts.join(asked, "source"), folder))
    rows = sized.join(plans, "tokenizer").join(wanted, ["mix_name", "source"])
    totals = rows.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("_q_total"), F.count("*").alias("_q_n"))
    whole = totals.groupBy("mix_name").agg(F.sum("_q_total").alias("_q_once"), F.sum("_q_n").alias("_q_rows"))
    u = F.xxhash64("mix_name", "doc_id")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_q_n") / BUCKET_ROWS))
    rows = rows.join(small(totals), ["mix_name", "source"]).withColumn("_q_u", u)
    rows = rows.withColumn("_q_b", F.floor((F.col("_q_u") / F.lit(2.0**64) + 0.5) * parts))
    rows = _running(rows, ["mix_name", "source"], "_q_b", ["_q_u", "doc_id"], "n_tokens", "_q_cum")
    rows = rows.join(small(whole), "mix_name").withColumn("_q_budget", F.col("_q_factor") * F.col("_q_once"))
    # a copy before which its own source has more tokens than the budget is beyond it; only the others are made
    most = F.least(F.col("_q_rep") - 1, F.floor((F.col("_q_budget") - F.col("_q_cum")) / F.col("_q_total"))).cast("int")
    rows = rows.filter(F.col("_q_cum") <= F.col("_q_budget"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), most))).select(
        "mix_name", "doc_id", "copy", "source", "n_tokens", ((F.col("copy") * F.col("_q_total") + F.col("_q_cum")) / F.col("_q_w")).alias("finish"), "_q_budget"
    )
    copies = cut(copies)
    order = ["finish", "source", "doc_id", "copy"]
    ranges = max(1, -(-copies.count() // BUCKET_ROWS))
    # the parts of the sort are written down, so that sums over them are of the same rows
    copies = cut(copies.repartitionByRange(ranges, "mix_name", *order).withColumn("_q_slice", F.spark_partition_id()))
    copies = _running(copies, ["mix_name"], "_q_slice", order, "n_tokens", "_q_at")
    return copies.filter(F.col("_q_at") <= F.col("_q_budget")).select("mix_name", "doc_id", "copy", "source", "n_tokens", "finish")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reached shares of each source of each plan."""
    reached = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), (F.max("copy") + 1).alias("most_repeats"))
    plan = W.partitionBy("mix_name")
    return (
        targets.join(reached, ["mix_name", "source"], "left")
        .fillna(0, ["tokens", "records", "most_repeats"])
        .withColumn("wanted_share", F.col("target_weight") / F.sum("target_weight").over(plan))
        .withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(plan), F.lit(0)), F.lit(0.0)))
        .select("mix_name", "source", "max_repeats", "most_repeats", "records", "tokens", "wanted_share", "reached_share")
    )
