"""Exact nearest neighbours: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.best import Best
from quire.session import cut

#: Queries that the driver sends to all tasks at once; more go in several passes over the rows, one after another.
QUERY_BLOCK = 8_000
#: Numbers that a task holds of distances between its rows and queries.
CELLS = 4_000_000


def _packed(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _by_scope(scopes: list) -> dict[object, np.ndarray]:
    out: dict[object, list[int]] = {}
    for i, s in enumerate(scopes):
        out.setdefault(s, []).append(i)
    return {s: np.array(at) for s, at in out.items()}


def stands(asked: DataFrame, id_col: str, alike: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first of the queries that are equal in the columns `alike`, and (`id`, `_first`): the one that stands for each.

    Null equals null. Both are written to the shared folder.
    """
    first = cut(asked.groupBy(*alike).agg(F.min(id_col).alias(id_col)))
    of = first.select(F.col(id_col).alias("_first"), *(F.col(c).alias(f"_{c}") for c in alike))
    met = asked.join(of, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]))
    return first, cut(met.select(id_col, "_first"))


def in_passes(first: DataFrame, id_col: str, meet: Callable[[DataFrame], tuple[DataFrame, Broadcast] | None]) -> DataFrame | None:
    """What `meet` finds for about QUERY_BLOCK queries at a time, each part written before the next is begun.

    So the driver never has more than one block of queries, and no plan grows with their number.
    """
    blocks, out = max(1, -(-first.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        got = meet(first.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b))
        if got is None:
            continue
        part, shared = cut(got[0]), got[1]
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _pass(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, scopes: list, k: int, threshold: float | None, same: str | None) -> tuple[DataFrame, Broadcast]:
    """The k best rows of each query in every task, and the queries sent, which are bounded by QUERY_BLOCK.

    Relevance is 1 - d / sqrt(2) of squared distances d, to six places, as of a flat
    index. Of a block of distances only those that can still be among the k best of
    their query are looked at.
    """
    # distances by one product: the last column takes half of a row's own square from it
    half = np.concatenate([matrix, np.ones((len(matrix), 1))], 1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, half, (matrix**2).sum(1), _by_scope(scopes)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, half, squares, scoped = shared.value
        best = Best(len(ids), k, -np.inf if threshold is None else threshold - 1e-9)
        for batch in batches:
            x = _packed(batch, "embedding")
            x = np.concatenate([x, -(x**2).sum(1)[:, None] / 2], 1)
            rows = np.asarray(batch.column("vec_id").to_numpy(zero_copy_only=False), np.int64)
            for scope, own in _by_scope(batch.column("scope").to_pylist()).items() if same is not None else [(None, np.arange(len(batch)))]:
                asked = scoped.get(scope, ()) if same is not None else np.arange(len(ids))
                step = max(1, CELLS // max(1, len(asked)))
                for at in range(0, len(own) if len(asked) else 0, step):
                    part = own[at : at + step]
                    near = half[asked] @ x[part].T
                    # the edge a little lower than it is, because relevance is rounded
                    edge = (squares[asked] - (1 - best.edge[asked] + 1e-6) * np.sqrt(2)) / 2
                    q, r = np.nonzero(near >= edge[:, None])
                    d = np.maximum(squares[asked[q]] - 2 * near[q, r], 0)
                    best.offer(asked[q], np.round(1 - d / np.sqrt(2), 6), rows[part[r]])
        q, score, row = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(row, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "relevance"])

    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", *([F.col(same).cast("string").alias("scope")] if same else [])]
    rows = vectors.select(*columns).filter("embedding IS NOT NULL AND size(embedding) > 0")
    return rows.mapInArrow(meet, "query_id bigint, vec_id bigint, relevance double"), shared


def _sent(queries: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids, vectors and scopes of a block of queries, by id; vectors come to the driver as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids = np.asarray(batch.column("query_id").to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "vectors": [_packed(batch, "embedding").tobytes()], "scopes": [batch.column("scope").to_pylist()]})

    parts = queries.select("query_id", "embedding", "scope").mapInArrow(pack, "ids binary, vectors binary, scopes array<string>").collect()
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 1)), []
    ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
    matrix = np.concatenate([np.frombuffer(p["vectors"], np.float64) for p in parts]).reshape(len(ids), -1)
    scopes = [s for p in parts for s in p["scopes"]]
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order], [scopes[i] for i in order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, same: str | None = None) -> DataFrame:
    """(`query_id`, `vec_id`, `relevance`, `rank`): the k nearest vectors of each query.

    `vectors` and `queries` have `vec_id` and `embedding` (one width). Distance is
    squared L2 and relevance 1 - d / sqrt(2), as of a flat index; it is rounded to
    six places before ranking, ties go to the lower id. Queries are sent to the
    rows, QUERY_BLOCK at a time and equal ones once; rows stay where they are, each
    task passes on k rows a query. With `same`, a query only meets vectors of an
    equal value in that column (a scope); null equals null. `threshold` keeps what is
    relevant enough. Rows without a vector are never found; no queries or no rows
    give no rows.
    """
    spark = queries.sparkSession
    asked = queries.filter("embedding IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("bigint").alias("query_id"), "embedding", (F.col(same).cast("string") if same else F.lit(None).cast("string")).alias("scope"))
    best = W.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_id")
    nearest_of = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def meet(block: DataFrame) -> tuple[DataFrame, Broadcast] | None:
        ids, matrix, scopes = _sent(block)
        if not len(ids):
            return None
        rows, shared = _pass(vectors, ids, matrix, scopes, k, threshold, same)
        return nearest_of(rows), shared

    if asked.count() > QUERY_BLOCK:
        first, equal = stands(cut(asked), "query_id", ["embedding", "scope"])
        met = in_passes(first, "query_id", meet)
        return met.withColumnRenamed("query_id", "_first").join(equal, "_first").select("query_id", "vec_id", "relevance", "rank")
    ids, matrix, scopes = _sent(asked)
    if not len(ids):
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, relevance double, rank int")
    alike: dict[tuple, int] = {}
    stand = np.array([alike.setdefault((e.tobytes(), s), i) for i, (e, s) in enumerate(zip(matrix, scopes))])
    own = np.unique(stand)
    met = nearest_of(_pass(vectors, ids[own], matrix[own], [scopes[i] for i in own], k, threshold, same)[0])
    if len(own) < len(ids):
        equal = spark.createDataFrame(pd.DataFrame({"query_id": ids[stand], "_q": ids}), "query_id bigint, _q bigint")
        met = met.join(equal, "query_id").select(F.col("_q").alias("query_id"), "vec_id", "relevance", "rank")
    return met
