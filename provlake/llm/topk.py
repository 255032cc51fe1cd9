"""Exact top-k search by inner product, by distributed histogram selection.

Vectors are taken as integers (floor(scale * x)), so scores are exact. Queries are taken in blocks
of ``BLOCK`` (streamed to the driver partition by partition, and broadcast block by block: at most
BLOCK vectors at a time). For a block every candidate is scored, in matrix products:

1. A global histogram of the scores of each query, with ``BINS`` bins over the range that scores
   can have, shows the bin of the k-th highest score; a next histogram over that bin alone shows it
   more finely, until bins are one integer wide and the k-th value is known. A task sends
   only its bins from its own k-th highest score up, as lower ones cannot hold the global one.
2. A last pass filters the scores at or above the k-th value. Of scores equal to it, each task sends
   the k + 1 smallest ids, as no more can be among the global ones. Ranks go by score, then id.

A query's own row is left out by count: its score is taken off the histogram once and one
row with its id and score is dropped. Other rows with the same id stay candidates.

Rows: a vector that is null, holds a null or non-finite component or one whose scaled magnitude
reaches 2**27 (scores would not fit a long) takes no part. Components that one vector has and the
other lacks add nothing; an empty vector scores 0. A null id is never a query and comes last in
ties. Repeated query rows are queries of their own. No queries or no rows give no rows. Other
columns are not read. Each block's result is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlake.llm.vectors import matrix, scaled, usable
from provlake.session import scratch_path

BLOCK, BINS = 2048, 2048
#: Candidates scored at once, and found rows held before they are cut to the best.
ROWS, HELD = 1024, 1 << 20
RESULT = "query_id long, rank int, vec_id long, score long"
#: A query without k candidates takes every score.
_ALL = -(1 << 62)


def _scores(x: np.ndarray, q: np.ndarray, peak: int) -> np.ndarray:
    """Exact inner products (candidates x queries): in floats where all partial sums fit them."""
    kind = np.float32 if peak < 1 << 24 else np.float64 if peak < 1 << 53 else np.int64
    return x.astype(kind) @ q.T.astype(kind)


def _tops(counts: np.ndarray, k: int) -> np.ndarray:
    """Per query the highest bin with at least ``k`` counts in it and above; 0 where there is none."""
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    return np.maximum((above >= k).sum(1) - 1, 0)


def _histogram(rows: DataFrame, shared, k: int, scale: int, bins: int) -> DataFrame:
    """(q, need, bin, n): per task the bins that can hold a query's k-th value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, peak, low, high, width, need = shared.value
        counts = np.zeros((len(q), bins), np.int32)
        floor = low.copy()
        for b in batches:
            _, x = matrix(b.column(0), scale, q.shape[1], False)
            for at in range(0, len(x), ROWS):
                s = _scores(x[at:at + ROWS], q, peak)
                which = np.nonzero((s >= floor) & (s < high))
                cell = (s[which].astype(np.int64) - low[which[1]]) // width[which[1]]
                np.add.at(counts.reshape(-1), which[1] * bins + cell, 1)
                floor = low + width * _tops(counts, k + 1)
        qs, cell = np.nonzero(counts)
        keep = cell >= _tops(counts, k + 1)[qs]
        qs, cell = qs[keep], cell[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(qs.astype(np.int32)), pa.array(need[qs].astype(np.int32)),
             pa.array(cell.astype(np.int32)), pa.array(counts[qs, cell].astype(np.int64))],
            names=["q", "need", "bin", "n"])

    return rows.mapInArrow(run, "q int, need int, bin int, n long")


def _kth(rows: DataFrame, q: np.ndarray, peak: int, reach: np.ndarray, own: np.ndarray, k: int,
         scale: int, bins: int) -> np.ndarray:
    """The k-th highest score of each query, its own row left out; _ALL where there are fewer."""
    spark = rows.sparkSession
    low, span = -reach, 2 * reach + 1
    need, few = np.full(len(q), k), np.zeros(len(q), bool)
    while span.max() > 1:
        width = -(-span // bins)
        cell = (own - low) // width
        inside = (own >= low) & (own < low + span)
        shared = spark.sparkContext.broadcast((q, peak, low, low + span, width, need))
        less = spark.createDataFrame(
            [(int(i), int(need[i]), int(cell[i]), -1) for i in np.flatnonzero(inside)],
            "q int, need int, bin int, n long")
        seen = (_histogram(rows, shared, k, scale, bins).unionByName(less)
                .groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))
                .withColumn("upto", F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))))
        at = np.full(len(q), -1)
        for r in seen.filter("upto >= need AND upto - n < need").collect():
            at[r["q"]] = r["bin"]
            need[r["q"]] -= r["upto"] - r["n"]
        few |= at < 0
        low, span = low + width * np.maximum(at, 0), np.where(few, 1, width)
    return np.where(few, _ALL, low)


def _cut(parts: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """Of (query, score, id missing, id) rows the ``k`` best of each query."""
    qs, s, none, ids = columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((ids, none, -s, qs))
    nth = np.arange(len(qs)) - np.searchsorted(qs[order], qs[order])
    return [tuple(c[order[nth < k]] for c in columns)]


def _best(rows: DataFrame, shared, k: int, scale: int) -> DataFrame:
    """(q, score, vec_id): per task and query at most k + 1 rows at or above the k-th value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, peak, least = shared.value
        parts, held = [], 0
        for b in batches:
            at, x = matrix(b.column(1), scale, q.shape[1], False)
            given = b.column(0).take(pa.array(at))
            none = given.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(given, 0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), ROWS):
                s = _scores(x[i:i + ROWS], q, peak)
                r, which = np.nonzero(s >= least)
                parts.append((which, s[r, which].astype(np.int64), none[i + r], ids[i + r]))
                held += len(r)
                if held > HELD:
                    parts = _cut(parts, k + 1)
                    held = len(parts[0][0])
        if parts:
            qs, s, none, ids = _cut(parts, k + 1)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qs.astype(np.int32)), pa.array(s), pa.array(ids, mask=none)],
                names=["q", "score", "vec_id"])

    return rows.mapInArrow(run, "q int, score long, vec_id long")


def _ranked(found: DataFrame, queries: list[tuple[int, int]], k: int) -> DataFrame:
    """Ranks per query after its own row is dropped; ``queries`` are (id, own score)."""
    q = found.sparkSession.createDataFrame(
        [(i, *x) for i, x in enumerate(queries)], "q int, query_id long, own long")
    order = (F.desc("score"), F.col("vec_id").asc_nulls_last())
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    return (found.join(F.broadcast(q), "q").withColumn("is_own", own)
            .withColumn("nth", F.row_number().over(W.partitionBy("q", "is_own").orderBy(*order)))
            .filter("NOT (is_own AND nth = 1)")
            .withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order)))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
           id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
           bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every row with ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    asked = (vectors.filter(is_query & F.col(id_col).isNotNull() & usable(vector, scale))
             .select(F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("v")))
    top = rows.filter(usable("v", scale)).select(
        F.array_max(F.transform("v", lambda x: F.abs(F.floor(x.cast("double") * scale)))).alias("m"),
        F.size("v").alias("n")).agg(F.max("m"), F.max("n")).first()
    most, path = int(top[0] or 0), None
    for part in _blocks(asked, block):
        q = np.zeros((len(part), max(1, max(len(r["v"]) for r in part))), np.int64)
        for i, r in enumerate(part):
            q[i, :len(r["v"])] = r["v"]
        peak = int(np.abs(q).max()) * most * q.shape[1]
        reach, own = np.abs(q).sum(1) * most, (q * q).sum(1)
        least = _kth(rows.select("v"), q, peak, reach, own, k, scale, bins)
        shared = spark.sparkContext.broadcast((q, peak, least))
        ids = [(r["id"], int(s)) for r, s in zip(part, own, strict=True)]
        path = path or scratch_path(spark, "topk")
        _ranked(_best(rows, shared, k, scale), ids, k).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path) if path else spark.createDataFrame([], RESULT)
