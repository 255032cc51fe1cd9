"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlake.session import cut_lineage

#: Fixed value: words are runs of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: One fifth of the documents is held out from learning.
FOLDS = 5
#: Rows of each class that a classifier learns from, at most.
SAMPLE_PER_CLASS = 2000


class WordIndex(dict):
    """Word -> row of a table that grows; a new word gets a row and waits to be looked into."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        self.chars += len(word)
        return n


def release() -> None:
    """Give freed memory back to the system: workers live on, and their peaks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that leaves no memory behind once its partition is done."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a light ridge on the slope; targets smoothed."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = x.std() or 1.0
    a, b = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - target) + np.array([1e-3 * b[0], 0])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column in ``taken`` is called that."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True in the held-out fold; a null id is in no fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == 0, F.lit(False))


def sample_ids(rows: DataFrame, per_class: int, of: str = "y", key: str = "doc_id") -> DataFrame:
    """Of each class the ``per_class`` ids with the smallest hashes: a bounded, repeatable sample.

    Only ids travel here. The classes are those of a binary label, 0 and 1.
    """
    parts = [rows.filter(F.col(of) == k).select(key, of).distinct()
             .orderBy(F.xxhash64(key), key).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str,
                    per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` learnable documents of each label.

    Documents of the held-out fold, null labels and null texts are left out. The sampled ids are
    at most twice ``per_class`` rows, so they are broadcast and texts are filtered where they lie.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = sample_ids(y, per_class)
    # Of several texts with one id the one of the smallest digest is learnt from.
    return (docs.select("doc_id", "text").filter(F.col("text").isNotNull())
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y")
            .agg(F.min_by("text", F.struct(F.sha2("text", 256), "text")).alias("text"))
            .select("doc_id", "y", "text"))


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """Fit on a bounded sample in one executor task; the driver receives the fitted parameters."""
    names = sample.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        rows = pd.concat(got, ignore_index=True) if got else pd.DataFrame(columns=names)
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows), protocol=4)]})

    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    # An empty sample may reach no task at all.
    return pickle.loads(bytes(row[0])) if row else fit(pd.DataFrame(columns=names))


def scored(docs: DataFrame, model: object, scorer: Callable[[object], Callable],
           schema: str, as_name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``as_name``; ``scorer(model)`` maps a Series of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer(shared.value)
        for s in series:
            yield score(s)

    @F.pandas_udf(schema)
    def udf(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(series)

    return docs.withColumn(as_name, udf(F.col(text)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps until the edges stand still, which takes a
    number of rounds in the logarithm of the longest path. Minima are taken with partial
    aggregation and written before they are joined, so that a hub's rows can be split.
    """
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a <> b").distinct())
    e = cut_lineage(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        star = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .filter("a <> b").distinct())
        star = cut_lineage(star)
        low = cut_lineage(star.groupBy("a").agg(F.min("b").alias("m")))
        e = (star.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*").filter("a <> b").distinct())
        e = cut_lineage(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def gapless(rows: DataFrame, group: list[str], order: list[str], name: str, chunks: int = 1024,
            across: bool = False) -> DataFrame:
    """``rows`` with a number from 0 without gaps in each group (or ``across`` all groups).

    Rows are dealt by a hash of the order columns into chunks, numbered in their chunk, and each
    chunk is moved by the rows before it. For few groups only: the offsets (groups x chunks rows)
    are broadcast. ``rows`` is used twice and should be cheap to compute again.
    """
    c = fresh("_chunk", rows.columns)
    off = fresh("_offset", rows.columns)
    dealt = rows.withColumn(c, F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = dealt.groupBy(*group, c).agg(F.count(F.lit(1)).alias("_n"))
    over = (W.orderBy(*group, c) if across else W.partitionBy(*group).orderBy(c)).rowsBetween(
        W.unboundedPreceding, -1)
    offsets = counts.select(*group, c, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias(off))
    in_chunk = F.row_number().over(W.partitionBy(*group, c).orderBy(*order))
    return (dealt.join(F.broadcast(offsets), [*group, c])
            .withColumn(name, (F.col(off) + in_chunk - 1).cast("long")).drop(c, off))
