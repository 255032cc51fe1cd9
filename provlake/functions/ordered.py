"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts a whole key into one task.  Here the order
axis is cut into chunks: each (key, chunk) is windowed on its own, the per-chunk totals (one row
each) are scanned per key, and the carry is joined back.  Results equal the plain window; no task
sees more than ``chunk_rows`` rows of a key plus one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20

_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min,
          "last": lambda c: F.last(c, ignorenulls=True)}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column]],
            *, inclusive: bool = False, chunk: Column | None = None,
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add running aggregates of ``specs`` (name -> (sum|max|min|last, value)) along ``order``.

    ``keys`` must not be null; ``order`` is unique within a key and increases with ``chunk``.
    """
    chunk = F.floor(F.col(order) / chunk_rows) if chunk is None else chunk
    names = list(specs)
    base = df.withColumn("_ck", chunk)
    for i, n in enumerate(names):
        base = base.withColumn(f"_v{i}", specs[n][1])
    part = [*keys, "_ck"]

    def total(i: int, kind: str) -> Column:
        if kind == "last":
            return F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(order)))
        return _LOCAL[kind](F.col(f"_v{i}"))

    totals = base.groupBy(*part).agg(
        *[total(i, specs[n][0]).alias(f"_t{i}") for i, n in enumerate(names)])
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        "_ck").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[
        _LOCAL[specs[n][0]](F.col(f"_t{i}")).over(before).alias(f"_c{i}")
        for i, n in enumerate(names)])
    rows = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = base.select("*", *[
        _LOCAL[specs[n][0]](F.col(f"_v{i}")).over(rows).alias(f"_l{i}")
        for i, n in enumerate(names)])
    out = local.join(carry, part, "left")
    return out.select(*[c for c in df.columns if c not in names], *[
        _combine(specs[n][0], F.col(f"_c{i}"), F.col(f"_l{i}")).alias(n)
        for i, n in enumerate(names)])


def dense_index(df: DataFrame, keys: list[str], order: str, name: str, **kw) -> DataFrame:
    """0-based position of each row within its key."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, **kw)


def first_per_key(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The first row of every key, as a partially aggregated min_by instead of a window."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*named).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, exactly.

    A salted first pass keeps at most ``k`` rows per (key, salt), so the second pass sees at most
    ``k * salts`` rows of one key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return (salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k)
            .withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= k)
            .drop("_rn", "_salt"))
