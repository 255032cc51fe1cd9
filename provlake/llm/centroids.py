"""Centroid clustering: Lloyd rounds whose nearest centroid is found in a vantage-point tree.

Vectors are taken as integers (floor(scale * x)), so every distance, sum and tie is exact and a
run can be repeated to the last bit. Each round builds a vantage-point tree over the centroids on
the driver (their number times their length is bounded, see ``MOST``) and broadcasts it. A vector
searches best first: it always opens its node of the least lower bound, takes exact integer
distances to the node's centroids, and ends when that bound exceeds its best distance. Nodes whose
bound equals the best distance are opened too, so that of equally near centroids the smallest
number wins. Lower bounds are floating point and are lowered by a relative slack before they prune.
The searches of one batch run side by side, each with its own frontier.

A round sends one row of sums per task and non-empty cluster; nothing else leaves a task.

Rows: a vector that is null, has another length than ``dim``, holds a null or non-finite component
or one whose scaled magnitude reaches 2**27 (distances would not fit a long) is not kept. Repeated
rows are vectors of their own; a null id has no hash and starts no centroid before all other
vectors do. With fewer kept vectors than centroids asked for there are fewer centroids; with none
the result is empty. An empty cluster keeps its centroid. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.vectors import matrix, scaled, usable
from provlake.session import cut_lineage

#: Most components of all centroids together: the tree is broadcast (128 MB).
MOST = 1 << 24
#: Centroids of a leaf, and cells of a batch's frontier matrix.
LEAF, CELLS = 4, 1 << 21
_SLACK = 1e-9


@dataclass
class Tree:
    """Node i: centroids ``held[i]``, children ``child[i]`` (or -1) and, for each child, the range
    of its centroids' distances from the node's first centroid, its vantage point."""

    centroids: np.ndarray
    held: list[np.ndarray]
    child: list[tuple[int, int]]
    near: list[tuple[float, float]]
    far: list[tuple[float, float]]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def build(centroids: np.ndarray) -> Tree:
    """A vantage-point tree: inner nodes hold their vantage point and halve the rest by distance."""
    tree = Tree(centroids, [], [], [], [])
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(centroids)), -1, 0)]
    while todo:
        members, parent, side = todo.pop()
        node = len(tree.held)
        if parent >= 0:
            pair = list(tree.child[parent])
            pair[side] = node
            tree.child[parent] = tuple(pair)
        tree.child.append((-1, -1))
        tree.near.append((0.0, 0.0))
        tree.far.append((0.0, 0.0))
        if len(members) <= LEAF:
            tree.held.append(members)
            continue
        # The vantage point lies far from the mean: it splits the rest more evenly by distance.
        spread = centroids[members] - np.floor_divide(centroids[members].sum(0), len(members))
        vantage = int(np.argmax(np.einsum("ij,ij->i", spread, spread)))
        rest = np.delete(members, vantage)
        distance = _squared(centroids[rest], centroids[members[vantage]])
        order = np.lexsort((rest, distance))
        half = len(rest) // 2
        tree.held.append(members[[vantage]])
        root = np.sqrt(distance[order].astype(float))
        tree.near[node] = (float(root[0]), float(root[half - 1]))
        tree.far[node] = (float(root[half]), float(root[-1]))
        todo += [(rest[order[half:]], node, 1), (rest[order[:half]], node, 0)]
    return tree


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid number, squared distance) of each vector; ties go to the smaller number."""
    which, squared = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    step = max(1, CELLS // max(1, len(tree.held)))
    for at in range(0, len(vectors), step):
        which[at:at + step], squared[at:at + step] = _search(tree, vectors[at:at + step])
    return which, squared


def _search(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bound = np.full((len(x), len(tree.held)), np.inf)
    bound[:, 0] = 0.0
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.full(len(x), len(tree.centroids))
    live = np.arange(len(x))
    while len(live):
        node = bound[live].argmin(1)
        least = bound[live, node]
        go = least <= np.sqrt(best[live].astype(float)) * (1 + _SLACK)
        live, node, least = live[go], node[go], least[go]
        order = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[order], prepend=-1))
        for part in np.split(order, cuts[1:]) if len(order) else ():
            _open(tree, int(node[part[0]]), live[part], least[part], x, bound, best, number)
        # A vector whose frontier is empty has only infinite bounds left.
        live = live[np.isfinite(bound[live].min(1))]
    return number, best


def _open(tree, i, rows, least, x, bound, best, number) -> None:
    """Vectors ``rows`` open node i: exact distances to what it holds, bounds of its children."""
    bound[rows, i] = np.inf
    first = None
    for c in tree.held[i]:
        d = _squared(x[rows], tree.centroids[c])
        first = d if first is None else first
        wins = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
        best[rows[wins]], number[rows[wins]] = d[wins], c
    for child, (low, high) in zip(tree.child[i], (tree.near[i], tree.far[i]), strict=True):
        if child >= 0:
            d = np.sqrt(first.astype(float))
            apart = np.maximum(d - high, low - d) - _SLACK * (d + high)
            bound[rows, child] = np.maximum(least, np.maximum(apart, 0.0))


@dataclass
class Clusters:
    """``assigned``: (id column, cluster, distance); ``centroids``: (cluster, centroid, size, inertia)."""

    assigned: DataFrame
    centroids: DataFrame
    inertia: int


def _start(kept: DataFrame, id_col: str, vector: str, scale: int, k: int) -> list[list[int]]:
    """The kept vectors of the ``k`` smallest hashes of their ids, in the order of the hashes."""
    h = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    rows = (kept.select(h.alias("h"), scaled(vector, scale).alias("v"))
            .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())
    return [r["v"] for r in rows]


def _sums(kept: DataFrame, vector: str, scale: int, shared) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster: number of vectors and exact sums of the components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        count = np.zeros(len(tree.centroids), np.int64)
        total = np.zeros(tree.centroids.shape, np.int64)
        for b in batches:
            _, x = matrix(b.column(0), scale, tree.centroids.shape[1], True)
            which, _ = nearest(tree, x)
            np.add.at(total, which, x)
            count += np.bincount(which, minlength=len(count))
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(count[full]),
             pa.array(total[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = kept.select(vector).mapInArrow(run, "cluster long, n long, total array<long>")
    got = (parts.select("cluster", "n", F.posexplode("total").alias("i", "x"))
           .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(got, key=lambda r: (r["cluster"], r["i"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["x"])
    return out


def cluster(rows: DataFrame, k: int, rounds: int, scale: int = 64, dim: int = 64,
            id_col: str = "vec_id", vector: str = "embedding") -> Clusters:
    """``rounds`` Lloyd rounds from ``k`` starting vectors, then one more assignment."""
    if k * dim > MOST:
        raise ValueError(f"{k} centroids of {dim} components are more than are broadcast")
    spark: SparkSession = rows.sparkSession
    kept = rows.select(id_col, vector).filter(usable(vector, scale, dim))
    now = np.array(_start(kept, id_col, vector, scale, k), np.int64).reshape(-1, dim)
    for _ in range(rounds if len(now) else 0):
        moved = now.copy()
        for c, (n, total) in _sums(kept, vector, scale,
                                   spark.sparkContext.broadcast(build(now))).items():
            moved[c] = [t // n for t in total]
        now = moved
    shared = spark.sparkContext.broadcast(build(now) if len(now) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared.value is not None:
                at, x = matrix(b.column(1), scale, dim, True)
                which, squared = nearest(shared.value, x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(which.astype(np.int32)), pa.array(squared)],
                    names=[id_col, "cluster", "distance"])

    kind = kept.schema[id_col].dataType.simpleString()
    assigned = cut_lineage(kept.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long"))
    stats = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = [(c, v, stats[c]["n"] if c in stats else 0, int(stats[c]["d"]) if c in stats else 0)
          for c, v in enumerate(now.tolist())]
    return Clusters(assigned, spark.createDataFrame(
        of, "cluster int, centroid array<long>, size long, inertia long"), sum(r[3] for r in of))
