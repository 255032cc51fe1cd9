"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared by cosine in double precision, which on unit vectors is a distance: cosine >=
c means a chord of at most sqrt(2 - 2c). A cover tree holds nested levels whose radii halve; every
node knows how far its points reach. Two nodes further apart than their reaches and the threshold
are pruned; two nodes that lie within it as a whole link as a whole, without looking at points.

One tree over all vectors would sit in one task, so its upper levels are built on a bounded sample
and cut into at most CELLS cells: the nodes that hold their share of the sample, and the root for
what none of them covers. Every vector goes to the nearest cell whose radius covers it. It also
visits each later cell that the cell's reach does not rule out; so each linking pair meets exactly
once. A cell of more than HOME vectors is split into shards, which
visitors (and vectors of earlier shards) visit in turn; in a cell whose reach says that all its
vectors link, they need not. In a task, a shard's vectors form one tree and its visitors, streamed,
form others.

Equal vectors are collapsed first. Vectors that are null, zero, or hold null or non-finite
components link with nothing, as do vectors of other lengths than the compared one; a null id takes
no part and keeps a null component. Rows that repeat both id and vector count as one vector.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import components
from provlake.session import cut_lineage

COSINE = 0.9
#: Vectors that the upper levels are built on, and cells they are cut into, at most.
SAMPLE, CELLS = 4096, 256
#: Vectors of a shard, and visitors compared with them at once.
HOME = 4096
LEAF = 64
#: Room for rounding in bounds; closer cases are decided on the vectors themselves.
SLACK = 1e-9


class CoverTree:
    """Nested levels over unit vectors; ``nodes`` hold (centre, reach, children, points, radius)."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, merge: bool = True):
        self.unit, self.leaf, self.merge = unit, leaf, merge
        self.nodes: list[tuple[int, float, list[int], np.ndarray, float]] = []
        self.root = self._build(np.arange(len(unit)), 0, 2.0) if len(unit) else None

    def _far(self, centre: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[points] @ self.unit[centre])))

    def _build(self, points: np.ndarray, centre: int, radius: float) -> int:
        far = self._far(centre, points)
        reach, level = float(far.max()), radius
        below: list[tuple[int, np.ndarray]] = []
        if len(points) > self.leaf and reach > SLACK:
            while radius / 2 >= reach:  # levels that hold the centre alone
                radius /= 2
            # The centre stays a centre of the next level; others cover what it does not.
            rest, at = points, centre
            while len(rest):
                near = far <= radius / 2
                below.append((at, rest[near]))
                rest = rest[~near]
                if len(rest):
                    if self.merge and len(below) > max(8, len(points) // 8):
                        below = []  # halving separates nearly all points: keep them together
                        break
                    at = int(rest[0])
                    far = self._far(at, rest)
        children = [self._build(p, c, radius / 2) for c, p in below] if len(below) > 1 else []
        self.nodes.append((centre, reach, children, points, level))
        return len(self.nodes) - 1

    def cut(self, cells: int) -> list[tuple[int, float]]:
        """(centre, radius) of at most ``cells`` nodes that hold their share of the points or more,
        the fullest first; the root, with any radius, leads and covers all other points."""
        if self.root is None:
            return []
        share = max(2, len(self.unit) // cells)
        found = [(self.nodes[self.root][0], np.inf)]
        open_ = [(-len(self.unit), self.root)]
        while open_ and len(found) < cells:
            size, i = heapq.heappop(open_)
            centre, _, below, _, radius = self.nodes[i]
            if i != self.root:
                found.append((centre, radius))
            for j in below:
                if len(self.nodes[j][3]) >= share:
                    heapq.heappush(open_, (-len(self.nodes[j][3]), j))
        return found


class Pairs:
    """Link counts and components of a group: homes first, then one chunk of visitors."""

    def __init__(self, chord: float, cosine: float):
        self.chord, self.cosine = chord, cosine

    def start(self, raw: np.ndarray, weight: np.ndarray) -> None:
        self.raw, self.weight = raw, weight
        self.unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
        self.count = np.zeros(len(raw), np.int64)
        self.label = np.arange(len(raw))

    def join(self, points: np.ndarray) -> None:
        labels = np.unique(self.label[points])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def _exact(self, i: int, j: int) -> bool:
        a, b = self.raw[i], self.raw[j]
        dot, aa, bb = (math.fsum(x * y) for x, y in ((a, b), (a, a), (b, b)))
        return dot / math.sqrt(aa * bb) >= self.cosine

    def _blocks(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for at in range(0, len(a), 1024):
            rows = a[at:at + 1024]
            cos = self.unit[rows] @ self.unit[b].T
            link = cos >= self.cosine
            for i, j in zip(*np.nonzero(np.abs(cos - self.cosine) < 1e-12), strict=True):
                link[i, j] = self._exact(rows[i], b[j])
            if same:
                link[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
            if not link.any():
                continue
            self.count[rows] += link @ self.weight[b]
            if not same:
                self.count[b] += self.weight[rows] @ link
            for i in np.flatnonzero(link.any(1)):
                self.join(np.append(b[link[i]], rows[i]))

    def within(self, tree: CoverTree, offset: int) -> None:
        stack = [tree.root] if tree.root is not None else []
        while stack:
            _, reach, below, points, _ = tree.nodes[stack.pop()]
            points = points + offset
            if 2 * reach <= self.chord - SLACK:
                self.count[points] += self.weight[points].sum() - self.weight[points]
                self.join(points)
            elif not below:
                self._blocks(points, points, True)
            else:
                stack += below
                for k, i in enumerate(below):
                    for j in below[k + 1:]:
                        self.between(tree, i, offset, tree, j, offset)

    def between(self, t1: CoverTree, i: int, o1: int, t2: CoverTree, j: int, o2: int) -> None:
        stack = [(i, j)]
        while stack:
            i, j = stack.pop()
            c1, r1, below1, p1, _ = t1.nodes[i]
            c2, r2, below2, p2, _ = t2.nodes[j]
            d = math.sqrt(max(0.0, 2 - 2 * float(t1.unit[c1] @ t2.unit[c2])))
            if d - r1 - r2 > self.chord + SLACK:
                continue
            if d + r1 + r2 <= self.chord - SLACK:
                a, b = p1 + o1, p2 + o2
                self.count[a] += self.weight[b].sum()
                self.count[b] += self.weight[a].sum()
                self.join(np.concatenate([a, b]))
            elif not below1 and not below2:
                self._blocks(p1 + o1, p2 + o2, False)
            elif not below2 or (below1 and r1 >= r2):
                stack += [(k, j) for k in below1]
            else:
                stack += [(i, k) for k in below2]


def _valid(vector: list | None) -> bytes | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    # Scaling by a power of two is exact and keeps squares in range; it does not change cosines.
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    return np.ldexp(v, -int(np.frexp(top)[1])).tobytes()


def cleaned(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec): the components as doubles in bytes, null where the vector links with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_valid(v) for v in b.column(1).to_pylist()], pa.binary())],
                schema=schema)

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector)).mapInArrow(
        run, "vec_id long, vec binary")


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def _dealt(reps: DataFrame, centres: dict[int, tuple[np.ndarray, np.ndarray]], cells: dict | None,
           chord: float) -> DataFrame:
    """Without ``cells``: (length, cell, far, rep, m) of each vector. With them: a row for each shard
    that a vector lives in or visits."""
    sc = reps.sparkSession.sparkContext
    shared = sc.broadcast((centres, cells))
    plain = "length int, cell int, far double, rep long, m long"
    full = "length int, cell int, shard int, visitor boolean, rep long, m long, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                rep, m, vec = (b.column(c).to_pylist() for c in range(3))
                length = np.array([len(v) // 8 for v in vec])
                for n in np.unique(length):
                    rows = np.flatnonzero(length == n)
                    raw = _matrix([vec[i] for i in rows])
                    unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
                    # A length that the sample lacks is one cell.
                    c, radius = centre.get(int(n)) or (np.eye(1, n), np.array([np.inf]))
                    far = np.sqrt(np.maximum(0.0, 2 - 2 * unit @ c.T))
                    # The root's cell, the first, is for what no other cell covers.
                    inside = np.where(far <= radius[None, :], far, np.inf)
                    inside[:, 0] = 1e9
                    home = inside.argmin(1)
                    own = far[np.arange(len(rows)), home]
                    if known is None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), n, np.int32)),
                             pa.array(home.astype(np.int32)), pa.array(own),
                             pa.array([rep[i] for i in rows], pa.int64()),
                             pa.array([m[i] for i in rows], pa.int64())],
                            names=["length", "cell", "far", "rep", "m"])
                        continue
                    reach, shards, tight = known[int(n)][:3]
                    goes = far <= reach[None, :] + chord + SLACK
                    goes &= np.arange(len(c))[None, :] > home[:, None]
                    out: list[tuple] = []
                    for k, i in enumerate(rows):
                        h = int(home[k])
                        mine = rep[i] * 2654435761 % (1 << 32) * int(shards[h]) >> 32
                        later = range(mine + 1, int(shards[h])) if not tight[h] else ()
                        to = [(h, mine, False), *((h, s, True) for s in later)]
                        to += [(int(j), s, True) for j in np.flatnonzero(goes[k])
                               for s in range(int(shards[j]))]
                        out += [(int(n), *t, rep[i], m[i], vec[i]) for t in to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[x] for o in out], t) for x, t in enumerate(
                            (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(),
                             pa.binary()))],
                        names=["length", "cell", "shard", "visitor", "rep", "m", "vec"])

    return reps.select("rep", "m", "vec").mapInArrow(run, plain if cells is None else full)


def _compared(dealt: DataFrame, cells: dict, chord: float, cosine: float,
              home: int) -> DataFrame:
    """(a, b, n): n direct links found for vector a, or (b not null) a and b are connected.

    In a tight cell all vectors link, in whatever shards: a vector's links there are the cell's
    weight less its own, and all are connected with the cell's smallest id.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, guests = None, [], []
        tree, pairs, total, label = None, Pairs(chord, cosine), None, None

        def settle() -> None:
            """Build the home tree once all homes have come."""
            nonlocal tree, total, label
            if tree is None and homes:
                pairs.start(_matrix([h[2] for h in homes]), np.array([h[1] for h in homes]))
                tree = CoverTree(pairs.unit)
                _, _, tight, weight, _ = shared.value[now[0]]
                if tight[now[1]]:
                    pairs.count[:] = weight[now[1]] - pairs.weight
                    pairs.label[:] = 0
                else:
                    pairs.within(tree, 0)
                total, label = pairs.count, pairs.label

        def visit() -> list[tuple]:
            """Compare the gathered visitors; returns their counts and connections."""
            nonlocal guests, total, label
            if not guests or not homes:
                guests = []
                return []
            settle()
            n = len(homes)
            pairs.start(_matrix([g[2] for g in homes + guests]),
                        np.array([g[1] for g in homes + guests]))
            pairs.label[:n] = label
            there = CoverTree(pairs.unit[n:])
            pairs.between(tree, tree.root, 0, there, there.root, n)
            total, label = total + pairs.count[:n], pairs.label[:n].copy()
            linked = np.flatnonzero(pairs.count[n:])
            first: dict[int, int] = {}
            for i, x in enumerate(label):
                first.setdefault(int(x), i)
            out = []
            for k in linked:
                # A linked visitor is connected with a home, which carries the same label.
                out += [(guests[k][0], None, int(pairs.count[n + k])),
                        (guests[k][0], homes[first[int(pairs.label[n + k])]][0], 0)]
            guests = []
            return out

        def close() -> list[tuple]:
            out = visit()
            settle()
            if homes:
                out += [(h[0], None, int(k)) for h, k in zip(homes, total, strict=True) if k]
                first = {}
                _, _, tight, _, lead = shared.value[now[0]]
                if tight[now[1]]:
                    out.append((homes[0][0], int(lead[now[1]]), 0))
                for i, x in enumerate(label):
                    j = first.setdefault(int(x), i)
                    if j != i:
                        out.append((homes[i][0], homes[j][0], 0))
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)

        for b in batches:
            found = []
            length, cell, shard, visitor, rep, m, vec = (b.column(c).to_pylist() for c in range(7))
            for k in range(b.num_rows):
                if (length[k], cell[k], shard[k]) != now:
                    found += close()
                    now, homes, guests, tree = (length[k], cell[k], shard[k]), [], [], None
                (guests if visitor[k] else homes).append((rep[k], m[k], vec[k]))
                if len(guests) >= home:
                    found += visit()
            yield batch_of(found)
        yield batch_of(close())

    return (dealt.repartition("length", "cell", "shard")
            .sortWithinPartitions("length", "cell", "shard", "visitor", "rep")
            .mapInArrow(run, "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id",
                    vector: str = "embedding", home: int = HOME, sample_size: int = SAMPLE,
                    most_cells: int = CELLS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    about = cut_lineage(cleaned(vectors, key, vector))
    reps = cut_lineage(about.filter("vec IS NOT NULL AND vec_id IS NOT NULL").distinct()
                       .groupBy("vec").agg(F.min("vec_id").alias("rep"),
                                           F.count(F.lit(1)).alias("m")))
    sample: dict[int, list[bytes]] = {}
    for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(sample_size).select("vec").collect():
        sample.setdefault(len(r[0]) // 8, []).append(bytes(r[0]))
    centres = {}
    for n, vecs in sample.items():
        raw = _matrix(vecs)
        unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
        at, radius = zip(*CoverTree(unit, leaf=8, merge=False).cut(most_cells), strict=True)
        centres[n] = (unit[list(at)], np.array(radius))
    found = _dealt(reps, centres, None, chord).groupBy("length", "cell").agg(
        F.max("far"), F.count(F.lit(1)), F.sum("m"), F.min("rep")).collect()
    cells: dict[int, tuple] = {}
    for n in {r[0] for r in found}:
        k = len(centres[n][1]) if n in centres else 1
        reach, (count, weight, lead) = np.full(k, -np.inf), np.zeros((3, k), np.int64)
        for length, cell, far, rows, m, least in found:
            if length == n:
                reach[cell], count[cell], weight[cell], lead[cell] = far, rows, m, least
        cells[n] = (reach, np.maximum(1, -(-count // home)), 2 * reach <= chord - SLACK, weight, lead)
    out = cut_lineage(_compared(_dealt(reps, centres, cells, chord), cells, chord, cosine, home))
    counts = out.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = components(out.filter("b IS NOT NULL").select("a", "b"))
    per = (reps.join(counts, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
           .select("vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                   F.coalesce("component", "rep").alias("component")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return about.join(cut_lineage(per), "vec", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
        .cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))
