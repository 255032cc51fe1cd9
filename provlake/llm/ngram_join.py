"""N-gram Jaccard join by R-trees over count vectors.

A document is its set of distinct word shingles. Two documents link when 100 * intersection >=
``percent`` * union. Equal sets are collapsed to their smallest id first.

Finding who meets: all shingles are put in one order (rare ones first, then by hash). A set of n
that links with another shares one of its first n - ceil(percent * n / 100) + 1 shingles with it,
so sets that share such a key meet, and no link is lost. How rare a shingle is comes from counts
over all documents in 2^20 buckets; being only an order, it needs no exactness. Keys of frequent
buckets, whose documents may be many, are grouped by partial aggregation and a join that Spark
can split; the others by one sort.

Deciding who links: the documents that meet under one leader are points in an R-tree. A shingle's
hash puts it into one of GROUPS groups, and the counts of the groups are a document's coordinates.
The intersection of two sets is at most the sum of the smaller coordinates; for two boxes, of the
smaller upper corners. Node pairs and then document pairs that cannot reach the threshold are
pruned. This is done twice: on count vectors alone, to leave only documents with a partner, and
with their texts, where surviving pairs are verified on the full sets, closest first, skipping
pairs that are already in one component. More than SHARD documents under one leader are split into shards and compared
shard pair by shard pair.

Null texts and texts without words have an empty set and link with nothing, not even each other.
Repeated rows have equal sets and so link; rows with one id are one document to its links. Null ids take part under no id and are left out of the
links: their component is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import components, fresh, lean
from provlake.llm.shingles import shingle_sets
from provlake.session import cut_lineage

WIDTH, PERCENT = 4, 85
BUCKET_BITS = 20
GROUPS = 256
LEAF = 16
SHARD = 512
#: Bits of the map that tells which texts are wanted.
BITMAP_BITS = 26


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), "text")


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, digest) of every document: size and digest of its set, digest null if empty;
    and (bucket, n) rows: the shingle buckets that stand out in the counts of a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("bucket", pa.int64())])

    def batch(doc_id, n, digest, bucket) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((doc_id, n, digest, bucket), schema, strict=True)],
            schema=schema)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, digest = [], []
                for s in shingle_sets(part.column(1).to_pylist(), width):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                                  if len(s) else None)
                    np.add.at(count, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
                yield batch(part.column(0), n, digest, [None] * len(n))
        hot = np.flatnonzero(count >= max(8, 6 * count.mean()))
        yield batch([None] * len(hot), count[hot], [None] * len(hot), hot)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, digest binary, bucket long")


def heat(about: DataFrame) -> np.ndarray:
    """How frequent the shingles of each bucket are: 0, or the logarithm of the count.

    Every document is counted; the rows that reach the driver are at most the 2^20 buckets.
    """
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for bucket, n in about.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = int(n).bit_length()
    return out


def _keys(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, n, rep, hot): the key shingles of each document; hot ones lie in frequent buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["key", "n", "rep", "hot"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heat_of = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                keys, frequent, size = [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), width):
                    h = heat_of[s >> np.uint64(64 - BUCKET_BITS)]
                    first = np.argsort(h, kind="stable")[:prefix_length(len(s), percent)]
                    keys.append(s[first].view(np.int64))
                    frequent.append(h[first] > 0)
                    size.append(len(s))
                count = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(size, count)),
                     pa.array(np.repeat(ids, count)), pa.array(np.concatenate(frequent))],
                    names=names)

    return docs.select("rep", "text").mapInArrow(run, "key long, n long, rep long, hot boolean")


def _counts(docs: DataFrame, width: int) -> DataFrame:
    """(rep, counts): the count vectors of documents (rep, text)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [c.astype(np.uint16 if c.max() < 1 << 16 else np.uint32).tobytes()
                     for c in points(sets)], pa.binary())], names=["rep", "counts"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, counts binary")


def _met_cold(keys: DataFrame, percent: int) -> DataFrame:
    """(leader, rep) of rows (key, n, rep): under each key, runs of compatible sizes of two or more
    sets, led by their first. Rows are sorted and streamed."""
    schema = pa.schema([("leader", pa.int64()), ("rep", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, n, leader, whether the leader has been told) of the row before
        for b in batches:
            key, n, rep = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
            joins = last is not None and key[0] == last[0] and 100 * last[1] >= percent * n[0]
            new[0] = not joins
            run_of = np.cumsum(new) - 1
            leader = rep[np.flatnonzero(new)][run_of] if new[0] else np.concatenate(
                [[last[2]], rep[np.flatnonzero(new)]])[run_of + 1]
            alone = new & np.append(new[1:], True)
            # A run that ends the batch alone may go on in the next one.
            pairs = [np.stack([leader[~alone], rep[~alone]], 1)]
            if joins and not last[3]:
                pairs.append(np.array([[last[2], last[2]]]))
            told = not alone[-1]
            last = (key[-1], n[-1], leader[-1], told)
            found = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])],
                                             schema=schema)

    return (keys.select("key", "n", "rep").repartition("key")
            .sortWithinPartitions("key", "n", "rep").mapInArrow(run, "leader long, rep long"))


def _met_hot(keys: DataFrame) -> DataFrame:
    """(leader, rep) under frequent keys: the leader is a minimum taken with partial aggregation."""
    lead = cut_lineage(keys.groupBy("key").agg(F.min("rep").alias("leader"),
                                               F.count(F.lit(1)).alias("m"))
                       .filter("m > 1").select("key", "leader"))
    return keys.join(lead, "key").select("leader", "rep")


class Tree:
    """An R-tree over count vectors, packed by splitting at medians of the widest coordinate."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.points, self.size = points, size
        self.nodes: list[tuple] = []  # upper corner, smallest and largest size, children, rows
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        p, s = self.points[rows], self.size[rows]
        below = None
        if len(rows) > LEAF:
            spread = p.max(0) - p.min(0)
            if s.max() - s.min() >= spread.max():
                order = np.argsort(s, kind="stable")
            else:
                order = np.argsort(p[:, spread.argmax()], kind="stable")
            half = len(rows) // 2
            below = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        self.nodes.append((p.max(0), s.min(), s.max(), below, rows))
        return len(self.nodes) - 1

    def pairs(self, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """(rows, rows, bound) that may link; of different ``side`` where sides are given."""
        stack = [(self.root, self.root)]
        while stack:
            i, j = stack.pop()
            up1, lo1, hi1, below1, rows1 = self.nodes[i]
            up2, lo2, hi2, below2, rows2 = self.nodes[j]
            if 100 * min(hi1, hi2) < percent * max(lo1, lo2):
                continue
            if np.minimum(up1, up2).sum() * (100 + percent) < percent * (lo1 + lo2):
                continue
            if below1 is None and below2 is None:
                a, b = np.repeat(rows1, len(rows2)), np.tile(rows2, len(rows1))
                ok = a < b if i == j else np.ones(len(a), bool)
                if side is not None:
                    ok &= side[a] != side[b]
                a, b = a[ok], b[ok]
                bound = np.minimum(self.points[a], self.points[b]).sum(1)
                ok = bound * (100 + percent) >= percent * (self.size[a] + self.size[b])
                if ok.any():
                    yield a[ok], b[ok], bound[ok] / (self.size[a] + self.size[b])[ok]
            elif i == j:
                stack += [(below1[0], below1[0]), (below1[1], below1[1]), (below1[0], below1[1])]
            elif below2 is None or (below1 is not None and len(rows1) >= len(rows2)):
                stack += [(below1[0], j), (below1[1], j)]
            else:
                stack += [(i, below2[0]), (i, below2[1])]


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors: how many shingles of each set fall into each group."""
    return np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                     for s in sets])


def links(sets: list[np.ndarray], percent: int = PERCENT,
          side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linking pairs that hold the sets' components together (of different sides, where given)."""
    size = np.array([len(s) for s in sets], np.int64)
    found = list(Tree(points(sets), size).pairs(percent, side))
    if not found:
        return []
    a, b, bound = (np.concatenate(c) for c in zip(*found, strict=True))
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for k in np.argsort(-bound, kind="stable"):
        i, j = int(a[k]), int(b[k])
        if top(i) == top(j):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[top(i)] = top(j)
            out.append((i, j))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], decode) -> Iterator[tuple]:
    """((leader, x, y), ids, shards, decoded values) of rows sorted by leader, x, y and id; the
    columns are leader, x, y, own, rep and the value. Repeated rows count once."""
    now, ids, own, values = None, [], [], []
    for b in batches:
        leader, x, y, mine, rep = (b.column(c).to_pylist() for c in range(5))
        for at in range(0, b.num_rows, 500):
            for k, v in enumerate(decode(b.column(5).slice(at, 500).to_pylist()), at):
                if (leader[k], x[k], y[k]) != now:
                    if len(ids) > 1:
                        yield now, ids, np.array(own), values
                    now, ids, own, values = (leader[k], x[k], y[k]), [], [], []
                if not ids or rep[k] != ids[-1] or not np.array_equal(v, values[-1]):
                    ids.append(rep[k])
                    own.append(mine[k])
                    values.append(v)
    if len(ids) > 1:
        yield now, ids, np.array(own), values


def _sorted_groups(rows: DataFrame) -> DataFrame:
    return (rows.repartition("leader", "x", "y")
            .sortWithinPartitions("leader", "x", "y", "rep"))


def _candidates(met: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(leader, x, y, own, rep) of the documents that the R-tree of their leader's shards x and y
    leaves with a partner. Only count vectors are moved here; ``met`` holds distinct pairs."""
    parts = met.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).select(
        "leader", F.ceil(F.col("m") / SHARD).cast("int").alias("parts"))
    own = F.when(F.col("parts") == 1, F.lit(0)).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = (met.join(cut_lineage(parts), "leader").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("leader", F.least("own", "other").alias("x"),
                    F.greatest("own", "other").alias("y"), "own", "rep"))
    counts = _counts(_among(texts, met, "rep"), width)
    ready = _sorted_groups(rows.join(counts, "rep").select(
        "leader", "x", "y", "own", "rep", "counts"))
    names = ["leader", "x", "y", "own", "rep"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = lambda values: (np.frombuffer(
            v, np.uint16 if len(v) == 2 * GROUPS else np.uint32).astype(np.int64) for v in values)
        for key, ids, own, found in _grouped(batches, vectors):
            p = np.stack(found)
            keep = np.zeros(len(ids), bool)
            for i, j, _ in Tree(p, p.sum(1)).pairs(percent, None if key[1] == key[2] else own):
                keep[i] = keep[j] = True
            if keep.any():
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()),
                     pa.array([key[2]] * n, pa.int32()), pa.array(own[keep], pa.int32()),
                     pa.array(np.array(ids)[keep], pa.int64())], names=names)

    return ready.mapInArrow(run, "leader long, x int, y int, own int, rep long")


def _among(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` without most rows whose ``key`` is not in ``ids``, where they lie.

    The hashed ids are gathered into a bitmap of 2^BITMAP_BITS bits, whatever their number, which
    is broadcast; it keeps every row that is in ``ids`` and some that are not.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    made = ids.select(h(F.col(key)).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    # Buckets are numbered from 1 and hold the values that share their quotient.
    per = 8 * 4096
    bitmap = np.zeros(((1 << BITMAP_BITS) // per + 2, 4096), np.uint8)
    for b, bits in made:
        bitmap[b] = np.frombuffer(bytes(bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def has(bucket: pd.Series, at: pd.Series) -> pd.Series:
        b, p = bucket.to_numpy(np.int64), at.to_numpy(np.int64)
        return pd.Series((shared.value[b, p >> 3] >> (p & 7)) & 1 == 1)

    hashed = h(F.col(key))
    return docs.filter(F.col(key).isNotNull()).filter(
        has(F.bitmap_bucket_number(hashed), F.bitmap_bit_position(hashed)))


def _verified(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among candidates, decided on the full sets of their whole texts."""
    ready = _sorted_groups(rows.join(_among(texts, rows, "rep"), "rep").select(
        "leader", "x", "y", "own", "rep", "text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, own, sets in _grouped(batches, lambda texts: shingle_sets(texts, width)):
            found = links(sets, percent, None if key[1] == key[2] else own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[f[i]] for f in found], pa.int64()) for i in (0, 1)],
                names=["a", "b"])

    return ready.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    docs = _texts(docs)
    both = cut_lineage(described(docs, width))
    about = both.filter("bucket IS NULL")
    sets = cut_lineage(about.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep")))
    texts = docs.filter("text IS NOT NULL").withColumnRenamed("doc_id", "rep")
    # A copy that the bitmap lets through meets its smallest copy again and links with it.
    keys = _keys(_among(texts, sets, "rep"), heat(both), width, percent)
    met = cut_lineage(_met_cold(keys.filter("NOT hot"), percent).unionByName(
        _met_hot(cut_lineage(keys.filter("hot")))).distinct())
    near = cut_lineage(_candidates(met, texts, width, percent))
    found = components(_verified(near, texts, width, percent))
    named = sets.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    return about.select("doc_id", "n", "digest").join(cut_lineage(named), "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id.

    Rows that repeat an id are reduced to one of each text. Documents without words and null ids
    all stay. Only the ids of rows that go or repeat are joined with the documents.
    """
    found = classes(docs, width, percent)
    gone, twice = fresh("_gone", docs.columns), fresh("_twice", docs.columns)
    cut = cut_lineage(found.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(
        F.min(F.col("component_id") != F.col("doc_id")).alias(gone),
        (F.count(F.lit(1)) > 1).alias(twice)).filter(f"{gone} OR {twice}"))
    rest = docs.join(cut, "doc_id", "left").filter(f"NOT coalesce({gone}, false)").select(
        *docs.columns, twice)
    single = rest.filter(f"NOT coalesce({twice}, false)").select(*docs.columns)
    if cut.filter(twice).isEmpty():
        return single
    return single.unionByName(
        rest.filter(twice).select(*docs.columns).dropDuplicates(["doc_id", "text"]))
