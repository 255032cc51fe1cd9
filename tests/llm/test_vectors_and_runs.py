"""Centroid clustering, exact top-k and periodic runs against brute force and on edge cases."""

import hashlib
import math
import random
import re
import zlib

import edge
import numpy as np
import pytest
from compare import duck_rows, rows_of, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provlake.llm import centroids, periodicity, queries, topk

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, score double"


def vectors(spark, n=120, dim=64, copies=0):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, dim)], 0, 1, 2.0) for i in range(n)]
    rows += [(n + i, rows[7][1], 0, 1, 2.0) for i in range(copies)]
    bad = [None, [], [0.5] * 63, [None] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1),
           [1e30] * dim]
    rows += [(1000 + i, v, None, None, None) for i, v in enumerate(bad)]
    rows += [(None, rows[3][1], 0, 1, 2.0), rows[5], (50, [0.0] * dim, 0, 0, 0.0)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def whole(rows, scale, dim=None):
    out = []
    for r in rows:
        v = r["embedding"]
        if v is None or any(x is None or not math.isfinite(x) or abs(x * scale) >= 1 << 27 for x in v):
            continue
        if dim is None or len(v) == dim:
            out.append((r["vec_id"], [math.floor(scale * x) for x in v]))
    return out


def lloyd(rows, k, rounds):
    kept = whole(rows, 64, 64)
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for i in range(len(now)):
                own = [v for (_, v), (_, j) in zip(kept, near) if j == i]
                if own:
                    now[i] = [sum(x) // len(own) for x in zip(*own)]
    return sorted([(i, c, d) for (i, _), (d, c) in zip(kept, near)], key=repr), now


@pytest.mark.parametrize("copies", [0, 60])
def test_clusters_equal_plain_lloyd(spark, copies):
    v = vectors(spark, copies=copies)
    want, centres = lloyd(v.collect(), 16, 3)
    got = centroids.cluster(v, 16, 3)
    assert sorted(map(tuple, got.assigned.collect()), key=repr) == want
    assert [r["centroid"] for r in got.centroids.orderBy("cluster").collect()] == centres
    assert got.inertia == sum(d for _, _, d in want)


def test_clusters_of_few_or_no_vectors(spark):
    v = vectors(spark, 3)
    got = centroids.cluster(v, 16, 2)
    assert got.centroids.count() == 4 and got.assigned.filter("distance > 0").count() == 0
    none = centroids.cluster(v.limit(0), 16, 2)
    assert none.assigned.collect() == [] and none.centroids.collect() == [] and none.inertia == 0


def test_tree_equals_scan_with_ties():
    rng = np.random.default_rng(0)
    for k, spread in ((1, 3), (5, 2), (40, 2), (300, 40)):
        c = rng.integers(-spread, spread + 1, (k, 6))
        x = rng.integers(-spread, spread + 1, (500, 6))
        which, squared = centroids.nearest(centroids.build(c), x)
        full = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (which == full.argmin(1)).all() and (squared == full.min(1)).all()


def best(rows, k):
    kept = whole(rows, 256)
    out = []
    for n, (q, v) in enumerate(kept):
        if q is None or q % 10:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), i is None, i) for m, (i, w) in enumerate(kept) if m != n]
        others.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(others[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("copies,block,bins", [(0, 2048, 2048), (80, 5, 16)])
def test_top_k_equals_plain_search(spark, copies, block, bins):
    v = vectors(spark, copies=copies)
    got = topk.search(v, F.col("vec_id") % 10 == 0, block=block, bins=bins)
    assert sorted(map(tuple, got.collect()), key=repr) == best(v.collect(), 5)


def test_top_k_of_few_or_no_vectors(spark):
    v = vectors(spark, 3).filter("vec_id < 3")
    got = topk.search(v, F.col("vec_id") == 0)
    assert [r["rank"] for r in got.orderBy("rank").collect()] == [1, 2]
    assert topk.search(v.filter("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert topk.search(v.limit(0), F.col("vec_id") == 0).collect() == []


def test_top_k_with_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(64)]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(v, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == best(v.collect(), 5)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_topk"])
def test_queries_equal_their_sql(spark, name, tmp_path):
    vectors(spark, copies=40).filter("vec_id IS NULL OR vec_id <> 1006 AND vec_id <> 1001 AND vec_id <> 1002").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert spark_rows(queries.QUERIES[name](spark, str(tmp_path))) == (sorted(names), rows_of(names, cur.fetchall()))


def plain_runs(w, least, exponent):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, exponent * p) and not any(
                    all(w[x] == w[x + q] for x in range(i, i + n - q)) for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 69), st.integers(1, 12),
       st.sampled_from([(24, 3), (6, 2), (2, 2), (12, 3)]))
def test_runs_equal_plain_search(w, a, p, limits):
    w = [w[a + (i - a) % p] if i >= a and a + p <= len(w) else x for i, x in enumerate(w)]
    got = periodicity.word_runs(np.array(w, np.int64), *limits)
    assert [tuple(r) for r in got.tolist()] == plain_runs(w, *limits)
    if w:
        assert sorted(map(tuple, periodicity.tree_runs(np.array(w), *limits).tolist())) == sorted(plain_runs(w, *limits))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = plain_runs(w, 24, 3)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (sha(" ".join(x for i, x in enumerate(w) if i not in drop)), doc_id,
            1000 * top[1] // top[2] if runs else None, top[1], len(runs), top[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), top[0])


def test_run_query_equals_plain_search(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 150)))) for i in range(300)]
    rows += [(300 + i, (" ".join(rng.choice("xyz") for _ in range(1 + i % 9)) + rng.choice(["\n", "\t", "  "])) * 20)
             for i in range(60)]
    rows += [(None, "a b " * 30), (7, "a b " * 30), (400, None), (401, " \n "), (402, "é😀 " * 40), (402, "é😀 " * 40)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = spark_rows(queries.QUERIES["op13_periodicity"](spark, str(tmp_path)))[1]
    assert got == sorted([plain_row(*r) for r in rows], key=repr)


def test_runs_on_edge_cases(spark):
    d = edge.documents(spark)
    out = periodicity.runs(d, as_name="size")
    assert out.columns == [*d.columns, "size_"]
    got = {r["doc_id"]: r["size_"] for r in out.collect()}
    assert got[20]["runs"] == [] and got[20]["collapsed"] == "" == got[22]["collapsed"]
    assert [tuple(r) for r in got[23]["runs"]] == [(0, 100000, 5)]
    assert got[23]["collapsed"] == "lorem ipsum dolor sit amet"
    assert periodicity.runs(edge.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        periodicity.runs(d, exponent=1)


def test_runs_equal_oracle_tables(spark):
    """Whole texts of the smallest table: no run is lost against the plain search."""
    rows = duck_rows("SELECT doc_id, text FROM documents WHERE length(text) < 4000", "/root/testdata/sf0.001")[1]
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        index = {x: i for i, x in enumerate(dict.fromkeys(w))}
        n = [index[x] for x in w]
        assert [tuple(r) for r in periodicity.word_runs(np.array(n, np.int64)).tolist()] == plain_runs(n, 24, 3)
