"""Side-by-side check of registered queries against their oracle SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def compare(spark, name: str, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs."""
    from provlake.plans.catalog import ORACLES, QUERIES

    sc, got = spark_rows(QUERIES[name](spark, sf_dir))
    if name not in ORACLES:
        return None if got else "no rows"
    dc, want = duck_rows(ORACLES[name], sf_dir)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only oracle {lost}"
    return None if got else "both empty"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from provlake.plans.catalog import ORACLES, QUERIES
    from provlake.session import build_session

    spark = build_session("compare", "local[8]", {"spark.ui.enabled": "false",
                                                  "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    bad = 0
    for n in QUERIES:
        if wanted and not any(n.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            why = compare(spark, n, sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            why = f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += why is not None
        flag = "oracle" if n in ORACLES else "rows"
        print(f"{'ok  ' if why is None else 'FAIL'} {n} [{flag}] {time.time() - t0:.1f}s {why or ''}",
              flush=True)
    print("failed:", bad)
