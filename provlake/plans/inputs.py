"""Inputs the registered queries share, and the SQL that spells the same thing for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake import vocab
from provlake.operators import artifacts, taint
from provlake.sources.tables import view

_REFS = taint.REF


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised records of all calls (one per event)."""
    c = artifacts.classify(view(spark, sf, "fx_call"))
    null = F.lit(None).cast("string")
    own = F.struct("artifact_id", "path", null.alias("digest"), "labels")
    out = F.struct(F.col("out_id").alias("artifact_id"), F.col("out_path").alias("path"),
                   null.alias("digest"), F.array(F.lit("public")).alias("labels"))
    none = F.array().cast(_REFS)
    op = F.col("op")
    return c.select(
        "ledger_id", "session_id", "seq", "op", "outcome", "action_id", F.col("at_iso").alias("at"), "k", "tool",
        "artifact_id",
        F.when(op.isin("artifact.read", "artifact.derive", "artifact.egress", "tool.result"),
               F.array(own)).otherwise(none).cast(_REFS).alias("used"),
        F.when(op == "artifact.write", F.array(own)).when(op == "artifact.derive", F.array(out))
        .otherwise(none).cast(_REFS).alias("generated"),
        F.when(op == "artifact.derive", F.array(F.struct(
            F.col("out_id").alias("generated"), F.col("artifact_id").alias("source"),
            F.concat(F.lit("Write:"), "out_path").alias("via")))
        ).otherwise(F.array().cast(taint.DERIVED)).cast(taint.DERIVED).alias("derived_from"),
        F.when(op == "custody.declassify", F.col("artifact_id")).alias("declassified"))


# ── the same in DuckDB ──────────────────────────────────────────────────────────────────────
def _sql_str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def duck_match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_sql_str(pattern)}, 'i')"


def duck_rank(x: str) -> str:
    """Rank of the path's own labels."""
    def any_of(rank: str) -> str:
        return " OR ".join(duck_match(x, r.pattern) for r in vocab.classify_rules()
                           if rank in r.labels)
    return (f"CASE WHEN {any_of('restricted')} THEN 3 WHEN {any_of('confidential')} THEN 2 "
            f"WHEN {any_of('internal')} THEN 1 ELSE 0 END")


def duck_flags(x: str) -> str:
    parts = []
    for f in sorted(vocab.FLAGS):
        hits = [duck_match(x, r.pattern) for r in vocab.classify_rules() if f in r.labels]
        if hits:
            parts.append(f"CASE WHEN {' OR '.join(hits)} THEN '{f}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def duck_labels(rank: str, flags: str) -> str:
    """Comma-joined sorted label set."""
    return (f"array_to_string(list_sort(list_distinct(list_concat(['public', 'internal', "
            f"'confidential', 'restricted'][{rank} + 1 : {rank} + 1], {flags}))), ',')")


#: Rank, flags and label text per distinct path.
DUCK_PATHS = f"""fx_path AS (
    SELECT path, rnk, flags, {duck_labels('rnk', 'flags')} AS labels FROM (
        SELECT path, {duck_rank('path')} AS rnk, {duck_flags('path')} AS flags
        FROM (SELECT DISTINCT path FROM fx_call)))"""

#: Effected records and their touches (session, seq, artifact, rank, flags).
DUCK_EFFECTS = DUCK_PATHS + """, fx_first AS (
    SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY session_id, op, action_id, CASE WHEN action_id IS NULL THEN seq END
        ORDER BY seq) AS rn FROM fx_call) WHERE rn = 1),
fx_effect AS (SELECT * FROM fx_first WHERE outcome <> 'deny'),
fx_touch AS (
    SELECT e.session_id, e.seq, CASE WHEN op = 'artifact.derive' THEN out_id ELSE artifact_id END
        AS artifact_id, CASE WHEN op = 'artifact.derive' THEN out_path ELSE e.path END AS path,
        rnk, flags, (rnk >= 2 OR len(flags) > 0) AS classified
    FROM fx_effect e JOIN fx_path p ON p.path = e.path
    WHERE op IN ('artifact.read', 'artifact.write', 'artifact.derive', 'artifact.egress',
                 'tool.result'))"""

#: What each call sees: a touch is held until its artifact is touched again or dropped; its labels
#: count since the last drop, or from before it where the touch was then still held.
DUCK_RUNNING = DUCK_EFFECTS + """,
fx_drop AS (SELECT session_id, seq, artifact_id FROM fx_effect WHERE op = 'custody.declassify'),
fx_span AS (
    SELECT t.*, lead(seq) OVER (PARTITION BY session_id, artifact_id, classified ORDER BY seq)
            AS next_touch,
        (SELECT min(d.seq) FROM fx_drop d WHERE d.session_id = t.session_id
            AND d.artifact_id = t.artifact_id AND d.seq > t.seq) AS dropped
    FROM fx_touch t),
fx_asked AS (
    SELECT session_id, seq, artifact_id, (SELECT max(d.seq) FROM fx_drop d
        WHERE d.session_id = c.session_id AND d.seq < c.seq) AS last_drop FROM fx_call c),
fx_seen AS (
    SELECT session_id, seq, max(rnk) FILTER (visible) AS rnk,
        coalesce(flatten(list(flags) FILTER (visible)), []) AS flags,
        count(*) FILTER (held) AS depth, bool_or(held AND artifact_id = asked) AS has
    FROM (SELECT c.session_id, c.seq, c.artifact_id AS asked, t.artifact_id, t.rnk, t.flags,
            t.classified AND coalesce(t.next_touch >= c.seq, true)
                AND coalesce(t.dropped >= c.seq, true) AS held,
            t.seq > coalesce(c.last_drop, -1) OR t.classified
                AND coalesce(t.next_touch > c.last_drop, true)
                AND coalesce(t.dropped > c.last_drop, true) AS visible
        FROM fx_asked c JOIN fx_span t ON t.session_id = c.session_id AND t.seq < c.seq)
    GROUP BY session_id, seq)"""
