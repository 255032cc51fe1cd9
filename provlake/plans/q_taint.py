"""Registered queries: session taint state."""

from pyspark.sql import functions as F

from provlake.functions import labels as L
from provlake.operators import taint as T
from provlake.plans import inputs as I
from provlake.plans.registry import query
from provlake.sources.tables import duck, view

_EFF = I.DUCK_EFFECTS


@query("t_03_effects", duck(["fx_call"], """
    SELECT session_id, seq, op, outcome, action_id FROM fx_effect""", _EFF))
def effects(spark, sf):
    return T.select_effects(I.records(spark, sf)).select(
        "session_id", "seq", "op", "outcome", "action_id")


#: Session state with declassification, spelled with correlated joins instead of aggregates.
_STATE = _EFF + """,
fx_mark AS (
    SELECT session_id,
        max(CASE WHEN outcome <> 'deny' AND op = 'custody.declassify' THEN seq END) AS d,
        max(CASE WHEN outcome <> 'deny' AND op = 'artifact.egress' THEN seq END) AS e,
        count(*) FILTER (outcome <> 'deny' AND op = 'custody.checkpoint') AS gen
    FROM fx_first GROUP BY session_id),
fx_drop AS (
    SELECT session_id, artifact_id, max(seq) AS da FROM fx_effect
    WHERE op = 'custody.declassify' GROUP BY session_id, artifact_id),
fx_placed AS (
    SELECT t.*, m.d, m.e, x.da FROM fx_touch t JOIN fx_mark m ON m.session_id = t.session_id
    LEFT JOIN fx_drop x ON x.session_id = t.session_id AND x.artifact_id = t.artifact_id),
fx_source AS (
    SELECT session_id, artifact_id, path, rnk, flags FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, artifact_id ORDER BY seq DESC) AS rn
        FROM fx_placed WHERE classified AND (da IS NULL OR seq > da)) WHERE rn = 1),
fx_contrib AS (
    SELECT session_id, rnk, flags FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, artifact_id ORDER BY seq DESC) AS rn
        FROM fx_placed WHERE classified AND seq <= d AND (da IS NULL OR seq > da)) WHERE rn = 1
    UNION ALL
    SELECT session_id, rnk, flags FROM fx_placed WHERE d IS NULL OR seq > d)"""


@query("t_04_rollup", duck(["fx_call"], f"""
    SELECT m.session_id, m.gen AS compaction_generation,
        coalesce(l.labels, 'public') AS labels,
        coalesce(s.depth, 0) AS depth, coalesce(s.restricted, 0) AS restricted_touched,
        coalesce(t.touched, 0) AS touched, coalesce(t.since, 0) AS since_last_egress
    FROM fx_mark m
    LEFT JOIN (SELECT session_id, {I.duck_labels('max(rnk)', 'flatten(list(flags))')} AS labels
               FROM fx_contrib GROUP BY session_id) l ON l.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(*) AS depth, count(*) FILTER (rnk = 3) AS restricted
               FROM fx_source GROUP BY session_id) s ON s.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(*) AS touched,
                   count(*) FILTER (e IS NULL OR seq > e) AS since
               FROM fx_placed GROUP BY session_id) t ON t.session_id = m.session_id""", _STATE))
def rollup(spark, sf):
    return T.rollup(I.records(spark, sf)).drop("summary").withColumn(
        "labels", L.text(F.col("labels")))


@query("t_04_sources", duck(["fx_call"], f"""
    SELECT session_id, artifact_id, path, {I.duck_labels('rnk', 'flags')} AS labels
    FROM fx_source""", _STATE))
def sources(spark, sf):
    return T.sources(I.records(spark, sf)).select(
        "session_id", "artifact_id", "path", L.text(F.col("labels")).alias("labels"))


@query("t_04_edges", duck(["fx_call"], """
    SELECT session_id, seq, out_id AS output_id, artifact_id AS input_id,
        concat('Write:', out_path) AS via FROM fx_effect WHERE op = 'artifact.derive'""", _EFF))
def edges(spark, sf):
    return T.edges(T.select_effects(I.records(spark, sf)))


@query("t_05_measures", duck(["fx_call"], f"""
    SELECT m.session_id, coalesce(s.depth, 0) AS depth,
        coalesce(s.restricted, 0) AS restricted_touched,
        concat('session ', m.session_id, ': ', coalesce(l.d, 'public'), ' from ',
            coalesce(s.depth, 0), ' classified artifact(s), ', coalesce(t.touched, 0), ' touch(es)')
            AS summary
    FROM fx_mark m
    LEFT JOIN (SELECT session_id, array_to_string(list_concat(
                   [['public', 'internal', 'confidential', 'restricted'][max(rnk) + 1]],
                   list_sort(list_distinct(flatten(list(flags))))), ',') AS d
               FROM fx_contrib GROUP BY session_id) l ON l.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(*) AS depth, count(*) FILTER (rnk = 3) AS restricted
               FROM fx_source GROUP BY session_id) s ON s.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(*) AS touched FROM fx_placed GROUP BY session_id) t
        ON t.session_id = m.session_id""", _STATE))
def measures(spark, sf):
    return T.rollup(I.records(spark, sf)).select(
        "session_id", "depth", "restricted_touched", "summary")


@query("t_06_running_state", duck(["fx_call"], f"""
    SELECT c.session_id, c.seq,
        {I.duck_labels('coalesce(s.rnk, 0)', 'coalesce(list_distinct(s.flags), [])')} AS taint,
        coalesce(s.depth, 0) AS taint_depth,
        (SELECT count(*) FROM fx_touch t WHERE t.session_id = c.session_id AND t.seq < c.seq)
            AS artifacts_touched,
        (SELECT count(*) FROM fx_touch t WHERE t.session_id = c.session_id AND t.seq < c.seq
            AND t.seq > coalesce((SELECT max(seq) FROM fx_effect e WHERE e.session_id = c.session_id
                AND e.seq < c.seq AND e.op = 'artifact.egress'), -1)) AS since_last_egress,
        NOT coalesce(s.has, false) AS first_touch
    FROM fx_call c LEFT JOIN fx_seen s USING (session_id, seq)""", I.DUCK_RUNNING))
def running_state(spark, sf):
    recs = I.records(spark, sf)
    rows = recs.select("session_id", "seq", "artifact_id")
    return T.running_state(T.select_effects(recs), rows).select(
        "session_id", "seq", L.text(F.col("taint")).alias("taint"), "taint_depth",
        "artifacts_touched", "since_last_egress", "first_touch")


@query("t_07_state_digest", duck(["fx_call"], f"""
    SELECT m.session_id,
        sha256(concat('[', coalesce(g.edges, ''), ']')) AS graph_digest,
        sha256(concat('{{"compaction_generation":', m.gen, ',"edges":[', coalesce(g.edges, ''),
            '],"labels":["', coalesce(l.labels, 'public'), '"],"session_id":"', m.session_id,
            '","since_last_egress":', coalesce(t.since, 0), ',"sources":[', coalesce(s.refs, ''),
            '],"touched":', coalesce(t.touched, 0), '}}')) AS digest
    FROM fx_mark m
    LEFT JOIN (SELECT session_id, string_agg(concat('["', out_id, '","', artifact_id, '","Write:',
                   out_path, '"]'), ',' ORDER BY out_id, artifact_id, out_path) AS edges
               FROM fx_effect WHERE op = 'artifact.derive' GROUP BY session_id) g
        ON g.session_id = m.session_id
    LEFT JOIN (SELECT session_id, replace({I.duck_labels('max(rnk)', 'flatten(list(flags))')}, ',',
                   '","') AS labels FROM fx_contrib GROUP BY session_id) l
        ON l.session_id = m.session_id
    LEFT JOIN (SELECT session_id, string_agg(concat('{{"artifact_id":"', artifact_id,
                   '","digest":null,"labels":["', replace({I.duck_labels('rnk', 'flags')}, ',', '","'),
                   '"],"path":"', path, '"}}'), ',' ORDER BY artifact_id) AS refs
               FROM fx_source GROUP BY session_id) s ON s.session_id = m.session_id
    LEFT JOIN (SELECT session_id, count(*) AS touched,
                   count(*) FILTER (e IS NULL OR seq > e) AS since
               FROM fx_placed GROUP BY session_id) t ON t.session_id = m.session_id""", _STATE))
def state_digest(spark, sf):
    return T.state_digests(I.records(spark, sf))


@query("t_08_cache_check", duck(["fx_call"], """
    SELECT session_id, CASE WHEN uid % 9 = 4 THEN NULL ELSE uid % 5 <> 2 END AS cache_agrees,
        uid % 9 <> 4 AND uid % 5 <> 2 AS agreed
    FROM (SELECT DISTINCT session_id, user_id AS uid FROM fx_call)"""))
def cache_check(spark, sf):
    rebuilt = T.state_digests(I.records(spark, sf)).select("session_id", "digest")
    uid = F.substring("session_id", 2, 20).cast("long")
    cached = rebuilt.where(uid % 9 != 4).withColumn(
        "digest", F.when(uid % 5 == 2, F.lit("stale")).otherwise(F.col("digest")))
    return T.reconcile_cache(rebuilt, cached).select(
        "session_id", (F.col("digest") == F.col("cached_digest")).alias("cache_agrees"), "agreed")


@query("t_09_merge_children", duck(["fx_call"], f"""
    SELECT p.session_id, coalesce(n.merged, 0) AS merged_sources, p.labels AS labels_before,
        p.depth + coalesce(n.merged, 0) AS depth_after,
        p.touched + coalesce(n.merged, 0) AS touched_after
    FROM (SELECT m.session_id,
              coalesce((SELECT {I.duck_labels('max(rnk)', 'flatten(list(flags))')} FROM fx_contrib c
                        WHERE c.session_id = m.session_id HAVING count(*) > 0), 'public') AS labels,
              (SELECT count(*) FROM fx_source s WHERE s.session_id = m.session_id) AS depth,
              (SELECT count(*) FROM fx_placed t WHERE t.session_id = m.session_id) AS touched
          FROM fx_mark m WHERE m.session_id IN (SELECT parent FROM fx_link)) p
    LEFT JOIN (SELECT parent, count(DISTINCT artifact_id) AS merged FROM fx_link k
               JOIN fx_source s ON s.session_id = k.child
               WHERE NOT EXISTS (SELECT 1 FROM fx_source o WHERE o.session_id = k.parent
                                 AND o.artifact_id = s.artifact_id)
               GROUP BY parent) n ON n.parent = p.session_id""", _STATE + """,
    fx_link AS (SELECT DISTINCT session_id AS child,
        concat('s', cast(cast(floor(user_id / 4) AS bigint) * 4 AS string)) AS parent
        FROM fx_call WHERE user_id % 4 <> 0)"""))
def merge_children(spark, sf):
    recs = I.records(spark, sf)
    uid = F.substring("session_id", 2, 20).cast("long")
    links = recs.select("session_id").distinct().where(uid % 4 != 0).select(
        F.concat(F.lit("s"), (F.floor(uid / 4) * 4).cast("string")).alias("parent_id"),
        F.col("session_id").alias("child_id"), uid.alias("seq"))
    known = recs.select("session_id").distinct()
    out = T.merge_children(T.sources(recs), links, T.rollup(recs))
    return out.join(known, "session_id", "left_semi").select(
        "session_id", "merged_sources", L.text(F.col("labels_before")).alias("labels_before"),
        "depth_after", "touched_after")


@query("t_10_safe_state", duck(["fx_call"], """
    SELECT c.session_id, CASE WHEN c.l IN ('L1', 'L5') THEN 'restricted' END AS forced,
        CASE WHEN c.l = 'L1' THEN 'chain broken' WHEN c.l = 'L5'
            THEN 'the ledger does not verify' END AS unverifiable_reason
    FROM (SELECT DISTINCT session_id, ledger_id AS l FROM fx_call) c"""))
def safe_state(spark, sf):
    recs = I.records(spark, sf)
    owner = recs.select("session_id", "ledger_id").distinct()
    verdicts = recs.select("ledger_id").distinct().where("ledger_id <> 'L6'").select(
        "ledger_id", (~F.col("ledger_id").isin("L1", "L5")).alias("usable"),
        F.when(F.col("ledger_id") == "L1", "chain broken").alias("reason"))
    out = T.safe_state(T.rollup(recs).join(owner, "session_id"), verdicts)
    return out.select("session_id", F.when(
        F.col("unverifiable_reason").isNotNull() & (F.col("touched") == 0),
        L.text(F.col("labels"))).alias("forced"), "unverifiable_reason")
