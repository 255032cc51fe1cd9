"""Session custody state: effects, touches, rollup, running state, digests, merges.

Input is the normalised record table (``operators.validate.normalise``)::

    session_id, seq, op, outcome, action_id, used, generated, derived_from, declassified

``seq`` is record order and unique within a session.  No operator folds a session in one task:
touches are aggregated per (session, artifact) first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions import labels as L
from provlake.functions.ordered import CHUNK_ROWS, first_per_key, running
from provlake.functions.text import unnest
from provlake.session import cut_lineage

REF = "array<struct<artifact_id:string,path:string,digest:string,labels:array<string>>>"
DERIVED = "array<struct<generated:string,source:string,via:string>>"


# ── T-03 ────────────────────────────────────────────────────────────────────────────────────
def first_effects(records: DataFrame) -> DataFrame:
    """First record per (session, action, op); records without an action id are all kept."""
    keys = [F.col("session_id"), F.col("op"), F.col("action_id"),
            F.when(F.col("action_id").isNull(), F.col("seq"))]
    return first_per_key(records, keys, F.col("seq"))


def select_effects(records: DataFrame) -> DataFrame:
    """T-03: dedupe first, then drop denials, so a first ``deny`` hides a later pair."""
    return first_effects(records).where(~F.col("outcome").eqNullSafe("deny"))


# ── touches and edges ───────────────────────────────────────────────────────────────────────
def _ref(x: Column, labels: Column | None = None) -> Column:
    own = F.when(F.coalesce(F.size(x["labels"]), F.lit(0)) > 0, x["labels"]).otherwise(
        F.array(F.lit("public")))
    return F.struct(F.coalesce(x["artifact_id"], F.lit("unknown")).alias("artifact_id"),
                    F.coalesce(x["path"], F.lit("")).alias("path"),
                    x["digest"].alias("digest"),
                    (own if labels is None else L.join_sets(own, labels)).alias("labels"))


def touched_refs() -> Column:
    """Refs a record touches: a derivation touches its outputs only, carrying its inputs' labels."""
    used = F.coalesce(F.col("used"), F.array().cast(REF))
    made = F.coalesce(F.col("generated"), F.array().cast(REF))
    inputs = F.flatten(F.transform(used, lambda u: _ref(u)["labels"]))
    return F.when(
        (F.col("op") == "artifact.derive") & (F.size(made) > 0),
        F.transform(made, lambda g: _ref(g, inputs)),
    ).otherwise(F.concat(F.transform(used, lambda x: _ref(x)), F.transform(made, lambda x: _ref(x))))


def touches(effects: DataFrame) -> DataFrame:
    """One row per touch: session_id, seq, ord, artifact_id, path, digest, labels, classified."""
    return (unnest(effects, touched_refs(), ["session_id", "seq"], "_r", "ord")
            .select("session_id", "seq", "ord", "_r.*")
            .withColumn("classified", L.is_classified(F.col("labels"))))


def edges(effects: DataFrame) -> DataFrame:
    """Derivation edges of derive records: session_id, seq, output_id, input_id, via."""
    via = F.coalesce(F.when(F.size("derived_from") > 0,
                            F.coalesce(F.col("derived_from")[0]["via"], F.lit("unknown"))),
                     F.lit("unknown"))
    made = effects.where((F.col("op") == "artifact.derive") & (F.size("generated") > 0))
    return (made.select("session_id", "seq", "used", via.alias("via"),
                        F.explode("generated.artifact_id").alias("output_id"))
            .select("session_id", "seq", F.coalesce("output_id", F.lit("unknown")).alias("output_id"),
                    F.explode("used.artifact_id").alias("input_id"), "via")
            .withColumn("input_id", F.coalesce("input_id", F.lit("unknown"))))


# ── T-04 ────────────────────────────────────────────────────────────────────────────────────
def _marks(first: DataFrame) -> DataFrame:
    """Per session: last declassification, last egress, number of checkpoints."""
    live = ~F.col("outcome").eqNullSafe("deny")
    return first.groupBy("session_id").agg(
        F.max(F.when(live & (F.col("op") == "custody.declassify")
                     & (F.coalesce(F.col("declassified"), F.lit("")) != ""), F.col("seq"))
              ).alias("dropped_at"),
        F.max(F.when(live & (F.col("op") == "artifact.egress"), F.col("seq"))).alias("egress_at"),
        F.count_if(live & (F.col("op") == "custody.checkpoint")).alias("compaction_generation"))


def _placed(first: DataFrame, marks: DataFrame) -> DataFrame:
    """Touches with the session marks and the artifact's own last declassification."""
    effects = first.where(~F.col("outcome").eqNullSafe("deny"))
    drops = (effects.where((F.col("op") == "custody.declassify") & (F.col("declassified") != ""))
             .groupBy("session_id", F.col("declassified").alias("artifact_id"))
             .agg(F.max("seq").alias("artifact_dropped_at")))
    return (touches(effects).join(marks, "session_id", "left")
            .join(drops, ["session_id", "artifact_id"], "left"))


def _per_artifact(placed: DataFrame) -> DataFrame:
    pos = F.struct("seq", "ord")
    alive = F.col("classified") & (F.col("artifact_dropped_at").isNull()
                                   | (F.col("seq") > F.col("artifact_dropped_at")))
    late = F.col("dropped_at").isNull() | (F.col("seq") > F.col("dropped_at"))
    ref = F.struct("path", "digest", "labels")
    return placed.groupBy("session_id", "artifact_id").agg(
        F.max_by(F.when(alive, ref), F.when(alive, pos)).alias("source"),
        F.max_by(F.when(alive & ~late, F.col("labels")),
                 F.when(alive & ~late, pos)).alias("held"),
        L.join_agg(F.when(late, F.col("labels"))).alias("later"),
        F.count(F.lit(1)).alias("touched"),
        F.count_if(F.col("egress_at").isNull() | (F.col("seq") > F.col("egress_at"))
                   ).alias("since_last_egress"))


def sources(records: DataFrame) -> DataFrame:
    """Classified sources each session holds at the end: (session, artifact, path, digest, labels)."""
    first = first_effects(records)
    per = _per_artifact(_placed(first, _marks(first)))
    return per.where("source IS NOT NULL").select("session_id", "artifact_id", "source.*")


def rollup(records: DataFrame) -> DataFrame:
    """T-04 with the T-05 measures: one row per session."""
    first = first_effects(records)
    marks = _marks(first)
    per = _per_artifact(_placed(first, marks))
    state = per.groupBy("session_id").agg(
        L.join_agg(F.concat(F.coalesce("held", F.array().cast("array<string>")), "later")
                   ).alias("labels"),
        F.count("source").alias("depth"),
        F.count_if(L.sens_rank(F.col("source.labels")) == 3).alias("restricted_touched"),
        F.sum("touched").alias("touched"),
        F.sum("since_last_egress").alias("since_last_egress"))
    out = marks.select("session_id", "compaction_generation").join(state, "session_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long"))
            for c in ("depth", "restricted_touched", "touched", "since_last_egress")}
    return (out.withColumns(zero)
            .withColumn("labels", F.coalesce("labels", F.array(F.lit("public"))))
            .withColumn("summary", F.format_string(
                "session %s: %s from %d classified artifact(s), %d touch(es)",
                "session_id", L.describe(F.col("labels")), "depth", "touched")))


# ── T-06 ────────────────────────────────────────────────────────────────────────────────────
def _holds(effects: DataFrame, asked: DataFrame, drop: Column, chunk_rows: int) -> DataFrame:
    """Per (session, artifact, seq) that touches, drops or asks: the labels held before and after.

    One row per record and artifact is left before anything is ordered; ``after`` is empty where
    the artifact is dropped and null where the record only asks.
    """
    touch = F.struct("ord", "labels").alias("touch")
    no = F.lit(False)
    none = F.lit(None).cast("struct<ord:int,labels:array<string>>").alias("touch")
    key = ["session_id", "artifact_id", "seq"]
    rows = (touches(effects).where("classified").select(*key, touch, no.alias("drop"), no.alias("asks"))
            .unionByName(effects.where(drop).select("session_id", F.col("declassified").alias("artifact_id"), "seq",
                                                    none, F.lit(True).alias("drop"), no.alias("asks")))
            .unionByName(asked.where("artifact_id IS NOT NULL").select(*key, none, no.alias("drop"),
                                                                       F.lit(True).alias("asks"))))
    rows = rows.groupBy(*key).agg(F.max("touch").alias("touch"), F.bool_or("drop").alias("drop"),
                                  F.bool_or("asks").alias("asks"))
    rows = rows.select(*key, "asks", F.when(F.col("drop"), F.array().cast("array<string>")).when(
        F.col("touch").isNotNull(), F.col("touch.labels")).alias("after"))
    return running(rows, ["session_id", "artifact_id"], "seq", {"before": ("last", F.col("after"))},
                   chunk_rows=chunk_rows)


def _positions(effects: DataFrame, asked: DataFrame, drop: Column, chunk_rows: int) -> DataFrame:
    """One row per (session, seq) that changes state or asks, with the counters before it.

    ``epoch`` is the number of declassifications before; ``moves`` are the labels (name, +1 or -1)
    that the record lays on or takes off the held artifacts.
    """
    def moved(labels: str, n: int) -> Column:
        return F.transform(F.coalesce(labels, F.array().cast("array<string>")),
                           lambda x: F.struct(x.alias("label"), F.lit(n).cast("long").alias("n")))

    full = lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0).cast("long")
    live = F.col("after").isNotNull()
    changes = _holds(effects, asked, drop, chunk_rows).groupBy("session_id", "seq").agg(
        F.sum(F.when(live, full("after") - full("before")).otherwise(0)).alias("_held"),
        F.flatten(F.collect_list(F.when(live, F.concat(moved("before", -1), moved("after", 1))))).alias("moves"),
        F.max(F.when(F.col("asks"), full("before"))).alias("_has"))
    refs = touched_refs()
    counts = effects.select(
        "session_id", "seq", F.size(refs).cast("long").alias("_n"), (F.col("op") == "artifact.egress").alias("_out"),
        drop.cast("long").alias("_drop"), F.array_distinct(F.flatten(F.transform(refs, lambda r: r["labels"]))
                                                           ).alias("labels"))
    asks = asked.select("session_id", "seq", F.lit(True).alias("asks"))
    rows = (changes.unionByName(counts, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
            .groupBy("session_id", "seq").agg(*[F.any_value(F.col(c), ignoreNulls=F.lit(True)).alias(c) for c in (
                "_held", "moves", "_has", "_n", "_out", "_drop", "labels", "asks")]))
    # Two running passes on top of each other read their rows four times.
    rows, zero = cut_lineage(rows), F.lit(0).cast("long")
    seen = running(rows, ["session_id"], "seq", {
        "taint_depth": ("sum", F.coalesce("_held", zero)),
        "artifacts_touched": ("sum", F.coalesce("_n", zero)),
        "epoch": ("sum", F.coalesce("_drop", zero))}, chunk_rows=chunk_rows)
    after = F.when(F.col("_out"), F.col("artifacts_touched") + F.col("_n"))
    return running(seen, ["session_id"], "seq", {"_base": ("last", after)}, chunk_rows=chunk_rows)


def _labels_kept(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(session, epoch, _kept): labels of the artifacts still held right after each declassification.

    Label counts change by the records' moves and are summed along the epochs of each (session,
    label); a session has few labels, so this is in proportion to its declassifications.
    """
    moves = (rows.select("session_id", "epoch", F.explode("moves").alias("m"))
             .groupBy("session_id", "m.label", (F.col("epoch") + 1).alias("epoch"))
             .agg(F.sum("m.n").alias("n")).where("n <> 0"))
    wanted = rows.where("asks AND epoch > 0").select("session_id", "epoch").distinct()
    asks = wanted.join(moves.select("session_id", "label").distinct(), "session_id").withColumn("asks", F.lit(True))
    both = moves.unionByName(asks, allowMissingColumns=True).groupBy("session_id", "label", "epoch").agg(
        F.sum("n").alias("n"), F.bool_or("asks").alias("asks"))
    held = running(both, ["session_id", "label"], "epoch", {"held": ("sum", F.coalesce("n", F.lit(0).cast("long")))},
                   inclusive=True, chunk_rows=chunk_rows)
    return held.where("asks AND held > 0").groupBy("session_id", "epoch").agg(
        F.collect_list("label").alias("_kept"))


def running_state(effects: DataFrame, records: DataFrame, artifact: str = "artifact_id",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """T-06: what a decision sees before its own record.

    ``effects`` are the effected records that change state; ``records`` are the rows to describe
    (session_id, seq unique in it, and the call's artifact).  Each (session, artifact) gives +1 where
    it comes to be held and -1 where a declassification takes it back: depth is a running sum.  A
    declassification also begins an epoch of its session: labels are those of the artifacts held
    when the epoch began (running sums of label counts) and those touched in it so far (the first
    position of each label in the epoch).  All sums run in chunks, so a session stays spread.
    """
    # Touches, drops and counts each read the effects: what they need is written once.
    read = ("session_id", "seq", "op", "used", "generated", "declassified")
    effects = cut_lineage(effects.select(*[c for c in read if c in effects.columns]))
    drop = _is_drop() if "declassified" in effects.columns else F.lit(False)
    asked = records.select("session_id", "seq", F.col(artifact).alias("artifact_id"))
    rows = cut_lineage(_positions(effects, asked, drop, chunk_rows))
    fresh = (rows.select("session_id", "epoch", "seq", F.explode("labels").alias("label"))
             .groupBy("session_id", "epoch", "label").agg(F.min("seq").alias("seq"))
             .groupBy("session_id", "epoch").agg(F.collect_list(F.struct("seq", "label")).alias("_fresh")))
    state = (rows.where("asks").join(fresh, ["session_id", "epoch"], "left")
             .join(_labels_kept(rows, chunk_rows), ["session_id", "epoch"], "left"))
    seen = F.transform(F.filter(F.coalesce("_fresh", F.array().cast(
        "array<struct<seq:bigint,label:string>>")), lambda x: x["seq"] < F.col("seq")), lambda x: x["label"])
    return records.join(state.select(
        "session_id", "seq", L.join_sets(seen, F.col("_kept")).alias("taint"), "taint_depth", "artifacts_touched",
        (F.col("artifacts_touched") - F.coalesce("_base", F.lit(0).cast("long"))).alias("since_last_egress"),
        (F.coalesce("_has", F.lit(0).cast("long")) == 0).alias("first_touch")), ["session_id", "seq"])


def _is_drop() -> Column:
    return F.coalesce((F.col("op") == "custody.declassify") & (F.col("declassified") != ""), F.lit(False))


# ── T-07 ────────────────────────────────────────────────────────────────────────────────────
_DIGEST_SCHEMA = "session_id string, digest string, graph_digest string"


def _hash_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted (session, part, key) rows into one canonical JSON digest per session.

    Keeps two running hashers and the current session only, whatever its size.
    """
    def piece(obj) -> bytes:
        return json.dumps(obj, sort_keys=True, separators=(",", ":")).encode()

    done: list[tuple] = []
    cur: dict | None = None

    def close() -> None:
        if cur is None:
            return
        cur["all"].update(cur["tail"])
        cur["graph"].update(b"]")
        done.append((cur["sid"], cur["all"].hexdigest(), cur["graph"].hexdigest()))

    for batch in batches:
        for r in batch.to_pylist():
            if cur is None or cur["sid"] != r["session_id"]:
                close()
                cur = {"sid": r["session_id"], "all": hashlib.sha256(), "graph": hashlib.sha256(),
                       "part": None, "tail": b""}
                cur["all"].update(b'{"compaction_generation":'
                                  + piece(r["compaction_generation"]) + b',"edges":[')
                cur["graph"].update(b"[")
                cur["mid"] = (b'],"labels":' + piece(sorted(r["labels"])) + b',"session_id":'
                              + piece(r["session_id"]) + b',"since_last_egress":'
                              + piece(r["since_last_egress"]) + b',"sources":[')
                cur["tail"] = cur["mid"] + b'],"touched":' + piece(r["touched"]) + b"}"
                cur["end"] = b'],"touched":' + piece(r["touched"]) + b"}"
            if r["part"] == 1:
                edge = piece([r["k1"], r["k2"], r["k3"]])
                sep = b"," if cur["part"] == 1 else b""
                cur["all"].update(sep + edge)
                cur["graph"].update(sep + edge)
                cur["part"] = 1
            elif r["part"] == 2:
                if cur["part"] != 2:
                    cur["all"].update(cur["mid"])
                    cur["tail"] = cur["end"]
                ref = piece({"artifact_id": r["k1"], "path": r["path"], "digest": r["digest"],
                             "labels": sorted(r["ref_labels"])})
                cur["all"].update((b"," if cur["part"] == 2 else b"") + ref)
                cur["part"] = 2
        if done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("session_id", "digest", "graph_digest"), d, strict=True))
                 for d in done])
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("session_id", "digest", "graph_digest"), d, strict=True)) for d in done])


def state_digests(records: DataFrame) -> DataFrame:
    """T-07: digest of each session's whole state and of its edge list."""
    return digests_of(rollup(records), sources(records), edges(select_effects(records)))


def digests_of(heads: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """T-07 of state tables: rolled up here, or read from a stream's state.

    One SHA-256 is sequential by nature; rows stream through it in sorted order, so memory does
    not grow with the session.
    """
    head = heads.select("session_id", "labels", "touched", "since_last_egress",
                        "compaction_generation")
    null = F.lit(None).cast("string")
    nolabels = F.lit(None).cast("array<string>")

    def part(n: int) -> Column:
        return F.lit(n).cast("int").alias("part")

    e = links.select(
        "session_id", part(1), F.col("output_id").alias("k1"), F.col("input_id").alias("k2"),
        F.col("via").alias("k3"), null.alias("path"), null.alias("digest"),
        nolabels.alias("ref_labels"))
    s = held.select(
        "session_id", part(2), F.col("artifact_id").alias("k1"), null.alias("k2"),
        null.alias("k3"), "path", "digest", F.col("labels").alias("ref_labels"))
    base = head.select("session_id", part(0), null.alias("k1"), null.alias("k2"),
                       null.alias("k3"), null.alias("path"), null.alias("digest"),
                       nolabels.alias("ref_labels"))
    rows = base.unionByName(e).unionByName(s).join(head, "session_id")
    ordered = rows.repartition("session_id").sortWithinPartitions(
        "session_id", "part", "k1", "k2", "k3")
    return ordered.mapInArrow(_hash_states, _DIGEST_SCHEMA)


# ── T-08 / T-09 / T-10 ──────────────────────────────────────────────────────────────────────
def reconcile_cache(rebuilt: DataFrame, cached: DataFrame) -> DataFrame:
    """T-08: (session_id, digest) tables compared; the ledger wins, disagreement is a finding."""
    c = cached.select("session_id", F.col("digest").alias("cached_digest"))
    return rebuilt.join(c, "session_id", "left").withColumn(
        "agreed", F.col("digest").eqNullSafe(F.col("cached_digest")))


def merged_cache(rebuilt: DataFrame, cached: DataFrame) -> DataFrame:
    """T-08: the cache after the ledger's rows replaced the ones that disagree or are missing."""
    keep = cached.join(rebuilt, "session_id", "left_anti")
    return keep.unionByName(rebuilt.select(*cached.columns))


def merge_children(held: DataFrame, links: DataFrame, state: DataFrame) -> DataFrame:
    """T-09: a child's sources the parent lacks count as touches of the parent.

    ``held`` are T-04 sources, ``links(parent_id, child_id, seq)`` the merges and ``state`` the
    parents' rollup.  Of several children bringing one artifact the first merge counts.
    """
    brought = (links.join(held.withColumnRenamed("session_id", "child_id"), "child_id")
               .withColumnRenamed("parent_id", "session_id"))
    new = (brought.join(held.select("session_id", "artifact_id"), ["session_id", "artifact_id"],
                        "left_anti")
           .groupBy("session_id", "artifact_id")
           .agg(F.min_by(F.col("labels"), F.col("seq")).alias("labels")))
    gain = new.groupBy("session_id").agg(F.count(F.lit(1)).alias("merged_sources"),
                                         L.join_agg(F.col("labels")).alias("_gained"))
    parents = links.select(F.col("parent_id").alias("session_id")).distinct()
    out = parents.join(state, "session_id", "left").join(gain, "session_id", "left")
    n = F.coalesce("merged_sources", F.lit(0).cast("long"))
    return out.select(
        "session_id", n.alias("merged_sources"),
        F.coalesce("labels", F.array(F.lit("public"))).alias("labels_before"),
        L.join_sets(F.col("labels"), F.col("_gained")).alias("labels_after"),
        (F.coalesce("depth", F.lit(0).cast("long")) + n).alias("depth_after"),
        (F.coalesce("touched", F.lit(0).cast("long")) + n).alias("touched_after"),
        (n > 0).alias("changed"))


def safe_state(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    """T-10: a session on an unverifiable ledger is maximally tainted, with the reason.

    ``verdicts(ledger_id, usable, reason)`` comes from L-01/L-02; an absent ledger is normal.
    """
    out = state.join(verdicts.select("ledger_id", "usable", "reason"), "ledger_id", "left")
    unsafe = ~F.coalesce("usable", F.lit(True))
    kept = {c: F.when(unsafe, F.lit(0).cast("long")).otherwise(F.col(c))
            for c in ("depth", "restricted_touched", "touched", "since_last_egress",
                      "compaction_generation") if c in state.columns}
    return (out.withColumn("unverifiable_reason", F.when(
                unsafe, F.coalesce("reason", F.lit("the ledger does not verify"))))
            .withColumns(kept)
            .withColumn("labels", F.when(unsafe, F.array(F.lit("restricted")))
                        .otherwise(F.col("labels")))
            .drop("usable", "reason"))
