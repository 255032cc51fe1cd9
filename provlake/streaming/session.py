"""Stateful session stream: decisions, results, checkpoints, merges, turn closes.

One key is one session, which replaces a lock per session.  State is small and flat: a head (labels
and counters), one entry per classified source, one per way that edges lead to an output (their sources
as one list), one per action id.  Every access is a call to the state store's process, so the rows of a
micro-batch work on copies: an entry is fetched once and written back once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provlake import vocab
from provlake.functions import pointwise as P

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows the processor reads.  ``refs`` are a result's artifacts or a merge's child sources.
INPUT = ["session_id", "seq", "kind", "tool", "op", "posture", "permission_mode", "action_id",
         "artifact_id", "canonical_path", "labels", "classified", "is_egress", "is_write",
         "is_ledger", "is_own_binary", "success", "result_bytes", "refs", "child", "edges",
         "cache_digest"]
REFS = "array<struct<artifact_id:string,path:string,digest:string,labels:array<string>>>"
OUTPUT = ("session_id string, seq long, row_kind string, op string, outcome string, "
          "determining_policy string, artifact_id string, taint_depth long, "
          "since_last_egress long, detail string")
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_sorted_json = json.JSONEncoder(sort_keys=True).encode


def enable(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Rows of one frame that a processor sends.
FRAME = 10_000


class _Entries:
    """A map of one session as one micro-batch sees it: an entry is fetched once, and what has changed is
    written back by ``store``.  A ``fresh`` session has nothing to fetch."""

    def __init__(self, state, fresh: bool):
        self.state, self.whole, self.have, self.changed = state, fresh, {}, {}

    def get(self, key: str) -> str | None:
        if key not in self.have and not self.whole:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.have[key] = None if found is None else found[0]
        return self.have.get(key)

    def put(self, key: str, value: str) -> None:
        if self.get(key) != value:
            self.have[key] = value
            self.changed[key] = True

    def all(self) -> dict[str, str]:
        if not self.whole:
            self.have = {**{k[0]: v[0] for k, v in self.state.iterator()},
                         **{k: self.have[k] for k in self.changed}}
            self.whole = True
        return self.have

    def store(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), (self.have[key],))


class SessionProcessor(StatefulProcessor):
    def __init__(self, policies=None, protect_ledger: bool = True):
        self.policies = list(policies or vocab.POLICIES)
        self.protect_ledger = protect_ledger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "body string")
        self.maps = {
            "sources": handle.getMapState("sources", "artifact_id string", "ref string"),
            "edges": handle.getMapState("edges", "way string", "sources string"),
            "actions": handle.getMapState("actions", "id string", "phases string")}

    # ── state access ────────────────────────────────────────────────────────────────────────
    def _load(self) -> dict:
        # Whatever a session has, it has a head.
        fresh = not self.head.exists()
        self.sources, self.edge_set, self.actions = (
            _Entries(self.maps[m], fresh) for m in ("sources", "edges", "actions"))
        self.ways: dict[str, dict[str, int]] = {}
        if not fresh:
            return json.loads(self.head.get()[0])
        return {"labels": ["public"], "depth": 0, "touched": 0, "since": 0, "generation": 0}

    def _store(self, h: dict) -> None:
        for way, sources in self.ways.items():
            self.edge_set.put(way, json.dumps(list(sources)))
        for m in (self.sources, self.edge_set, self.actions):
            m.store()
        self.head.update((json.dumps(h),))

    def _edge(self, output, source, *via) -> None:
        way = json.dumps([output, *via])
        if way not in self.ways:
            self.ways[way] = dict.fromkeys(json.loads(self.edge_set.get(way) or "[]"), 1)
        self.ways[way][source] = 1

    def _edges(self) -> list[list]:
        """Every edge as (output, source, via), sorted."""
        ways = {**{w: json.loads(x) for w, x in self.edge_set.all().items() if x is not None}, **self.ways}
        return sorted([out, source, *via] for w, sources in ways.items() for out, *via in [json.loads(w)]
                      for source in sources)

    def _touch(self, h: dict, ref: dict) -> None:
        h["touched"] += 1
        h["since"] += 1
        if P.is_classified(ref["labels"]):
            if self.sources.get(ref["artifact_id"]) is None:
                h["depth"] += 1
            self.sources.put(ref["artifact_id"], _sorted_json(ref))
        h["labels"] = P.join(h["labels"], ref["labels"])

    def _digest(self, sid: str, h: dict) -> str:
        """T-07 of the session so far: keys are sorted, entries are read one by one into the hash."""
        def piece(obj) -> bytes:
            return json.dumps(obj, sort_keys=True, separators=(",", ":")).encode()

        out = hashlib.sha256(b'{"compaction_generation":' + piece(h["generation"]) + b',"edges":[')
        for i, edge in enumerate(self._edges()):
            out.update(b"," * (i > 0) + piece(edge))
        out.update(b'],"labels":' + piece(sorted(h["labels"])) + b',"session_id":' + piece(sid)
                   + b',"since_last_egress":' + piece(h["since"]) + b',"sources":[')
        for i, (_, body) in enumerate(sorted(self.sources.all().items())):
            ref = json.loads(body)
            out.update(b"," * (i > 0) + piece({**ref, "labels": sorted(ref["labels"])}))
        out.update(b'],"touched":' + piece(h["touched"]) + b"}")
        return out.hexdigest()

    def _phase(self, action_id, phase: str) -> None:
        if not action_id:
            return
        d, r = (int(x) for x in (self.actions.get(action_id) or "0,0").split(","))
        d, r = d + (phase == "dispatch"), r + (phase == "result")
        self.actions.put(action_id, f"{d},{r}")

    # ── events ──────────────────────────────────────────────────────────────────────────────
    def _call(self, h: dict, r: dict) -> list[dict]:
        held = bool(r["artifact_id"]) and self.sources.get(r["artifact_id"]) is not None
        outcome, policy, _ = P.call(self.policies, self.protect_ledger, h, held, r)
        out = {"row_kind": "decision", "op": r["op"], "outcome": outcome,
               "determining_policy": policy, "artifact_id": r["artifact_id"],
               "taint_depth": h["depth"], "since_last_egress": h["since"], "detail": None}
        if r["classified"] and outcome in ("allow", "ask"):
            self._touch(h, {"artifact_id": r["artifact_id"], "path": r["canonical_path"],
                            "digest": None, "labels": list(r["labels"])})
        elif r["is_egress"] and outcome == "allow":
            h["since"] = 0
        self._phase(r["action_id"], "dispatch")
        return [out]

    def _result(self, h: dict, r: dict) -> list[dict]:
        """Touches of a result. What is written takes on the session's labels and an edge to every
        source held; the record lists used and generated artifacts and the edges."""
        rows, used, made, derived = [], [], [], []
        for x in r["refs"] if r["refs"] is not None else []:
            ref = {"artifact_id": x["artifact_id"], "path": x["path"], "digest": x["digest"],
                   "labels": list(x["labels"])}
            if r["is_write"]:
                ref["labels"] = P.join(ref["labels"], h["labels"])
                via = f"{r['tool']}:{ref['path']}"
                for source in sorted(self.sources.all()):
                    derived.append({"generated": ref["artifact_id"], "source": source, "via": via})
                    self._edge(ref["artifact_id"], source, via)
                    rows.append({"row_kind": "edge", "artifact_id": ref["artifact_id"],
                                 "detail": _sorted_json({"source": source, "via": via})})
                made.append(ref)
                self._touch(h, ref)
            else:
                used.append(ref)
                if P.is_classified(ref["labels"]):
                    self._touch(h, ref)
        op = ("artifact.derive" if derived else "artifact.write") if r["is_write"] else "tool.result"
        rows.append({"row_kind": "result", "op": op, "taint_depth": h["depth"],
                     "since_last_egress": h["since"], "detail": json.dumps({
                         "success": bool(r["success"]), "result_bytes": int(r["result_bytes"] or 0),
                         "used": used, "generated": made, "derived_from": derived,
                         "basis": {"taint": h["labels"], "taint_depth": h["depth"]}}, sort_keys=True)})
        self._phase(r["action_id"], "result")
        return rows

    def _checkpoint(self, h: dict, r: dict) -> list[dict]:
        """The digest of the rebuilt state; a cache that says otherwise is a critical finding."""
        digest = self._digest(r["session_id"], h)
        cached = r["cache_digest"] or digest
        row = {"row_kind": "checkpoint", "op": "custody.checkpoint", "taint_depth": h["depth"],
               "detail": json.dumps({
                   "session_custody_digest": digest, "source": "ledger-authoritative",
                   "cache_digest": cached, "cache_agreed": cached == digest,
                   "severity": "info" if cached == digest else "critical", "labels": sorted(h["labels"]),
                   "touched": h["touched"], "compaction_generation": h["generation"]}, sort_keys=True)}
        h["generation"] += 1
        return [row]

    def _merge(self, h: dict, r: dict) -> list[dict]:
        """A child's sources that the session lacks count as touches; its edges are taken over."""
        before, n = self._digest(r["session_id"], h), 0
        refs = list(r["refs"]) if r["refs"] is not None else []
        for x in refs:
            if self.sources.get(x["artifact_id"]) is None:
                n += 1
                self._touch(h, {"artifact_id": x["artifact_id"], "path": x["path"],
                                "digest": x["digest"], "labels": list(x["labels"])})
        for e in r["edges"] if r["edges"] is not None else []:
            self._edge(*e)
        after = self._digest(r["session_id"], h)
        child = r["labels"] if r["labels"] is not None else P.join(*(list(x["labels"]) for x in refs))
        return [{"row_kind": "merge", "op": "agent.merge", "taint_depth": h["depth"],
                 "detail": json.dumps({
                     "child_agent": r["child"], "child_labels": sorted(child), "merged_sources": n,
                     "parent_digest_before": before, "parent_digest_after": after,
                     "parent_labels_after": sorted(h["labels"]), "changed": before != after}, sort_keys=True)}]

    def _stop(self, h: dict, r: dict) -> list[dict]:
        pairs = [(k, *(int(x) for x in v.split(","))) for k, v in self.actions.all().items()]
        opened = sorted(i for i, d, n in pairs if d and not n)
        odd = any((d > 0) != (n > 0) for _, d, n in pairs)
        severity = "critical" if odd else "info" if pairs else "warning"
        return [{"row_kind": "turn", "op": "tool.reconcile", "detail": json.dumps({
            "dispatched": sum(d for _, d, _ in pairs), "reported": sum(n for _, _, n in pairs),
            "action_instances": len(pairs), "unclosed": opened, "severity": severity,
            "examined_anything": bool(pairs)}, sort_keys=True)}]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        # Only the rows of one session in one micro-batch are held, to put them in record order; of
        # one record's rows its call comes first.
        batch = pd.concat(list(rows)).sort_values(["seq", "kind"], kind="stable")
        head, out = self._load(), []
        run = {"call": self._call, "result": self._result, "checkpoint": self._checkpoint,
               "merge": self._merge, "stop": self._stop}
        for start in range(0, len(batch), FRAME):
            part = batch.iloc[start:start + FRAME]
            for values in zip(*(part[c].tolist() for c in part), strict=True):
                # Missing numbers and booleans arrive as NaN.
                r = {c: None if isinstance(v, float) and v != v else v for c, v in zip(part, values, strict=True)}
                for row in run[r["kind"]](head, r):
                    out.append({"session_id": key[0], "seq": int(r["seq"]), **row})
                if len(out) >= FRAME:
                    yield self._frame(out)
                    out = []
        self._store(head)
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        kinds = {"seq": "int64", "taint_depth": "Int64", "since_last_egress": "Int64"}
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(c, object)) for c in _COLUMNS})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start a session where it stood (``initial_state``): counters, labels, sources, edges and
        the phases of its actions, so that a call open before a restart is known after it."""
        for r in initialState.to_dict("records"):
            held, edges, actions = (list(r[c]) if r[c] is not None else [] for c in (
                "sources", "edges", "actions"))
            self._load()
            for x in held:
                self.sources.put(x["artifact_id"], json.dumps({
                    "artifact_id": x["artifact_id"], "path": x["path"], "digest": x["digest"],
                    "labels": list(x["labels"])}, sort_keys=True))
            for x in edges:
                self._edge(x["output_id"], x["input_id"], x["via"])
            for x in actions:
                self.actions.put(x["action_id"], f"{x['dispatched']},{x['reported']}")
            self._store({
                "labels": list(r["labels"]), "depth": len(held), "touched": int(r["touched"]),
                "since": int(r["since_last_egress"]),
                "generation": int(r["compaction_generation"])})


def as_events(df: DataFrame) -> DataFrame:
    """Fill the columns of ``INPUT`` a source does not have with nulls, typed."""
    types = {"seq": "long", "labels": "array<string>", "refs": REFS, "result_bytes": "long",
             "edges": "array<array<string>>",
             **{c: "boolean" for c in ("classified", "is_egress", "is_write", "is_ledger",
                                       "is_own_binary", "success")}}
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(types.get(c, "string")).alias(c)
        for c in INPUT])


def session_stream(events: DataFrame, policies=None, initial_state: DataFrame | None = None,
                   protect_ledger: bool = True) -> DataFrame:
    """ST-01, ST-02, ST-04: the rows every session event produces, in one stateful operator."""
    enable(events.sparkSession)
    start = initial_state.groupBy("session_id") if initial_state is not None else None
    return as_events(events).groupBy("session_id").transformWithStateInPandas(
        SessionProcessor(policies, protect_ledger), OUTPUT, "Append", "None",
        initialState=start)


def initial_state(rollup: DataFrame, sources: DataFrame, edges: DataFrame | None = None,
                  actions: DataFrame | None = None) -> DataFrame:
    """T-04 output, or the tables of ``state_tables``, shaped for ``handleInitialState``: one row per
    session."""
    spark = rollup.sparkSession

    def gathered(df: DataFrame | None, name: str, fields: str) -> DataFrame:
        df = spark.createDataFrame([], f"session_id string, {fields}") if df is None else df
        return df.groupBy("session_id").agg(F.collect_list(F.struct(*[
            f.split()[0] for f in fields.split(", ")])).alias(name))

    out = rollup.select("session_id", "labels", "touched", "since_last_egress", "compaction_generation")
    held = sources.groupBy("session_id").agg(F.collect_list(
        F.struct("artifact_id", "path", "digest", "labels")).alias("sources"))
    for part in (held, gathered(edges, "edges", "output_id string, input_id string, via string"),
                 gathered(actions, "actions", "action_id string, dispatched long, reported long")):
        out = out.join(part, "session_id", "left")
    return out


def state_tables(spark: SparkSession, checkpoint: str) -> dict[str, DataFrame]:
    """The live state of a stopped or running session stream as tables: heads, sources, edges,
    actions. They have the columns of the batch tables (T-04, T-05), so T-07 and T-08 take them."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    def key(c: str = "user_map_key") -> list:
        return [F.col("key.session_id").alias("session_id"), *([F.col(c)] if c else [])]

    head = "labels array<string>, depth long, touched long, since long, generation long"
    heads = state("head").select(*key(""), F.from_json("value.body", head).alias("h")).select(
        "session_id", "h.labels", "h.depth", "h.touched", F.col("h.since").alias("since_last_egress"),
        F.col("h.generation").alias("compaction_generation"))
    ref = "artifact_id string, path string, digest string, labels array<string>"
    sources = state("sources").select(*key(""), F.from_json("user_map_value.ref", ref).alias("r")).select(
        "session_id", "r.*")
    way = F.from_json("user_map_key.way", "array<string>")
    edges = state("edges").select(*key(""), way.alias("w"), F.explode(F.from_json(
        "user_map_value.sources", "array<string>")).alias("input_id")).select(
        "session_id", F.get("w", F.lit(0)).alias("output_id"), "input_id", F.get("w", F.lit(1)).alias("via"))
    phases = F.split("user_map_value.phases", ",")
    actions = state("actions").select(*key(""), F.col("user_map_key.id").alias("action_id"),
                                      F.get(phases, F.lit(0)).cast("long").alias("dispatched"),
                                      F.get(phases, F.lit(1)).cast("long").alias("reported"))
    return {"heads": heads, "sources": sources, "edges": edges, "actions": actions}
