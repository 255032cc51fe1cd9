"""Policy decisions: compiled conditions, posture, downgrade, and replay of whole sessions."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import pointwise
from provlake.functions import text as T
from provlake.functions.rules import check_size, in_scope, strings, when_holds
from provlake.operators import artifacts as A
from provlake.vocab import Policy


# ── P-01 / P-02 ─────────────────────────────────────────────────────────────────────────────
def decide(df: DataFrame, action: Column, posture: Column, context: dict[str, Column],
           policies: list[Policy] | None = None) -> DataFrame:
    """P-02: adds outcome, determining_policy, reason, guidance, evaluated, counterfactual.

    Every policy becomes one CASE; the winner is an array_max.  No join and no shuffle.
    """
    policies = check_size(policies or vocab.POLICIES)
    for p in policies:
        if p.effect not in vocab.EFFECT_PRECEDENCE:
            raise ValueError(f"{p.id}: unknown effect {p.effect!r}")
    scopes = [in_scope(p, action, posture) for p in policies]
    entry = [F.struct(F.lit(vocab.EFFECT_PRECEDENCE[p.effect]).alias("prec"),
                      F.lit(p.priority).alias("priority"), F.lit(-i).alias("ord"),
                      F.lit(p.id).alias("id")) for i, p in enumerate(policies)]
    matches = F.array_compact(F.array(*[
        F.when(s & when_holds(p.when, context), e)
        for s, p, e in zip(scopes, policies, entry, strict=True)]))
    win = F.col("_win")
    over = F.col("_over")

    def of_winner(pick, default: str) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for p in policies:
            if pick(p):
                out = out.when(win["id"] == p.id, F.lit(pick(p)))
        return F.when(win.isNull(), F.lit(default)).otherwise(out.otherwise(F.lit("")))

    effect = F.element_at(F.array(F.lit("permit"), F.lit("ask"), F.lit("forbid")), win["prec"])
    return (df.withColumn("_m", matches)
            .withColumn("_win", F.array_max("_m"))
            .withColumn("_over", F.transform(
                F.filter("_m", lambda x: x["prec"] < F.col("_win")["prec"]), lambda x: x["id"]))
            .withColumns({
                "outcome": F.when(win["prec"] == 3, "deny").when(win["prec"] == 2, "ask")
                .when(win["prec"] == 1, "allow").otherwise("deny"),
                "determining_policy": F.coalesce(win["id"], F.lit(vocab.DEFAULT_DENY_ID)),
                "reason": of_winner(lambda p: p.reason, vocab.DEFAULT_DENY_REASON),
                "guidance": of_winner(lambda p: p.guidance, ""),
                "evaluated": strings(*[F.when(s, F.lit(p.id))
                                       for s, p in zip(scopes, policies, strict=True)]),
                "counterfactual": F.when(F.size(over) > 0, F.concat(
                    F.lit("would have been "), F.array_join(over, ", "), F.lit(" but "), effect,
                    F.lit(" overrides"))).otherwise("")})
            .drop("_m", "_win", "_over"))


# ── P-03 ────────────────────────────────────────────────────────────────────────────────────
MAX_CONFIG_BYTES = 16 << 20


def read_config(spark: SparkSession, directory: str, suffix: str) -> list[tuple[str, bytes]]:
    """The (stem, bytes) of configuration files in name order; refuses more than 16 MB."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
             .load(directory))
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > MAX_CONFIG_BYTES:
        raise ValueError(f"{directory} holds {total} bytes; policy and rule sets are small files")
    rows = [(r["path"].rsplit("/", 1)[-1], bytes(r["content"]))
            for r in files.select("path", "content").collect()]
    return [(name.removesuffix(suffix), blob) for name, blob in sorted(rows)]


def _parse(blob: bytes, suffix: str) -> dict:
    if suffix == ".json":
        return json.loads(blob) or {}
    try:
        import yaml
    except ImportError as exc:  # YAML is optional here; JSON files need nothing extra
        raise ValueError("reading YAML rule sets needs PyYAML; use .json files") from exc
    return yaml.safe_load(blob.decode()) or {}


def load_policies(spark: SparkSession, directory: str,
                  suffix: str = ".json") -> tuple[list[Policy], str]:
    """P-03: the policy set in file-name and declaration order, and its digest."""
    out: list[Policy] = []
    blobs = read_config(spark, directory, suffix)
    for stem, blob in blobs:
        for e in _parse(blob, suffix).get("policies", []):
            if e["effect"] not in vocab.EFFECT_PRECEDENCE:
                raise ValueError(f"{stem}: unknown effect {e['effect']!r}")
            out.append(Policy(f"{stem}#{e['id']}", e["effect"], e.get("when") or {},
                              e.get("reason", ""), tuple(e.get("actions", ())),
                              tuple(e.get("postures", ())), e.get("guidance", ""),
                              int(e.get("priority", 0))))
    return out, hashlib.sha256(b"".join(b for _, b in blobs)).hexdigest()


#: Sections of a rule file and the fields of their entries, with what a missing one stands for.
_RULE_FILE = {"rules": {"id": ..., "pattern": ..., "labels": ..., "reason": ""},
              "egress_patterns": {"id": ..., "pattern": ..., "labels": (), "reason": ""}}


def _entries(docs: list[dict], section: str, fields: dict) -> list[dict]:
    """The entries of one section of all files, in order; ``...`` marks a field that must be there."""
    out = []
    for e in (e for doc in docs for e in doc.get(section) or []):
        lacking = [f for f, v in fields.items() if v is ... and f not in e]
        if lacking:
            raise ValueError(f"{section} entry {e.get('id')!r} has no {', '.join(lacking)}")
        out.append({f: e.get(f, v) for f, v in fields.items()})
    return out


def load_rules(spark: SparkSession, directory: str, suffix: str = ".json"):
    """P-03: classification rules, egress rules and the rule set digest of one directory."""
    blobs = read_config(spark, directory, suffix)
    docs = [_parse(b, suffix) for _, b in blobs]
    found = [[vocab.Rule(e["id"], e["pattern"], tuple(e["labels"]), e["reason"]) for e in _entries(docs, s, f)]
             for s, f in _RULE_FILE.items()]
    return *found, hashlib.sha256(b"".join(b for _, b in blobs)).hexdigest()


def load_risk_rules(spark: SparkSession, directory: str, suffix: str = ".json") -> vocab.RiskRules:
    """U-01: risk rules, flag penalties, tiers, context multipliers and path sensitivity as data.

    Sections that no file has keep their published values; of several files a later one's section
    replaces an earlier one's.
    """
    doc: dict = {}
    for _, blob in read_config(spark, directory, suffix):
        doc |= _parse(blob, suffix)
    fields = {"rules": ("pattern", "intent", "base_score", "risk_category", "reason"),
              "flag_penalties": ("pattern", "penalty", "reason"),
              "fileset_sensitivity": ("pattern", "sensitivity", "reason"), "tiers": ("name", "max")}
    given = {s: tuple(tuple(e[f] for f in names) for e in _entries([doc], s, dict.fromkeys(names, ...)))
             for s, names in fields.items() if s in doc}
    return dataclasses.replace(vocab.PUBLISHED_RISK, **given, **(
        {"context_multipliers": dict(doc["context_multipliers"])} if "context_multipliers" in doc else {}))


def load_handlers(spark: SparkSession, directory: str, suffix: str = ".json") -> list[dict]:
    """U-03: the handlers of an index, in order, for ``artifacts.find_handler``.

    A bare script name lies in the index's folder, a relative path under the folder above it.
    """
    root = directory.rstrip("/")
    docs = [_parse(b, suffix) for _, b in read_config(spark, directory, suffix)]
    out = []
    for e in _entries(docs, "handlers", {"id": ..., "script": ..., "match": None, "reason": ""}):
        name, match = e["script"], e["match"] or {}
        base = "" if name.startswith("/") else (root.rsplit("/", 1)[0] if "/" in name else root) + "/"
        out.append({"id": e["id"], "script": base + name, "labels": list(match.get("labels") or []),
                    "pattern": match.get("pattern"), "reason": e["reason"]})
    return out


def set_digest(policies: list[Policy]) -> str:
    """Digest of an in-memory policy set (canonical JSON of its entries, in order)."""
    doc = [{"id": p.id, "effect": p.effect, "when": p.when, "reason": p.reason,
            "actions": list(p.actions), "postures": list(p.postures), "guidance": p.guidance,
            "priority": p.priority} for p in policies]
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()
                          ).hexdigest()


def policy_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    """P-03: the policy set as a dimension table."""
    return spark.createDataFrame(
        [(i, p.id, p.effect, json.dumps(p.when, sort_keys=True), p.reason, list(p.actions),
          list(p.postures), p.guidance, p.priority) for i, p in enumerate(policies)],
        "ord int, id string, effect string, when_json string, reason string, "
        "actions array<string>, postures array<string>, guidance string, priority int")


def pin_findings(loaded: DataFrame, pins: DataFrame) -> DataFrame:
    """P-03: (profile, digest) against (profile, expected_digest); decisions go on regardless."""
    detail = F.concat(F.lit("POLICY SET MISMATCH: loaded "), F.substring("digest", 1, 16),
                      F.lit(", pinned "), F.substring("expected_digest", 1, 16))
    return (loaded.join(pins, "profile", "left")
            .withColumn("mismatch", F.coalesce(
                (F.col("expected_digest") != "") & (F.col("expected_digest") != F.col("digest")),
                F.lit(False)))
            .withColumn("severity", F.when(F.col("mismatch"), "critical"))
            .withColumn("detail", F.when(F.col("mismatch"), detail)))


# ── P-04 / P-05 ─────────────────────────────────────────────────────────────────────────────
def _valid(c: Column) -> Column:
    return F.when(c.isin(*vocab.POSTURES), c)


def _weight(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in vocab.POSTURES]), c)


def resolve_posture(df: DataFrame) -> DataFrame:
    """P-04: project, profile, legacy; never weaker than the managed floor; default observe.

    Columns read: project_posture, profile_posture, legacy_posture, managed_posture.
    """
    floor = _valid(F.col("managed_posture"))
    layers = {"project config": _valid(F.col("project_posture")),
              "profile config": _valid(F.col("profile_posture")),
              "legacy state file": _valid(F.trim("legacy_posture"))}
    asked = F.coalesce(*layers.values())
    effective = (F.when(asked.isNull(), F.coalesce(floor, F.lit(vocab.DEFAULT_POSTURE)))
                 .when(floor.isNotNull() & (_weight(asked) < _weight(floor)), floor)
                 .otherwise(asked))
    proj, prof, legacy = layers.values()
    config = F.coalesce(proj, prof)
    source = (F.when(config.isNotNull() & floor.isNotNull() & (_weight(config) < _weight(floor)),
                     "managed policy")
              .when(proj.isNotNull(), "project config").when(prof.isNotNull(), "profile config")
              .when(legacy.isNotNull(), "legacy state file")
              .when(floor.isNotNull(), "managed policy").otherwise("default"))
    return df.withColumns({"effective_posture": effective, "posture_source": source})


def op_for(tool: Column, is_egress: Column) -> Column:
    """P-05: egress, else write, else read."""
    return (F.when(is_egress, "artifact.egress")
            .when(tool.isin(*vocab.WRITE_TOOLS), "artifact.write").otherwise("artifact.read"))


def downgrade(df: DataFrame, mode: str = "permission_mode") -> DataFrame:
    """P-05: an ask under a non-interrupting mode is allowed and says so; a deny never degrades."""
    hit = (F.col("outcome") == "ask") & F.coalesce(
        F.col(mode).isin(*vocab.NON_INTERRUPTING_MODES), F.lit(False))
    note = F.concat(F.lit("would have asked, but permission_mode="), F.col(mode), F.lit(
        " is a standing decision not to be interrupted; recorded as a warning instead"))
    return (df.withColumn("downgraded_from", F.when(hit, "ask"))
            .withColumn("counterfactual", F.when(hit, note).otherwise(F.col("counterfactual")))
            .withColumn("outcome", F.when(F.col("downgraded_from").isNotNull(), "allow")
                        .otherwise(F.col("outcome"))))


# ── P-06 ────────────────────────────────────────────────────────────────────────────────────
def _resolved(calls: DataFrame, found: Column, links: DataFrame, cwd: Column | None,
              home: Column | None, key: list[str]) -> DataFrame:
    """``calls`` with the real path of each mention, in mention order, under ``_real``."""
    rows = T.unnest(calls, found, [*key, *[c.alias(n) for n, c in (("_cwd", cwd), ("_home", home))
                                           if c is not None]], "path", "pos")
    at = A.canonicalise(rows, "path", links, F.col("_cwd") if cwd is not None else None,
                        F.col("_home") if home is not None else None)
    real = at.groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct("pos", "canonical_path"))).alias("_real"))
    return calls.join(real.withColumn("_real", F.col("_real.canonical_path")), key, "left")


def call_facts(calls: DataFrame, path_args: list[str] = ("file_path",),
               rules=None, egress_rules=None, tool_name: str = vocab.TOOL,
               links: DataFrame | None = None, cwd: Column | None = None, home: Column | None = None,
               key: tuple[str, ...] = ("session_id", "seq")) -> DataFrame:
    """The state-free part of a decision: mentioned paths, worst input, egress, op, flags, aliases.

    Both the given and the real spelling of a path are classified; ``aliases`` lists the mentions
    that only their real path classifies.  ``links(path, canonical_path)`` are followed by joins on
    the distinct mentions (``key`` identifies a call); a stream takes them as a map of checked
    size.  Without links paths stay an array inside the row, so nothing is shuffled.  Calls that
    touch no classified path and do not egress yield no row.
    """
    rules = check_size(rules or vocab.classify_rules())
    cmd = F.when(F.col("tool") == "Bash", F.coalesce("command", F.lit(""))).otherwise("")
    found = T.mentioned_paths(F.col("tool"), F.col("command"), [F.col(c) for c in path_args])
    follow = A.link_map(links) if links is not None and calls.isStreaming else None
    if links is not None and follow is None:
        calls = _resolved(calls, found, links, cwd, home, list(key))

    def real(p: Column, i: Column) -> Column:
        full = T.absolute_path(p, cwd, home)
        if follow is not None:
            return T.real_path(full, follow)
        return F.get("_real", i) if links is not None else T.lexical_path(full)

    def both(p: Column, c: Column) -> Column:
        own = A.path_labels(p, rules)
        return F.when(p == c, own).otherwise(F.array_sort(F.array_union(
            own, A.path_labels(c, rules))))

    spelled = F.transform(found, lambda p, i: F.struct(
        i.alias("pos"), p.alias("path"), real(p, i).alias("canonical_path")))
    hits = F.filter(spelled, lambda x: A.path_classified(x["path"], rules)
                    | A.path_classified(x["canonical_path"], rules))
    labelled = F.transform(hits, lambda x: F.struct(
        x["pos"].alias("pos"), x["path"].alias("path"),
        x["canonical_path"].alias("canonical_path"),
        both(x["path"], x["canonical_path"]).alias("labels")))
    gained = F.transform(
        F.filter(F.col("classified_inputs"), lambda x: (x["path"] != x["canonical_path"])
                 & ~A.path_classified(x["path"], rules)),
        lambda x: F.struct(x["path"].alias("given"), x["canonical_path"].alias("resolves_to"),
                           A.path_labels(x["canonical_path"], rules).alias("labels_gained")))
    ranked = F.transform(F.col("classified_inputs"), lambda x: F.struct(
        F.size(x["labels"]).alias("n"), (-x["pos"]).alias("ord"), x.alias("ref")))
    df = A.egress(calls.withColumn("_cmd", cmd), "_cmd", egress_rules)
    df = df.withColumn("classified_inputs", labelled).withColumn(
        "_worst", F.array_max(ranked)["ref"])
    canon = F.col("_worst")["canonical_path"]
    # A plain filter would be pushed down to the scan, before its rows are spread, and search every path twice.
    keep = F.when(F.col("_worst").isNotNull() | F.col("is_egress"), F.array(F.lit(True)))
    return (T.unnest(df, keep, ["*"], "_kept", "_at").drop("_kept", "_at")
            .withColumns({
                "op": op_for(F.col("tool"), F.col("is_egress")),
                "is_write": F.col("tool").isin(*vocab.WRITE_TOOLS),
                "is_own_binary": F.col("_cmd").contains(tool_name)
                & ~F.col("_cmd").contains("ledger"),
                "classified": F.col("_worst").isNotNull(),
                "canonical_path": canon,
                "labels": F.col("_worst")["labels"],
                "aliases": gained,
                "artifact_id": F.when(canon.isNotNull(), T.artifact_id(canon)),
                "is_ledger": F.coalesce(canon.contains(tool_name) & canon.contains("ledger"),
                                        F.lit(False))})
            .drop("_worst", "_cmd", "_real"))


def call_context(protect_ledger: bool = True) -> dict[str, Column]:
    """Policy context over the columns of ``call_facts`` and ``running_state``."""
    c = F.col
    return {"session.taint": c("taint"), "session.taint_depth": c("taint_depth"),
            "session.artifacts_touched": c("artifacts_touched"),
            "session.since_last_egress": c("since_last_egress"),
            "artifact.classified": c("classified"), "artifact.labels": c("labels"),
            "artifact.first_touch": c("classified") & c("first_touch"),
            "artifact.is_ledger": c("is_ledger"), "call.is_egress": c("is_egress"),
            "call.is_write": c("is_write"), "call.is_own_binary": c("is_own_binary"),
            "call.protect_ledger": F.lit(protect_ledger)}


_REPLAYED = ("session_id string, seq long, op string, artifact_id string, outcome string, "
             "determining_policy string, downgraded_from string, taint array<string>, "
             "taint_depth long, artifacts_touched long, since_last_egress long, first_touch boolean, "
             "state_digest string")
_START = hashlib.sha256(b"").hexdigest()


def replay(facts: DataFrame, policies: list[Policy] | None = None,
           protect_ledger: bool = True) -> DataFrame:
    """P-06: decide every call of every session, each seeing the outcomes before it.

    A call's decision needs the state that all earlier decisions of its session left, so the calls
    are sorted by (session, seq) and folded in one pass, whatever the policies and however long the
    session. Only narrow rows are sorted (ids, flags and labels, no paths or commands), and a task
    holds one session's labels, counters and touched ids. Sessions run in parallel; the streaming
    processor (ST-01) decides with the same function.  ``state_digest`` is a digest over all touches
    and resets before the call, each laid on the one before it.
    """
    policies = list(policies or vocab.POLICIES)
    given = ["session_id", "seq", "op", "posture", "permission_mode", "artifact_id", "labels",
             "classified", "is_egress", "is_write", "is_ledger", "is_own_binary"]
    made = [c.split()[0] for c in _REPLAYED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def after(digest: str, *change) -> str:
        return hashlib.sha256(json.dumps([digest, *change], separators=(",", ":")).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, head, held, digest = None, {}, set(), _START
        ready = pointwise.ready(policies)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not head or r["session_id"] != session:
                    session, held, digest = r["session_id"], set(), _START
                    head = {"labels": ["public"], "depth": 0, "touched": 0, "since": 0}
                has = r["artifact_id"] in held
                outcome, policy, was = pointwise.call(ready, protect_ledger, head, has, r)
                out.append((session, r["seq"], r["op"], r["artifact_id"], outcome, policy, was,
                            head["labels"], head["depth"], head["touched"], head["since"],
                            bool(r["classified"]) and not has, digest))
                if r["classified"] and outcome in ("allow", "ask"):
                    held.add(r["artifact_id"])
                    head = {"labels": pointwise.join(head["labels"], r["labels"]),
                            "depth": len(held), "touched": head["touched"] + 1,
                            "since": head["since"] + 1}
                    digest = after(digest, r["artifact_id"], sorted(r["labels"]))
                elif r["is_egress"] and not r["classified"] and outcome == "allow":
                    head = {**head, "since": 0}
                    digest = after(digest, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=made)

    return (facts.select(*given).repartition("session_id").sortWithinPartitions("session_id", "seq")
            .mapInArrow(run, _REPLAYED))


def decision_records(facts: DataFrame, decided: DataFrame, policy_set_digest: str, at: str = "at",
                     action_id: str = "action_id") -> DataFrame:
    """P-06: the custody record of every decision, as V-06 builds it, and its event for a ledger (L-04).

    ``decided`` is what ``replay`` returns for ``facts``.  The record carries the inputs, the state the
    decision saw and, among its known gaps, every alias and every input that was not digested.
    Adds ``statement``, ``strength``, ``problems`` and ``event``.  ``facts`` should be materialised: their
    columns are used here and by the replay.
    """
    from provlake.operators.validate import build_records

    c, none = F.col, F.array().cast("array<string>")
    own = facts.select("session_id", "seq", "tool", "posture", "permission_mode", "classified_inputs", "aliases",
                       "canonical_path", c(at).alias("at"), c(action_id).alias("_action"))
    df = decided.join(own, ["session_id", "seq"])
    action = F.coalesce("_action", F.concat_ws(":", "op", c("seq").cast("string")))
    gaps = F.concat(F.transform("aliases", lambda a: F.concat(
        F.lit("path aliasing: "), a["given"], F.lit(" resolves to "), a["resolves_to"], F.lit(" and gained "),
        F.array_join(a["labels_gained"], ","))), F.when(c("canonical_path").isNotNull(), F.array(F.lit(
            "artifact content was not digested at decision time"))).otherwise(none))
    df = df.withColumns({
        "recorded_at": c("at"), "record_id": F.concat_ws(":", F.lit("sg"), "session_id", action),
        "agent_id": F.concat(F.lit("session/"), "session_id", F.lit("/agent/main")), "runtime_action_id": action,
        "operator": F.struct(F.lit("replay").alias("identity")), "channel": F.lit("replay"),
        "method_kind": F.when(c("outcome") == "deny", "denied").otherwise("direct-model"),
        "input_digest": F.concat(F.lit("sha256:"), T.sha(F.to_json(F.struct("tool", "classified_inputs")))),
        "policy_set_digest": F.lit(policy_set_digest), "known_gaps": gaps, "alterations": none,
        "capability": F.struct(F.concat(F.lit("cap:"), "posture").alias("grant_id"),
                               c("determining_policy").alias("granted_by"), F.array("op").alias("scope")),
        "basis": F.struct(c("taint").alias("taint_labels"), "taint_depth", c("state_digest").alias("session_custody_digest")),
        "used": F.transform("classified_inputs", lambda x: F.struct(
            T.artifact_id(x["canonical_path"]).alias("artifact_id"), x["canonical_path"].alias("path"),
            x["path"].alias("requested_path"), x["labels"].alias("labels"))),
        "chain": F.struct(F.lit("sha256").alias("algo")), "isolation_tier": F.lit(0)})
    built = build_records(df, extra={"action.tool.name": c("tool"), "authority.permission_mode": c("permission_mode"),
                                     "decision.downgraded_from": c("downgraded_from")})
    event = F.to_json(F.struct(
        c("op"), c("at"), F.lit("replay").alias("actor"), c("session_id"), c("outcome"), c("known_gaps"), c("alterations"),
        F.when(c("outcome") == "deny", "warn").otherwise("info").alias("severity"),
        F.struct(action.alias("id"), F.lit("dispatch").alias("phase"), c("tool"), c("outcome")).alias("action_instance"),
        F.parse_json("statement").alias("statement")))
    return built.withColumn("event", event).drop("_action")
