"""Provenance exports: gate, PROV relations, CASE/UCO graph, OTLP spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import __version__, vocab
from provlake.functions import text as T
from provlake.operators.taint import DERIVED
from provlake.operators.validate import predicate_of

REFS = ("array<struct<artifact_id:string,path:string,digest:string,labels:array<string>,"
        "role:string>>")


#: JSON text of objects whose members are plain strings, or label lists of them: a cast of the variant
#: gives for these what a JSON parser gives, at a fraction of its time.
_PLAIN_REFS = (r'^\[(\{(("(artifact_id|path|digest|role|generated|source|via)":"[^"\\]*"'
               r'|"labels":\[("[^"\\]*",?)*\]),?)*\},?)*\]$')


# ── X-01 ────────────────────────────────────────────────────────────────────────────────────
def gate(records: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X-01: (records of usable ledgers, refused ledgers with reason)."""
    refused = usable.where(~F.col("usable")).select("ledger_id", "reason")
    return records.join(refused.select("ledger_id"), "ledger_id", "left_anti"), refused


def export_view(df: DataFrame, body: str = "body") -> DataFrame:
    """The columns the exporters read, from a record of any accepted shape."""
    p, r = F.col("_p"), F.col(body)
    lists = ("used", "generated", "derived_from")
    member = lambda b, path: F.try_variant_get(b, f"$.{path}", "variant")
    # Each step is a projection of its own: what it adds is worked out once a row.
    df = df.withColumn("_p", predicate_of(r)).withColumn("_bare", T.is_falsy(T.json_at(p, "resources")))
    df = df.withColumns({f"_{n}": F.coalesce(member(p, f"resources.{n}"), F.when(
        F.col("_bare"), member(r, f"resources.{n}"))) for n in lists})
    df = df.withColumns({f"_{n}_json": F.to_json(f"_{n}") for n in lists})
    s = lambda path: T.string_at(p, path)
    j = lambda path: T.json_at(p, path)
    some = lambda c: F.when(c != "", c)

    def refs(name: str, kind: str) -> Column:
        json = F.col(f"_{name}_json")
        return F.coalesce(F.when(json.rlike(_PLAIN_REFS), F.try_variant_get(f"_{name}", "$", kind)).otherwise(
            F.from_json(json, kind)), F.array().cast(kind))

    return df.select(
        "ledger_id", "seq", *[c for c in ("hash", "at") if c in df.columns],
        F.coalesce(some(s("record.id")), F.concat(F.lit("seq-"), F.col("seq").cast("string"))
                   ).alias("record_id"),
        F.coalesce(some(s("action.started_at")), s("record.at")).alias("start_at"),
        s("action.started_at").alias("started_at"), s("action.ended_at").alias("ended_at"),
        s("record.at").alias("record_at"),
        F.coalesce(some(s("action.op")), T.string_at(r, "op")).alias("op"),
        F.coalesce(some(s("decision.outcome")), T.string_at(r, "outcome")).alias("outcome"),
        s("decision.outcome").alias("decided"), s("action.op").alias("acted"),
        s("policy.determining_policy").alias("policy"), s("actor.agent_id").alias("agent_id"),
        s("actor.agent_type").alias("agent_type"), s("actor.operator.identity").alias("operator"),
        s("actor.runtime_action_id").alias("call_id"),
        some(s("actor.acted_on_behalf_of.human_id")).alias("human_id"),
        s("actor.acted_on_behalf_of.prompt_id").alias("prompt_id"),
        s("authority.posture").alias("posture"), j("authority.capability").alias("capability"),
        F.coalesce(j("alterations"), F.lit("[]")).alias("alterations"),
        s("action.method.kind").alias("method"), s("action.method.script.path").alias("script"),
        s("action.tool.name").alias("tool"),
        s("action.gen_ai.operation_name").alias("operation"),
        s("action.gen_ai.tool_name").alias("gen_tool"),
        s("action.gen_ai.tool_type").alias("tool_type"),
        s("action.gen_ai.tool_call_id").alias("gen_call"),
        s("lifecycle.session_id").alias("session_id"),
        s("lifecycle.transcript_digest").alias("transcript"),
        F.coalesce(F.from_json(j("decision.basis.taint_labels"), "array<string>"),
                   F.array().cast("array<string>")).alias("taint_labels"),
        F.try_variant_get(p, "$.decision.basis.taint_depth", "long").alias("taint_depth"),
        s("decision.basis.session_custody_digest").alias("custody_digest"),
        s("verification.strength").alias("strength"),
        F.try_variant_get(p, "$.verification.recorder.isolation_tier", "long").alias("tier"),
        refs("used", REFS).alias("used"), refs("generated", REFS).alias("generated"),
        refs("derived_from", DERIVED).alias("derived_from"))


# ── X-02 ────────────────────────────────────────────────────────────────────────────────────
def _id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(vocab.PROV_PREFIX[kind]), c)


def prov(records: DataFrame) -> dict[str, DataFrame]:
    """X-02: one table per PROV relation, per ledger; of repeated ids the last one counts."""
    act = _id("activity", F.col("record_id"))
    agent = _id("agent", F.coalesce(F.when(F.col("agent_id") != "", F.col("agent_id")),
                                    F.lit("unknown")))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    base = records.withColumns({"activity": act, "agent": agent})

    def refs(name: str, side: int) -> DataFrame:
        return T.unnest(base, F.col(name), ["ledger_id", "seq", "activity",
                                            F.lit(side).alias("side")], "r", "ord").select(
            "ledger_id", "seq", "activity", "side", "ord",
            _id("entity", unknown(F.col("r.artifact_id"))).alias("entity"),
            F.col("r.path").alias("path"), F.col("r.digest").alias("digest"),
            F.coalesce("r.labels", F.array().cast("array<string>")).alias("classification"),
            F.coalesce("r.role", F.lit("input")).alias("role"))

    used, made = refs("used", 0), refs("generated", 1)
    pos = F.struct("seq", "side", "ord")
    entity = used.unionByName(made).groupBy("ledger_id", "entity").agg(
        F.max_by(F.struct("path", "digest", "classification"), pos).alias("e")).select(
        "ledger_id", "entity", "e.*")
    activity = base.groupBy("ledger_id", "activity").agg(F.max_by(F.struct(
        F.col("start_at").alias("start_time"), "op", "outcome",
        F.col("policy").alias("determining_policy")), "seq").alias("a")).select(
        "ledger_id", "activity", "a.*")
    software = base.groupBy("ledger_id", "agent").agg(
        F.max_by("agent_type", "seq").alias("agent_type"),
        F.lit("prov:SoftwareAgent").alias("type"))
    behalf = base.where("human_id IS NOT NULL")
    person = behalf.select("ledger_id", _id("person", F.col("human_id")).alias("agent")
                           ).distinct().select(
        "ledger_id", "agent", F.lit(None).cast("string").alias("agent_type"),
        F.lit("prov:Person").alias("type"))
    derived = T.unnest(base, F.col("derived_from"), ["ledger_id", "seq", "activity"], "d")
    return {
        "entity": entity, "activity": activity, "agent": software.unionByName(person),
        "used": used.select("ledger_id", "seq", "activity", "entity", "role"),
        "wasGeneratedBy": made.select("ledger_id", "seq", "activity", "entity"),
        "wasDerivedFrom": derived.select(
            "ledger_id", "seq", "activity",
            _id("entity", unknown(F.col("d.generated"))).alias("generated"),
            _id("entity", unknown(F.col("d.source"))).alias("source"), F.col("d.via").alias("via")),
        "wasAssociatedWith": base.select("ledger_id", "seq", "activity", "agent"),
        "actedOnBehalfOf": behalf.select(
            "ledger_id", "seq", "activity", F.col("agent").alias("delegate"),
            _id("person", F.col("human_id")).alias("responsible"), "prompt_id")}


def prov_relations(records: DataFrame) -> DataFrame:
    """X-02: all PROV relations in one pass: ledger_id, seq, relation, subject, object.

    Each record yields an array of its relations, so the records are read and parsed once.
    """
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    act = _id("activity", F.col("record_id"))
    agent = _id("agent", unknown(F.when(F.col("agent_id") != "", F.col("agent_id"))))
    person = _id("person", F.col("human_id"))

    def one(name: str, subject: Column, target: Column) -> Column:
        return F.struct(F.lit(name).alias("relation"), subject.alias("subject"),
                        target.alias("object"))

    def of(name: str, c: str) -> Column:
        return F.transform(c, lambda r: one(name, act, _id("entity", unknown(r["artifact_id"]))))

    derived = F.transform("derived_from", lambda d: one(
        "wasDerivedFrom", _id("entity", unknown(d["generated"])), _id("entity", unknown(d["source"]))))
    behalf = F.when(F.col("human_id").isNotNull(), F.array(
        one("actedOnBehalfOf", agent, person))).otherwise(F.array().cast(
            "array<struct<relation:string,subject:string,object:string>>"))
    return records.select("ledger_id", "seq", F.inline(F.concat(
        of("used", "used"), of("wasGeneratedBy", "generated"),
        F.array(one("wasAssociatedWith", act, agent)), behalf, derived)))


# ── X-03 ────────────────────────────────────────────────────────────────────────────────────
def _node(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]), {"ignoreNullFields": "false"})


#: What ``case_graph`` reads of the export view.
CASE_COLUMNS = ("ledger_id", "seq", "record_id", "record_at", "op", "agent_id", "operator", "human_id", "posture",
                "capability", "alterations", "method", "script", "tool", "used", "generated")


def case_graph(records: DataFrame) -> DataFrame:
    """X-03: JSON-LD nodes: custody and evidence per record, artifacts on first sight per ledger.

    ``records`` are read twice, for the records' own nodes and for the artifacts': materialise them
    (``CASE_COLUMNS``) where they are dear to make.
    """
    lit = F.lit
    kb = lambda kind, c: F.concat(lit(f"kb:{kind}-"), c)
    rid = F.col("record_id")
    ids = lambda name: F.transform(name, lambda u: F.struct(kb(
        "artifact", F.coalesce(u["artifact_id"], lit("None"))).alias("@id")))
    custody = F.struct("seq", kb("custody", rid).alias("id"), lit("custody").alias("chain"), _node(
        ("@id", kb("custody", rid)), ("@type", lit("uco-action:Action")),
        ("uco-core:name", lit("custody-transfer")), ("sg:chain", lit("custody")),
        ("uco-action:startTime", F.col("record_at")),
        ("uco-action:performer", F.struct(
            kb("agent", F.coalesce("agent_id", lit("unknown"))).alias("@id"),
            lit("uco-identity:Identity").alias("@type"), F.col("operator").alias("sg:operator"),
            F.col("human_id").alias("sg:actedOnBehalfOf"))),
        ("sg:authority", F.struct("posture", F.parse_json("capability").alias("capability"))),
        ("sg:alterations", F.parse_json("alterations"))).alias("node"))
    evidence = F.struct("seq", kb("evidence", rid).alias("id"), lit("evidence").alias("chain"), _node(
        ("@id", kb("evidence", rid)), ("@type", lit("uco-action:Action")),
        ("uco-core:name", F.col("op")), ("sg:chain", lit("evidence")),
        ("sg:method", F.col("method")), ("sg:tool", F.col("tool")),
        ("sg:script", F.col("script")), ("uco-action:object", ids("used")),
        ("uco-action:result", ids("generated"))).alias("node"))
    seen = T.unnest(records, F.concat("used", "generated"), ["ledger_id", "seq"], "r", "ord"
                    ).where(F.coalesce("r.artifact_id", lit("")) != "")
    first = seen.groupBy("ledger_id", F.col("r.artifact_id").alias("artifact_id")).agg(
        F.min_by("r", F.struct("seq", "ord")).alias("r"), F.min("seq").alias("seq"))
    file_facet = F.to_json(F.struct(lit("uco-observable:FileFacet").alias("@type"), F.col(
        "r.path").alias("uco-observable:filePath")), {"ignoreNullFields": "false"})
    hash_facet = F.when(F.coalesce("r.digest", lit("")) != "", F.to_json(F.struct(
        lit("uco-observable:ContentDataFacet").alias("@type"), F.array(F.struct(
            lit("uco-core:Hash").alias("@type"), lit("SHA256").alias("uco-core:hashMethod"),
            F.regexp_replace("r.digest", "^sha256:", "").alias("uco-core:hashValue"))
        ).alias("uco-observable:hash"))))
    artifact = first.select(
        "ledger_id", "seq", kb("artifact", F.col("artifact_id")).alias("id"),
        lit("artifact").alias("chain"), _node(
            ("@id", kb("artifact", F.col("artifact_id"))),
            ("@type", lit("uco-observable:ObservableObject")),
            ("sg:classification", F.coalesce("r.labels", F.array().cast("array<string>"))),
            ("uco-core:hasFacet", F.parse_json(F.concat(
                lit("["), F.concat_ws(",", file_facet, hash_facet), lit("]"))))).alias("node"))
    return records.select("ledger_id", F.inline(F.array(custody, evidence))).unionByName(artifact)


# ── X-04 ────────────────────────────────────────────────────────────────────────────────────
def _text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.to_json(F.struct(c.cast("string").alias("stringValue"))))


def _int(c: Column) -> Column:
    return F.when(c.isNotNull(), F.to_json(F.struct(c.cast("string").alias("intValue"))))


def _list(c: Column) -> Column:
    values = F.transform(F.array_compact(c), lambda x: F.struct(x.alias("stringValue")))
    return F.to_json(F.struct(F.struct(values.alias("values")).alias("arrayValue")))


def spans(records: DataFrame) -> DataFrame:
    """X-04: one OTLP span per record, attributes as (key, typed JSON value), nulls dropped.

    Status and the name's fallback follow the nested decision and operation, not the flat mirrors.
    """
    c = F.col
    ns = vocab.SPAN_NS
    ids = lambda n: F.transform(n, lambda u: u["artifact_id"])
    tool = F.coalesce(F.when(c("gen_tool") != "", c("gen_tool")), c("tool"))
    digest = c("hash") if "hash" in records.columns else F.lit(None).cast("string")
    at = c("at") if "at" in records.columns else F.lit(None).cast("string")
    attrs = [
        ("gen_ai.operation.name", _text(F.coalesce("operation", F.lit("execute_tool")))),
        ("gen_ai.tool.name", _text(tool)),
        ("gen_ai.tool.type", _text(F.coalesce("tool_type", F.lit("function")))),
        ("gen_ai.tool.call.id", _text(F.coalesce(F.when(c("gen_call") != "", c("gen_call")),
                                                 c("call_id")))),
        ("gen_ai.agent.id", _text(c("agent_id"))),
        ("gen_ai.conversation.id", _text(c("session_id"))),
        (f"{ns}.op", _text(c("op"))), (f"{ns}.posture", _text(c("posture"))),
        (f"{ns}.decision.outcome", _text(c("outcome"))),
        (f"{ns}.decision.policy", _text(c("policy"))),
        (f"{ns}.taint.labels", _list(c("taint_labels"))),
        (f"{ns}.taint.depth", _int(c("taint_depth"))),
        (f"{ns}.custody.digest", _text(c("custody_digest"))),
        (f"{ns}.artifacts.used", _list(ids("used"))),
        (f"{ns}.artifacts.generated", _list(ids("generated"))),
        (f"{ns}.derivation.edges", _list(F.transform("derived_from", lambda d: F.concat(
            F.coalesce(d["generated"], F.lit("None")), F.lit("<-"),
            F.coalesce(d["source"], F.lit("None")))))),
        (f"{ns}.verification.strength", _text(c("strength"))),
        (f"{ns}.verification.isolation_tier", _int(c("tier"))),
        (f"{ns}.record.seq", _int(c("seq"))), (f"{ns}.record.hash", _text(digest))]
    start = T.unix_nanos(F.coalesce(F.when(c("started_at") != "", c("started_at")), at))
    end = T.unix_nanos(F.coalesce(F.when(c("ended_at") != "", c("ended_at")), at))
    seed = F.coalesce(F.when(c("transcript") != "", c("transcript")),
                      F.when(c("session_id") != "", c("session_id")), digest)
    return records.select(
        "ledger_id", "seq", T.hex_id(seed, 32).alias("trace_id"),
        T.hex_id(F.coalesce(digest, c("seq").cast("string")), 16).alias("span_id"),
        F.coalesce(F.when(tool != "", tool), F.when(c("acted") != "", c("acted")),
                   F.lit("custody")).alias("name"),
        F.lit(vocab.SPAN_KIND_INTERNAL).alias("kind"), start.alias("start_unix_nano"),
        F.when(end == 0, start).otherwise(end).alias("end_unix_nano"),
        F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in attrs]),
                 lambda x: x["value"].isNotNull()).alias("attributes"),
        F.when(c("decided") == "deny", vocab.STATUS_ERROR).otherwise(vocab.STATUS_OK
                                                                     ).alias("status_code"))


def write_otlp(spans_df: DataFrame, path: str, service: str = vocab.TOOL,
               per_file: int = 10_000) -> None:
    """One OTLP envelope per line and at most ``per_file`` spans in each, grouped by ledger.

    Spans are spread by a hash of their id, so a hot ledger fills many envelopes instead of one.
    """
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", "kind",
        F.col("start_unix_nano").cast("string").alias("startTimeUnixNano"),
        F.col("end_unix_nano").cast("string").alias("endTimeUnixNano"),
        F.transform("attributes", lambda a: F.struct(
            a["key"].alias("key"), F.parse_json(a["value"]).alias("value"))).alias("attributes"),
        F.struct(F.col("status_code").alias("code")).alias("status"))
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(
        F.lit(v).alias("stringValue")).alias("value"))
    bucket = F.floor(F.col("seq") / per_file).alias("_b")
    grouped = spans_df.groupBy("ledger_id", bucket).agg(F.collect_list(span).alias("spans"))
    line = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.array(attr("service.name", service), attr("service.version", __version__),
                         attr("telemetry.sdk.name", service),
                         attr("telemetry.sdk.language", "python")).alias("attributes")
                 ).alias("resource"),
        F.array(F.struct(F.struct(F.lit("provlake.export").alias("name"), F.lit(
            __version__).alias("version")).alias("scope"), "spans")).alias("scopeSpans"))
    ).alias("resourceSpans")))
    grouped.select(line.alias("value")).write.mode("append").text(path)
