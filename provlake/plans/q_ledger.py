"""Registered queries: ledger integrity, validation, reconciliation."""

from pyspark.sql import functions as F

from provlake import vocab
from provlake.operators import integrity as G
from provlake.operators import reconcile as R
from provlake.operators import validate as V
from provlake.plans.registry import query
from provlake.session import cut_lineage, scratch_path
from provlake.sources import ledger as S
from provlake.sources.tables import duck, view

# The chain itself, one link per step for all ledgers at once.
DUCK_CHAIN = """fx_ev AS MATERIALIZED (SELECT ledger_id, event, event_id,
        row_number() OVER (PARTITION BY ledger_id ORDER BY event_id) - 1 AS n FROM fx_event),
fx_link AS (
    SELECT ledger_id, -1::bigint AS n, repeat('0', 64) AS hash, NULL::varchar AS prev, NULL::varchar AS material
    FROM (SELECT DISTINCT ledger_id FROM fx_ev)
    UNION ALL
    SELECT ledger_id, n, sha256(material), prev, material FROM (
        SELECT e.ledger_id, e.n, l.hash AS prev, replace(replace(e.event, '"known_gaps"',
            '"hash_alg":"sha256","keyid":null,"known_gaps"'), '"session_id"',
            concat('"prev_hash":"', l.hash, '","seq":', e.n, ',"session_id"')) AS material
        FROM fx_link l JOIN fx_ev e ON e.ledger_id = l.ledger_id AND e.n = l.n + 1)),
fx_chain AS (SELECT ledger_id, n AS seq, prev AS prev_hash, hash,
    replace(material, '"hash_alg"', concat('"hash":"', hash, '","hash_alg"')) AS raw
    FROM fx_link WHERE n >= 0)"""


def chain(spark, sf):
    """All events chained per ledger."""
    ev = view(spark, sf, "fx_event").select("ledger_id", F.col("event_id").alias("ord"), "event")
    accepted, _ = S.admit(ev)
    # Built once, read by both sides of the verification.
    return cut_lineage(S.append(accepted))


def intact(spark, sf):
    return S.parse(chain(spark, sf).select("ledger_id", F.col("seq").alias("idx"), "raw"))


def planted(spark, sf, c=None):
    """The chain (``c`` where it is at hand) after tampering: an edit, a removal, a rewired link and a missing field."""
    c = (chain(spark, sf) if c is None else c).where("NOT (ledger_id = 'L2' AND seq = 30)")
    at = (lambda led, s: (F.col("ledger_id") == led) & (F.col("seq") == s))
    raw = F.when(at("L1", 50), F.replace(F.col("raw"), F.lit('"k='), F.lit('"K='))).when(
        at("L3", 70), F.regexp_replace("raw", '"prev_hash":"[0-9a-f]{8}', '"prev_hash":"00000000')
    ).when(at("L4", 40), F.replace(F.col("raw"), F.lit('"hash_alg":"sha256",'), F.lit(""))
           ).otherwise(F.col("raw"))
    idx = F.when((F.col("ledger_id") == "L2") & (F.col("seq") > 30), F.col("seq") - 1).otherwise(
        F.col("seq"))
    return S.parse(c.select("ledger_id", idx.alias("idx"), raw.alias("raw")))


_VERDICT = """SELECT ledger_id, count(*) - CASE WHEN ledger_id = 'L2' THEN 1 ELSE 0 END AS records,
    CASE ledger_id WHEN 'L1' THEN 50 WHEN 'L2' THEN 30 WHEN 'L3' THEN 70 WHEN 'L4' THEN 40 END AS broken_at,
    CASE ledger_id WHEN 'L1' THEN 'entry 50 content does not match its own hash — it was edited in place'
        WHEN 'L2' THEN 'entry 30 carries seq 31 — entries were reordered or removed'
        WHEN 'L3' THEN 'entry 70 does not chain to its predecessor — an entry was altered or removed'
        WHEN 'L4' THEN 'entry 40 is missing ''hash_alg''' END AS reason
    FROM fx_call GROUP BY ledger_id"""


@query("l_01_scan", duck(["fx_call"], """
    SELECT ledger_id, count(*) + CASE WHEN ledger_id = 'L7' THEN 1 ELSE 0 END AS line_count,
        CASE WHEN ledger_id = 'L5' THEN 61 END AS malformed_at,
        CASE WHEN ledger_id = 'L3' THEN 41 END AS decode_error_at, false AS truncated,
        CASE ledger_id WHEN 'L5' THEN 60 WHEN 'L3' THEN 40 ELSE count(*) END AS entries
    FROM fx_call GROUP BY ledger_id"""))
def scan(spark, sf):
    c = chain(spark, sf)
    at = (lambda led, s: (F.col("ledger_id") == led) & (F.col("seq") == s))
    raw = F.when(at("L3", 40), F.unhex(F.lit("7BFF7D")).cast("string")).when(
        at("L5", 60), "{broken").when(at("L7", 10), F.concat("raw", F.lit("\n"))).otherwise(
        F.col("raw"))
    path = scratch_path(spark, "ledger")
    S.write_jsonl(c.withColumn("raw", raw), path)
    lines = S.scan(spark, path)
    damaged = S.damage(lines)
    n = S.entries(lines, damaged).groupBy("ledger_id").agg(F.count(F.lit(1)).alias("entries"))
    return damaged.join(n, "ledger_id").select("ledger_id", "line_count", "malformed_at",
                                               "decode_error_at", "truncated", "entries")


@query("l_02_verify", duck(["fx_call"], f"""
    SELECT ledger_id, broken_at IS NULL AS intact, broken_at, reason,
        coalesce(broken_at, records) AS checked, false AS verified_keyed FROM ({_VERDICT})"""))
def verify(spark, sf):
    return G.verify(planted(spark, sf)).drop("records")


@query("l_03_record_hash", duck(["fx_event"], """
    SELECT ledger_id, seq, hash, sha256(replace(raw, concat('"hash":"', hash, '",'), '')) AS recomputed
    FROM fx_chain""", DUCK_CHAIN, recursive=True))
def record_hash(spark, sf):
    return S.record_hash(intact(spark, sf)).select("ledger_id", "seq", "hash", "recomputed")


@query("l_04_append", duck(["fx_event"], "SELECT ledger_id, seq, prev_hash, hash FROM fx_chain",
                           DUCK_CHAIN, recursive=True))
def append(spark, sf):
    return chain(spark, sf).select("ledger_id", "seq", "prev_hash", "hash")


@query("l_05_admission", duck(["fx_call"], """
    SELECT ledger_id, CASE
        WHEN ledger_id IN ('L0', 'L1') THEN 'refusing to append without its chain key: this ledger is keyed'
        WHEN ledger_id = 'L2' THEN 'KEY MISMATCH, not tampering: written under k1, k2, supplied k9'
        END AS refusal FROM (SELECT DISTINCT ledger_id FROM fx_call)"""))
def admission(spark, sf):
    led = F.col("ledger_id")
    keyed = led.isin("L0", "L1", "L2", "L3")
    e = view(spark, sf, "fx_call").select(
        "ledger_id", F.when(keyed, vocab.ALGO_KEYED).otherwise(vocab.ALGO_UNKEYED).alias("hash_alg"),
        F.when(keyed, F.when((led == "L2") & (F.col("k") > 50), "k2").otherwise("k1")).alias("keyid"))
    registry = e.select("ledger_id").distinct().where(~led.isin("L0")).select(
        "ledger_id", F.when(led == "L2", "k9").when(led.isin("L3", "L4"), "k1").alias("keyid"))
    return G.admission(e, registry).select("ledger_id", "refusal")


def _seals(spark, c):
    """Seals of the intact ledgers of a chain as one series, over files written by Spark."""
    path = scratch_path(spark, "segments")
    S.write_jsonl(c, path)
    files = S.file_digests(spark, path).select(
        F.regexp_extract("file", r"ledger_id=([^/]+)", 1).alias("path"), "file_digest")
    e = S.parse(c.select("ledger_id", F.col("seq").alias("idx"), "raw"))
    seg = G.segment_facts(e).select(
        F.lit("all").alias("series"), F.substring("ledger_id", 2, 9).cast("long").alias("index"),
        F.col("ledger_id").alias("path"), "records", "first_seq", "last_seq", "head_hash")
    # Few rows, read several times: the files are digested once.
    return cut_lineage(G.seal(seg, files, "2024-01-01T00:00:00.000Z"))


_SEAL_ORACLE = DUCK_CHAIN + """, fx_seg AS MATERIALIZED (SELECT ledger_id,
        cast(substr(ledger_id, 2) AS bigint) AS i, count(*) AS records, max(seq) AS last_seq,
        arg_max(hash, seq) AS head,
        sha256(concat(string_agg(raw, chr(10) ORDER BY seq), chr(10))) AS fd
    FROM fx_chain GROUP BY ledger_id),
fx_seal AS (
    SELECT -1::bigint AS i, NULL::varchar AS path, repeat('0', 64) AS digest, NULL::varchar AS prev,
        NULL::varchar AS fd, NULL::bigint AS records
    UNION ALL
    SELECT s.i, s.ledger_id, sha256(concat('{"file_digest":"', s.fd, '","first_seq":0,"head_hash":"', s.head,
        '","keyid":null,"last_seq":', s.last_seq, ',"mac":null,"path":"', s.ledger_id,
        '","prev_seal_digest":"', p.digest, '","records":', s.records,
        ',"sealed_at":"2024-01-01T00:00:00.000Z","segment":"seg-', lpad(cast(s.i AS varchar), 6, '0'),
        '"}')), p.digest, s.fd, s.records
    FROM fx_seal p JOIN fx_seg s ON s.i = p.i + 1)"""


@query("l_06_seal", duck(["fx_event"], """
    SELECT path, records, fd AS file_digest, prev AS prev_seal_digest, digest AS seal_digest
    FROM fx_seal WHERE i >= 0""", _SEAL_ORACLE, recursive=True))
def seal(spark, sf):
    return _seals(spark, chain(spark, sf)).select("path", "records", "file_digest", "prev_seal_digest",
                                    "seal_digest")


def _sealed(spark, sf):
    """Seals against the tampered ledgers, one seal missing and one linked elsewhere, and the seals as they were."""
    c = chain(spark, sf)
    honest = _seals(spark, c)
    seals = honest.where("path <> 'L6'").withColumn(
        "prev_seal_digest", F.when(F.col("path") == "L5", F.lit(vocab.GENESIS)).otherwise(
            F.col("prev_seal_digest")))
    p = planted(spark, sf, c)
    now = seals.select("path", F.when(F.col("path").isin("L1", "L2", "L3", "L4"), "changed")
                       .otherwise(F.col("file_digest")).alias("digest_now"))
    facts = G.verify(p).join(G.heads(p).select("ledger_id", "next_seq", "head"), "ledger_id")
    seg = facts.select(
        F.lit("all").alias("series"), F.substring("ledger_id", 2, 9).cast("long").alias("index"),
        F.col("ledger_id").alias("path"), "intact", "broken_at", "reason",
        F.col("next_seq").alias("n_entries"), F.col("head").alias("last_hash")
    ).join(now, "path", "left")
    return G.verify_sealed(seg, seals), honest


@query("l_07_verify_sealed", duck(["fx_call"], """
    SELECT ledger_id AS path, CASE ledger_id WHEN 'L6' THEN 1 WHEN 'L1' THEN 3 WHEN 'L2' THEN 4
        WHEN 'L3' THEN 3 WHEN 'L4' THEN 3 ELSE 1 END AS findings,
        CASE WHEN ledger_id = 'L6' THEN 'no seal beside L6'
            ELSE 'seal carries no MAC — it is unauthenticated and can be rewritten' END AS first_finding
    FROM (SELECT DISTINCT ledger_id FROM fx_call)"""))
def verify_sealed(spark, sf):
    return _sealed(spark, sf)[0].select("path", F.size("findings").cast("long").alias("findings"),
                                     F.col("findings")[0].alias("first_finding"))


@query("l_08_verify_series", duck(["fx_call"], """
    SELECT ledger_id AS path, ledger_id IN ('L0', 'L5', 'L7') AS ok, CASE
        WHEN ledger_id IN ('L0', 'L7') THEN 0 WHEN ledger_id IN ('L5', 'L6') THEN 1
        WHEN ledger_id = 'L2' THEN 3 ELSE 2 END AS findings
    FROM (SELECT DISTINCT ledger_id FROM fx_call)"""))
def verify_series(spark, sf):
    # Unauthenticated seals always have a finding; here the MAC is left out of the verdict.
    checked, honest = _sealed(spark, sf)
    checked = checked.withColumn("findings", F.filter(
        "findings", lambda x: ~x.startswith("seal carries no MAC"))).withColumn(
        "ok", F.size("findings") == 0)
    honest = honest.select("path", F.col("seal_digest").alias("_d"))
    linked = checked.join(honest, "path", "left")
    # L7 follows L5 (L6 has no seal) once its seal names L5's digest.
    five = linked.where("path = 'L5'").select(F.lit("L7").alias("path"),
                                              F.col("seal_digest").alias("_five"))
    linked = linked.join(five, "path", "left").withColumn("seal", F.col("seal").withField(
        "prev_seal_digest", F.coalesce("_five", F.col("seal.prev_seal_digest"))))
    return G.verify_series(linked).select(
        "path", "ok", F.size("series_findings").cast("long").alias("findings"))


@query("l_09_heads", duck(["fx_event"], """
    SELECT ledger_id, arg_max(hash, seq) AS head, count(*) AS next_seq FROM fx_chain
    GROUP BY ledger_id""", DUCK_CHAIN, recursive=True))
def heads(spark, sf):
    return G.heads(intact(spark, sf)).select("ledger_id", "head", "next_seq")


@query("l_10_tail", duck(["fx_event"], """
    SELECT ledger_id, seq, hash FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id
        ORDER BY seq DESC) AS rn FROM fx_chain) WHERE rn <= 20""", DUCK_CHAIN, recursive=True))
def tail(spark, sf):
    return G.tail(intact(spark, sf), 20).select("ledger_id", "seq", "hash")


@query("l_04_append_twice", duck(["fx_event"], """
    SELECT ledger_id, count(*) AS records, true AS intact, false AS truncated, arg_max(hash, seq) AS head
    FROM fx_chain GROUP BY ledger_id UNION ALL SELECT 'empty', 0, true, false, repeat('0', 64)""",
                                 DUCK_CHAIN, recursive=True))
def append_twice(spark, sf):
    """Half of each ledger, then the rest onto its head, beside an empty ledger; read back."""
    path = scratch_path(spark, "twice")
    events, _ = S.admit(view(spark, sf, "fx_event").select(
        "ledger_id", F.col("event_id").alias("ord"), "event"))
    cut = events.groupBy("ledger_id").agg((F.max("ord") / 2).alias("_half"))
    events = events.join(cut, "ledger_id")
    S.write_jsonl(S.append(events.where("ord <= _half")), path)
    lines = S.scan(spark, path)
    S.write_jsonl(S.append(events.where("ord > _half"), G.heads(S.entries(lines, S.damage(lines)))),
                  path)
    lines, extra = S.scan(spark, path), spark.range(1).select(F.lit("empty").alias("ledger_id"))
    known = S.ledgers(spark, path).unionByName(extra)
    damaged = S.damage(lines)
    e = S.entries(lines, damaged)
    return G.dump(damaged, G.verify(e, ledgers=known)).join(G.heads(e, known), "ledger_id").select(
        "ledger_id", "records", "intact", "truncated", "head")


@query("l_06_refusals", duck(["fx_call"], f"""
    SELECT ledger_id, concat('broken at entry ', broken_at) AS refusal FROM ({_VERDICT})
    WHERE broken_at IS NOT NULL
    UNION ALL VALUES ('L7', 'the last record is partial'), ('empty', 'nothing to seal'),
        ('L6', 'the file cannot be digested')"""))
def refusals(spark, sf):
    p = planted(spark, sf)
    ids = p.select("ledger_id").distinct()
    known = ids.unionByName(spark.range(1).select(F.lit("empty").alias("ledger_id")))
    torn = ids.select("ledger_id", (F.col("ledger_id") == "L7").alias("truncated"))
    digests = known.where("ledger_id <> 'L6'").withColumn("file_digest", F.lit("d"))
    return G.refused_segments(G.dump(torn, G.verify(p, ledgers=known)), digests)


@query("l_10_dump", duck(["fx_call"], f"""
    SELECT ledger_id, records, broken_at IS NULL AS intact, broken_at, ledger_id = 'L7' AS truncated
    FROM ({_VERDICT}) UNION ALL VALUES ('empty', 0, true, NULL, false)"""))
def dump(spark, sf):
    p = planted(spark, sf)
    ids = p.select("ledger_id").distinct()
    known = ids.unionByName(spark.range(1).select(F.lit("empty").alias("ledger_id")))
    torn = ids.select("ledger_id", (F.col("ledger_id") == "L7").alias("truncated"))
    return G.dump(torn, G.verify(p, ledgers=known)).select(
        "ledger_id", "records", "intact", "broken_at", "truncated")


# ── validation ──────────────────────────────────────────────────────────────────────────────
def predicates(spark, sf):
    return view(spark, sf, "fx_predicate").withColumn("pred", F.parse_json("predicate"))


def _j(path):
    return f"json_extract(predicate, '$.{path}')::varchar"


def _duck_list(items):
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {c} THEN '{m}' END" for c, m in items) + "], lambda x: x IS NOT NULL), '|')"


def _duck_tier_a():
    items = []
    for p in vocab.TIER_A:
        items.append((f"{_j(p)} IS NULL", f"{p} (absent)"))
        if p in vocab.TIER_A_ASSERTIONS:
            items.append((f"{_j(p)} NOT LIKE '[%'", f"{p} (must be a list; [] asserts ''nothing'', "
                          "absent means ''nobody looked'')"))
        else:
            items.append((f"{_j(p)} IN ('null', '\"\"')", f"{p} (empty)"))
    items.append(("json_extract_string(predicate, '$.action.op') = 'artifact.eat'",
                  "action.op (''artifact.eat'' is not in the controlled vocabulary)"))
    items.append(("json_extract_string(predicate, '$.authority.posture') = 'shrug'",
                  "authority.posture (''shrug'' not in [''bar'', ''observe'', ''steer''])"))
    items.append(("json_extract_string(predicate, '$.action.method.kind') = 'telepathy'",
                  "action.method.kind (''telepathy'' not in [''delegated-script'', ''denied'', "
                  "''direct-model'', ''signed-script''])"))
    return _duck_list(items)


@query("v_01_normalise", duck(["fx_predicate"], """
    SELECT event_id, session_id, CASE WHEN regexp_extract(predicate, 'artifact.eat') <> ''
            THEN 'artifact.eat' ELSE op END AS op, outcome,
        nullif(json_extract_string(predicate, '$.actor.runtime_action_id'), '') AS action_id,
        coalesce(json_array_length(json_extract(predicate, '$.resources.used')), 0)::bigint AS used
    FROM fx_predicate"""))
def normalise(spark, sf):
    """Alternates the three record shapes over the rows."""
    p = view(spark, sf, "fx_predicate")
    shape = F.col("event_id") % 4
    body = F.when(shape == 0, F.col("predicate")).when(
        shape == 1, F.concat(F.lit('{"predicate":'), "predicate", F.lit("}"))).when(
        shape == 2, F.concat(F.lit('{"statement":{"predicate":'), "predicate", F.lit("}}"))
    ).otherwise(F.concat(F.lit('{"statement":'), "predicate", F.lit("}")))
    out = V.normalise(p.select("ledger_id", F.col("event_id").alias("seq"),
                               F.parse_json(body).alias("body")))
    return out.select(F.col("seq").alias("event_id"), "session_id", "op", "outcome", "action_id",
                      F.size("used").cast("long").alias("used"))


@query("v_01_blank_falls_through", duck(["fx_predicate"], """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN session_id END AS session_id,
        'artifact.flat' AS op, CASE WHEN event_id % 2 = 0 THEN 'ask' END AS outcome,
        CASE WHEN event_id % 5 = 0 THEN concat('call-', event_id) END AS action_id
    FROM fx_predicate"""))
def blank_falls_through(spark, sf):
    """Blank nested values over flat mirrors, some of which are blank too."""
    n = F.col("event_id")
    body = F.concat(
        F.lit('{"action":{"op":"","tool":{"call_id":"'),
        F.when(n % 5 == 0, F.concat(F.lit("call-"), n.cast("string"))).otherwise(""),
        F.lit('"}},"actor":{"runtime_action_id":""},"runtime_action_id":"","op":"artifact.flat",'
              '"decision":{"outcome":""},"outcome":"'),
        F.when(n % 2 == 0, "ask").otherwise(""), F.lit('","lifecycle":{'),
        F.when(n % 3 == 0, F.lit('"session_id":""')).otherwise(""), F.lit("}"),
        F.when(n % 3 == 1, F.concat(F.lit(',"session_id":"'), "session_id", F.lit('"'))).otherwise(""),
        F.lit("}"))
    out = V.normalise(view(spark, sf, "fx_predicate").select(
        "ledger_id", n.alias("seq"), F.parse_json(body).alias("body")))
    return out.select(F.col("seq").alias("event_id"), "session_id", "op", "outcome", "action_id")


@query("v_02_tier_a", duck(["fx_predicate"], f"""
    SELECT event_id, {_duck_tier_a()} AS problems FROM fx_predicate"""))
def tier_a(spark, sf):
    return predicates(spark, sf).select(
        "event_id", F.array_join(V.tier_a(F.col("pred")), "|").alias("problems"))


@query("v_03_boundary", duck(["fx_event"], """
    SELECT event_id, concat_ws('; ', CASE WHEN event_id % 401 = 9 THEN 'missing actor' END,
        CASE WHEN event_id % 409 = 11 THEN 'missing alterations (use [] to assert there is nothing to report; a missing key means nobody looked)' END,
        CASE WHEN event_id % 419 = 13 THEN 'known_gaps must be a list, got str' END) AS problems
    FROM fx_event WHERE event_id % 401 = 9 OR event_id % 409 = 11 OR event_id % 419 = 13"""))
def boundary(spark, sf):
    _, refused = V.split_events(view(spark, sf, "fx_event"))
    return refused.select("event_id", F.array_join("problems", "; ").alias("problems"))


@query("v_04_tier_b", duck(["fx_predicate"], f"""
    SELECT event_id, {_duck_list([
        (f"{_j('actor.acted_on_behalf_of.prompt_id')} IS NULL AND "
         "json_extract_string(predicate, '$.authority.posture') <> 'observe'",
         'actor.acted_on_behalf_of.prompt_id'),
        (f"{_j('decision.basis')} IS NULL", 'decision.basis'),
        (f"{_j('authority.capability')} IS NULL", 'authority.capability'),
        (f"{_j('actor.acted_on_behalf_of.delegation_depth')} <> '0' AND "
         f"{_j('actor.acted_on_behalf_of.delegation_chain')} IS NULL",
         'actor.acted_on_behalf_of.delegation_chain (delegation_depth > 0)'),
        ("json_extract_string(predicate, '$.action.op') IN ('artifact.read', 'artifact.write', "
         f"'artifact.derive', 'artifact.egress') AND coalesce({_j('resources.used')}, '[]') = '[]'",
         'resources.used (data-touching op)'),
        ("json_extract_string(predicate, '$.action.method.kind') = 'delegated-script' AND "
         f"{_j('action.method.script.test_result.passed')} IS NULL",
         'action.method.script.test_result.passed (must be true)')])} AS findings
    FROM fx_predicate"""))
def tier_b(spark, sf):
    return predicates(spark, sf).select(
        "event_id", F.array_join(V.tier_b(F.col("pred")), "|").alias("findings"))


@query("v_05_strength", duck(["fx_predicate"], """
    SELECT event_id, CASE WHEN event_id % 19 = 4 THEN '+tsa' WHEN event_id % 17 = 3 THEN '+signed'
        WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 4 >= 2 THEN 'chain-keyed+isolated'
        WHEN event_id % 3 <> 0 THEN 'chain-keyed' ELSE 'chain-only' END AS strength
    FROM fx_predicate"""))
def strength(spark, sf):
    return predicates(spark, sf).select("event_id", V.strength(F.col("pred")).alias("strength"))


@query("v_06_build_records", duck(["fx_call"], """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'chain-only' WHEN event_id % 4 >= 2
            THEN 'chain-keyed+isolated' ELSE 'chain-keyed' END AS strength,
        action_id IS NOT NULL AS writable,
        CASE WHEN k % 2 = 0 THEN 'override' ELSE 'hook' END AS channel
    FROM fx_call"""))
def build_records(spark, sf):
    c = view(spark, sf, "fx_call").select(
        "event_id", F.col("at_iso").alias("at"), "session_id", "posture", "op", "outcome", "k",
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"),
        F.col("at_iso").alias("recorded_at"), F.lit("agent").alias("agent_id"),
        F.col("action_id").alias("runtime_action_id"),
        F.struct(F.col("project").alias("identity")).alias("operator"),
        F.lit("direct-model").alias("method_kind"), F.col("artifact_id").alias("input_digest"),
        F.lit("d").alias("policy_set_digest"), F.lit("p").alias("determining_policy"),
        F.lit("hook").alias("channel"), F.array().cast("array<string>").alias("known_gaps"),
        F.array().cast("array<string>").alias("alterations"),
        F.struct(F.when(F.col("event_id") % 3 == 0, "sha256").otherwise("hmac-sha256").alias(
            "algo")).alias("chain"), (F.col("event_id") % 4).alias("isolation_tier"))
    built = V.build_records(c, extra={"decision.channel": F.when(F.col("k") % 2 == 0, "override")})
    stmt = F.parse_json("statement")
    return built.select("event_id", F.try_variant_get(
        stmt, "$.predicate.verification.strength", "string").alias("strength"),
        (F.size("problems") == 0).alias("writable"),
        F.try_variant_get(stmt, "$.predicate.decision.channel", "string").alias("channel"))


# ── reconciliation and alerts ───────────────────────────────────────────────────────────────
_R01 = """fx_num AS (SELECT *, row_number() OVER (PARTITION BY ledger_id, seq ORDER BY report_no)
        AS rn FROM fx_report),
fx_both AS (SELECT r.*, d.actor AS d_actor, d.action AS d_action, d.nonce AS d_nonce,
        d.actor IS NOT NULL AS found FROM fx_num r LEFT JOIN fx_dispatch d
        ON d.ledger_id = r.ledger_id AND d.seq = r.seq),
fx_finding AS (
    SELECT ledger_id, seq, report_no, 'fabricated' AS kind FROM fx_both WHERE NOT found
    UNION ALL SELECT ledger_id, seq, report_no, 'replayed' FROM fx_both WHERE found AND rn > 1
    UNION ALL SELECT ledger_id, seq, report_no, 'actor' FROM fx_both WHERE found AND actor <> d_actor
    UNION ALL SELECT ledger_id, seq, report_no, 'action' FROM fx_both WHERE found AND action <> d_action
    UNION ALL SELECT ledger_id, seq, report_no, 'no-nonce' FROM fx_both WHERE found AND nonce IS NULL
    UNION ALL SELECT ledger_id, seq, report_no, 'nonce' FROM fx_both WHERE found AND nonce <> d_nonce
    UNION ALL SELECT ledger_id, seq, NULL, 'unreported' FROM fx_dispatch d WHERE NOT EXISTS (
        SELECT 1 FROM fx_report r WHERE r.ledger_id = d.ledger_id AND r.seq = d.seq))"""


@query("r_01_reconcile", duck(["fx_dispatch", "fx_report"], """
    SELECT ledger_id, seq, report_no, kind FROM fx_finding""", _R01))
def reconcile(spark, sf):
    return R.reconcile(view(spark, sf, "fx_dispatch"), view(spark, sf, "fx_report")).select(
        "ledger_id", "seq", "report_no", "kind")


@query("r_01_verdict", duck(["fx_dispatch", "fx_report"], """
    SELECT d.ledger_id, coalesce(f.n, 0) AS findings, f.n IS NULL AS verified
    FROM (SELECT DISTINCT ledger_id FROM fx_dispatch) d LEFT JOIN (
        SELECT ledger_id, count(*) AS n FROM fx_finding GROUP BY ledger_id) f
        ON f.ledger_id = d.ledger_id""", _R01))
def verdict(spark, sf):
    d = view(spark, sf, "fx_dispatch")
    return R.reconciliation_verdict(d, R.reconcile(d, view(spark, sf, "fx_report")))


_INSTANCE = "CASE WHEN event_type IN ('view', 'purchase') THEN 'dispatch' ELSE 'result' END"


@query("r_02_turns", duck(["fx_call"], f"""
    SELECT session_id, sum(d) AS dispatched, sum(r) AS reported, count(id) AS action_instances,
        count(*) FILTER (d > 0 AND r = 0) AS unclosed, sum(d) + sum(r) > 0 AS examined_anything,
        CASE WHEN count(*) FILTER ((d > 0) <> (r > 0)) > 0 THEN 'critical'
            WHEN sum(d) + sum(r) > 0 THEN 'info' ELSE 'warning' END AS severity
    FROM (SELECT session_id, action_id AS id,
            count(*) FILTER (action_id IS NOT NULL AND {_INSTANCE} = 'dispatch') AS d,
            count(*) FILTER (action_id IS NOT NULL AND {_INSTANCE} = 'result') AS r
          FROM fx_call GROUP BY session_id, action_id) GROUP BY session_id"""))
def turns(spark, sf):
    inst = view(spark, sf, "fx_call").select("session_id", F.col("action_id").alias("id"),
                                             F.expr(_INSTANCE).alias("phase"))
    return R.turn_reconciliation(inst)[0]


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_OP = "CASE WHEN k = 95 THEN 'proof.run' WHEN k = 94 THEN 'recorder.selfcheck' ELSE op END"
_ALERT = f"""fx_alert AS (SELECT ledger_id, event_id, seq, op, wake, CASE
        WHEN op = 'recorder.selfcheck' THEN 'the recorder failed its own integrity check'
        WHEN op = 'custody.declassify' THEN 'a classification was dropped — a human authorised removing a label'
        WHEN op = 'artifact.egress' THEN 'tainted data left, or attempted to leave, the boundary'
        WHEN wake = 'human' THEN concat('record marked critical: k=', k)
        WHEN wake IS NULL THEN 'routine activity'
        ELSE concat('unrecognised op ''', op, ''' — refusing to ignore what is not understood') END AS reason
    FROM (SELECT *, CASE WHEN op IN ({_in(vocab.WAKE_HUMAN)}) THEN 'human'
        WHEN op IN ({_in(vocab.WAKE_OPERATOR)}) THEN 'operator' WHEN k % 25 = 0 THEN 'human'
        WHEN op IN ({_in(vocab.ROUTINE)}) THEN NULL ELSE 'operator' END AS wake
        FROM (SELECT ledger_id, event_id, seq, k, {_OP} AS op FROM fx_call)))"""


def _alert_records(spark, sf):
    return view(spark, sf, "fx_call").select(
        "ledger_id", "event_id", "seq", F.expr(_OP).alias("op"),
        F.when(F.col("k") % 25 == 0, "critical").alias("severity"),
        F.concat(F.lit("k="), F.col("k").cast("string")).alias("detail"))


@query("r_03_alert_classes", duck(["fx_call"], """
    SELECT event_id, wake IS NOT NULL AS alert, reason, wake FROM fx_alert""", _ALERT))
def alert_classes(spark, sf):
    return R.classify_alerts(_alert_records(spark, sf)).select("event_id", "alert", "reason", "wake")


@query("r_03_alert_kinds", duck(["fx_call"], """
    SELECT event_id, wake IS NOT NULL AS alert, reason, wake FROM fx_alert""", _ALERT))
def alert_kinds(spark, sf):
    """Records that name their operation ``kind``; some carry a blank ``op`` besides."""
    r = _alert_records(spark, sf).withColumn("kind", F.col("op")).withColumn(
        "op", F.when(F.col("event_id") % 3 == 0, F.col("kind")).when(F.col("event_id") % 3 == 1, ""))
    return R.classify_alerts(r).select("event_id", "alert", "reason", "wake")


@query("r_04_alert_report", duck(["fx_call"], f"""
    SELECT ledger_id, 0 AS priority, broken_at AS seq, CASE WHEN broken_at IS NOT NULL THEN
        concat('LEDGER CHAIN BROKEN at entry ', broken_at, ': ', reason, ' — tampering or corruption')
        ELSE 'chain shape is intact but could not be verified against its key — report this as ''chain-only'', never as tamper-proof' END AS reason,
        CASE WHEN broken_at IS NOT NULL THEN 'human' ELSE 'operator' END AS wake FROM ({_VERDICT})
    UNION ALL
    SELECT ledger_id, 1, seq, reason, wake FROM fx_alert WHERE wake IS NOT NULL""", _ALERT))
def alert_report(spark, sf):
    return R.alert_report(_alert_records(spark, sf), G.verify(planted(spark, sf)))


@query("r_05_nonces", duck(["fx_dispatch"], """
    SELECT ledger_id, seq, lower(concat(lpad(to_hex(st.a), 8, '0'), lpad(to_hex(st.b), 8, '0'))) AS nonce
    FROM (SELECT ledger_id, seq, list_reduce(
            list_transform(string_split(concat('t', ledger_id, '#', seq, '#sg-nonce'), ''),
                lambda c, i: {a: unicode(c)::bigint, b: (unicode(c) * (i + 6))::bigint}),
            lambda s, c: {a: ((xor(s.a, c.a)::hugeint * 16777619) % 4294967296)::bigint,
                b: (((s.b + c.b)::hugeint * 2246822507) % 4294967296)::bigint},
            {a: 2166136261::bigint, b: 16777619::bigint}) AS st FROM fx_dispatch)"""))
def nonces(spark, sf):
    d = view(spark, sf, "fx_dispatch").withColumn(
        "instance_id", F.concat(F.lit("t"), F.col("ledger_id").cast("string")))
    return R.issue_nonces(d.drop("nonce")).select("ledger_id", "seq", "nonce")
