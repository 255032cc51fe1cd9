"""Registered queries: proofs, claims, scope and attestation."""

from pyspark.sql import functions as F

from provlake.operators import evidence as E
from provlake.plans.registry import query
from provlake.session import scratch_path
from provlake.sources.keys import KeySource
from provlake.sources.tables import duck, view

VIEWS = ["fx_claim", "fx_proof"]
SUBJECT, MODULES, HOOKS = {"rules_digest": "rules-v1"}, {"m1": "m-v1"}, ["Stop"]


def claims(spark, sf):
    c = view(spark, sf, "fx_claim")
    return c.select(
        "claim", "statement", F.array("surface_a", "surface_b").alias("surface"), "proof_kind",
        F.lit("M1").alias("milestone"), F.array("control_a", "control_b").alias("aicm"),
        F.array(F.lit("m1")).alias("must_touch"), "witness_mode", "definition_digest")


def claim_controls(spark, sf):
    return claims(spark, sf).select("claim", F.explode("aicm").alias("control"))


def procedures(spark, sf):
    n = F.regexp_extract("claim", "([0-9]+)", 1).cast("long")
    return view(spark, sf, "fx_claim").where(n % 12 != 7).select(
        "claim", F.when(n % 14 == 5, "other").otherwise(F.col("proof_kind")).alias("kind"),
        F.lit("p1").alias("source_digest"))


def proofs(spark, sf):
    p = view(spark, sf, "fx_proof")
    names = F.array(F.lit("m0"), F.lit("m1.sub"), F.lit("m2"))
    witness = F.when(F.col("n_modules").isNotNull(), F.struct(
        F.slice(names, 1, F.col("n_modules")).alias("modules"), F.col("calls").alias("calls"),
        F.when(F.col("witness_off"), "no tracer").alias("unavailable")))
    return p.select(
        "ref", "seq", F.col("recorded_claim").alias("claim"), "passed", "definition_digest",
        F.create_map(F.lit("m1"), F.col("module_digest")).alias("implementation_manifest"),
        "procedure_digest", F.create_map(F.lit("rules_digest"), F.col("rules_digest")).alias(
            "evidence_subject"), witness.alias("witness"), "has_evidence",
        F.array_compact(F.array(F.when(F.col("ran_stop"), "hook:Stop"),
                                F.when(F.col("ran_verify"), "cli:verify"))).alias("exercised"))


def refs(spark, sf):
    """What claims cite: two thirds of their proofs, and one reference that never existed."""
    own = view(spark, sf, "fx_proof").where("k % 3 <> 2").select("claim", "ref")
    gone = view(spark, sf, "fx_claim").select("claim", F.lit("sg:0:feedfacefeedface").alias("ref"))
    known = view(spark, sf, "fx_claim").select("claim")
    return own.join(known, "claim", "left_semi").unionByName(gone)


def judged(spark, sf):
    return E.judge_refs(refs(spark, sf), claims(spark, sf), proofs(spark, sf), procedures(spark, sf),
                        SUBJECT, MODULES)


def status(spark, sf):
    return E.check_claims(claims(spark, sf), judged(spark, sf), procedures(spark, sf), HOOKS)


#: The gate spelled over flat columns: first reason per cited ref, then the claim row.
STATUS = """fx_cite AS (SELECT p.claim, p.ref FROM fx_proof p WHERE k % 3 <> 2
        AND claim IN (SELECT claim FROM fx_claim)
    UNION ALL SELECT claim, 'sg:0:feedfacefeedface' FROM fx_claim),
fx_judged AS (
    SELECT c.claim, c.ref, p.seq, p.ran_stop, p.ran_verify, CASE
        WHEN p.ref IS NULL THEN 'not found' WHEN NOT p.passed THEN 'failed'
        WHEN p.recorded_claim <> c.claim THEN 'wrong claim'
        WHEN p.definition_digest <> m.definition_digest THEN 'definition'
        WHEN p.module_digest <> 'm-v1' THEN 'implementation'
        WHEN n % 12 <> 7 AND p.procedure_digest <> 'p1' THEN 'procedure'
        WHEN p.rules_digest <> 'rules-v1' THEN 'drift'
        WHEN p.n_modules IS NULL THEN 'no witness' WHEN p.witness_off THEN 'unavailable'
        WHEN m.witness_mode = 'subprocess' THEN CASE WHEN NOT p.has_evidence THEN 'no evidence' END
        WHEN p.n_modules < 1 OR p.calls < 25 THEN 'vacuous'
        WHEN p.n_modules < 2 THEN 'untouched' END AS dead
    FROM fx_cite c JOIN (SELECT *, cast(substr(claim, 7) AS bigint) AS n FROM fx_claim) m ON m.claim = c.claim
    LEFT JOIN fx_proof p ON p.ref = c.ref),
fx_agg AS (SELECT claim, arg_max(ref, seq) FILTER (dead IS NULL) AS live_ref,
        count(*) FILTER (dead IS NULL) AS live, count(*) FILTER (dead IS NOT NULL) AS dead,
        coalesce(bool_or(ran_stop), false) AS stop, coalesce(bool_or(ran_verify), false) AS verify
    FROM fx_judged GROUP BY claim),
fx_status AS (
    SELECT c.*, a.live_ref, greatest(a.live - 1, 0) AS superseded, a.dead, n % 12 <> 7 AS has_procedure,
        n % 12 <> 7 AND n % 14 <> 5 AS kind_matches, bad, n,
        live_ref IS NOT NULL AND n % 12 <> 7 AND n % 14 <> 5 AND bad = 0 AS proven
    FROM (SELECT *, cast(substr(claim, 7) AS bigint) AS n FROM fx_claim) c
    JOIN (SELECT a.*, CASE surface_a WHEN 'hook:Stop' THEN NOT stop WHEN 'cli:verify' THEN NOT verify
                WHEN 'hook:Nowhere' THEN true ELSE false END::int
            + CASE surface_b WHEN 'hook:Stop' THEN NOT stop ELSE false END::int AS bad
          FROM fx_agg a JOIN fx_claim f ON f.claim = a.claim) a ON a.claim = c.claim)"""


@query("e_01_proof_refs", duck(["fx_proof"], "SELECT seq, ref FROM fx_proof"))
def proof_refs(spark, sf):
    p = view(spark, sf, "fx_proof").drop("ref").withColumn("op", F.lit("proof.run"))
    return E.proof_index(p).select("seq", "ref")


@query("e_02_definition_digest", duck(["fx_claim"], """
    SELECT claim, substr(sha256(concat('{"aicm":["', control_a, '","', control_b, '"],"id":"', claim,
        '","milestone":"M1","must_touch":["m1"],"proof_kind":"', proof_kind, '","statement":"', statement,
        '","surface":["', surface_a, '","', surface_b, '"],"witness_mode":"', witness_mode, '"}')), 1, 32)
        AS digest FROM fx_claim"""))
def definition_digest(spark, sf):
    c = claims(spark, sf)
    return c.select("claim", E.definition_digest(c).alias("digest"))


@query("e_03_subject_drift", duck(["fx_proof"], """
    SELECT ref, CASE WHEN rules_digest = 'rules-old'
        THEN 'rules_digest changed since this proof (rules-old -> rules-v1)' END AS drift FROM fx_proof"""))
def subject_drift(spark, sf):
    return proofs(spark, sf).select("ref", F.get(E.subject_drift(
        F.col("evidence_subject"), SUBJECT), F.lit(0)).alias("drift"))


@query("e_04_implementation_drift", duck(["fx_proof"], """
    SELECT ref, CASE WHEN module_digest = 'm-old' THEN 'm1 changed after this proof (m-old -> m-v1)' END
        AS drift FROM fx_proof"""))
def implementation_drift(spark, sf):
    return proofs(spark, sf).select("ref", F.get(E.implementation_drift(
        F.col("implementation_manifest"), MODULES), F.lit(0)).alias("drift"))


@query("e_05_witness", duck(["fx_proof"], """
    SELECT ref, CASE WHEN n_modules IS NULL OR witness_off THEN 1 ELSE
        CASE WHEN n_modules < 1 OR calls < 25 THEN 1 ELSE 0 END
        + CASE WHEN n_modules < 2 THEN 1 ELSE 0 END + CASE WHEN n_modules < 3 THEN 1 ELSE 0 END END AS findings
    FROM fx_proof"""))
def witness(spark, sf):
    need = F.array(F.lit("m1"), F.lit("m2"))
    return proofs(spark, sf).select("ref", F.size(E.witness_findings(
        F.col("witness"), need, F.lit("in-process"), F.col("has_evidence"))).cast("long").alias("findings"))


@query("e_06_surface_findings", duck(VIEWS, """
    SELECT claim, bad AS findings, CASE WHEN surface_a = 'plugin:custody' THEN 1 ELSE 0 END
        + CASE WHEN surface_b = 'file:readme' THEN 1 ELSE 0 END AS unvalidated FROM fx_status""", STATUS))
def surface_findings(spark, sf):
    return status(spark, sf).select(
        "claim", F.size("surface_findings").cast("long").alias("findings"),
        F.size("unvalidated").cast("long").alias("unvalidated"))


@query("e_07_cited_refs", duck(VIEWS, "SELECT claim, ref, dead IS NULL AS live FROM fx_judged", STATUS))
def cited_refs(spark, sf):
    return judged(spark, sf).select("claim", "ref", F.col("dead").isNull().alias("live"))


@query("e_07_claim_status", duck(VIEWS, """
    SELECT claim, live_ref, superseded, dead, has_procedure, kind_matches, proven FROM fx_status""", STATUS))
def claim_status(spark, sf):
    return status(spark, sf).select("claim", "live_ref", "superseded", "dead", "has_procedure",
                                    "kind_matches", "proven")


# ── scope ───────────────────────────────────────────────────────────────────────────────────
def scope_ledger(spark, sf):
    """Scope records and retractions as ledger rows with JSON details; some details are torn."""
    s = view(spark, sf, "fx_scope")
    surface = F.when(F.col("field") == "surface", F.array("item"))
    aicm = F.when(F.col("field") == "aicm", F.array("item"))
    rec = F.when(F.col("seq") % 50 == 1, "{torn").otherwise(F.to_json(F.struct(F.struct(
        aicm.alias("aicm"), surface.alias("surface")).alias("scope"))))
    ret = F.to_json(F.struct("field", "reason", F.array("item").alias("removed")))
    return s.where("role IN ('recorded', 'retracted')").select(
        "claim", "seq", F.when(F.col("role") == "recorded", "claim.scope").otherwise(
            "claim.scope.retract").alias("op"),
        F.when(F.col("role") == "recorded", rec).otherwise(ret).alias("detail"))


def current_scope(spark, sf):
    return view(spark, sf, "fx_scope").where("role = 'current'").select("claim", "field", "item")


def gone_items(spark, sf):
    led = scope_ledger(spark, sf)
    return E.retracted_items(E.high_water(led), current_scope(spark, sf), E.justified_removals(led))


_SCOPE = """fx_peak AS (SELECT DISTINCT claim, field, item FROM fx_scope
        WHERE role = 'recorded' AND seq % 50 <> 1),
fx_reason AS (SELECT claim, field, item, arg_max(reason, seq) AS reason FROM fx_scope
        WHERE role = 'retracted' AND trim(reason) <> '' GROUP BY claim, field, item),
fx_gone AS (SELECT p.*, r.reason FROM fx_peak p LEFT JOIN fx_reason r
        ON r.claim = p.claim AND r.field = p.field AND r.item = p.item
    WHERE NOT EXISTS (SELECT 1 FROM fx_scope c WHERE c.role = 'current' AND c.claim = p.claim
        AND c.field = p.field AND c.item = p.item))"""


@query("e_08_high_water", duck(["fx_scope"], "SELECT claim, field, item FROM fx_peak", _SCOPE))
def high_water(spark, sf):
    return E.high_water(scope_ledger(spark, sf))


@query("e_09_retractions", duck(["fx_scope"], """
    SELECT claim, field, reason IS NOT NULL AS justified, string_agg(item, ',' ORDER BY item) AS removed
    FROM fx_gone GROUP BY claim, field, reason IS NOT NULL""", _SCOPE))
def retractions(spark, sf):
    return E.retractions(gone_items(spark, sf)).select(
        "claim", "field", "justified", F.array_join("removed", ",").alias("removed"))


@query("e_10_scope_events", duck(["fx_scope"], """
    SELECT claim, substr(sha256(concat('{"aicm":[', coalesce(string_agg(DISTINCT concat('"', item, '"'), ','
        ORDER BY concat('"', item, '"')) FILTER (field = 'aicm'), ''), '],"surface":[',
        coalesce(string_agg(DISTINCT concat('"', item, '"'), ',' ORDER BY concat('"', item, '"'))
        FILTER (field = 'surface'), ''), ']}')), 1, 32) AS scope_digest
    FROM fx_scope WHERE role = 'current' GROUP BY claim"""))
def scope_events(spark, sf):
    return E.scope_events(current_scope(spark, sf)).select("claim", "scope_digest")


@query("e_10_retraction_events", duck(["fx_scope"], """
    SELECT claim, seq, trim(reason) = '' AS refused FROM fx_scope WHERE role = 'retracted'"""))
def retraction_events(spark, sf):
    req = view(spark, sf, "fx_scope").where("role = 'retracted'").select(
        "claim", "seq", "field", "reason", F.array("item").alias("removed"))
    ok, refused = E.retraction_events(req)
    return ok.select("claim", "seq", F.lit(False).alias("refused")).unionByName(
        refused.select("claim", "seq", F.lit(True).alias("refused")))


# ── attestation ─────────────────────────────────────────────────────────────────────────────
@query("e_11_controls", duck(VIEWS, """
    SELECT control, string_agg(claim, ',' ORDER BY claim) AS claims FROM (
        SELECT claim, control_a AS control FROM fx_status WHERE proven
        UNION SELECT claim, control_b FROM fx_status WHERE proven) GROUP BY control""", STATUS))
def controls(spark, sf):
    return E.controls_evidenced(status(spark, sf), claim_controls(spark, sf)).select(
        "control", F.array_join("claims", ",").alias("claims"))


def panels(spark, sf):
    """Judge panels of proof records: three lenses, verdicts by record."""
    def lens(name, cond):
        return F.struct(F.lit(name).alias("lens"), F.when(cond, "defer").otherwise("approve").alias(
            "verdict"))
    k = F.col("k")
    v = F.array(lens("independence", F.lit(True)), lens("control-present", k % 4 == 0),
                lens("can-fail", k % 7 == 0))
    return view(spark, sf, "fx_proof").select(
        "claim", "seq", "passed", F.when(k % 10 != 9, v).alias("verdicts"))


_PANEL = """fx_panel AS (SELECT claim, arg_max(k, seq) AS k FROM fx_proof WHERE passed AND k % 10 <> 9
    GROUP BY claim)"""


@query("e_12_panel_summary", duck(["fx_proof"], """
    SELECT 'claims_judged' AS measure, count(*) AS value FROM fx_panel
    UNION ALL SELECT 'verdicts', 3 * count(*) FROM fx_panel
    UNION ALL SELECT 'deferred_disapprovals', count(*) + count(*) FILTER (k % 4 = 0)
        + count(*) FILTER (k % 7 = 0) FROM fx_panel
    UNION ALL SELECT 'lens:independence', count(*) FROM fx_panel
    UNION ALL SELECT 'lens:control-present', count(*) FROM fx_panel WHERE k % 4 = 0
    UNION ALL SELECT 'lens:can-fail', count(*) FROM fx_panel WHERE k % 7 = 0""", _PANEL))
def panel_summary(spark, sf):
    return E.panel_summary(E.latest_panels(panels(spark, sf)))


@query("e_13_assurance", duck([*VIEWS, "fx_scope"], """
    SELECT (SELECT count(*) FROM fx_status) AS total, (SELECT count(*) FROM fx_status WHERE proven) AS proven,
        (SELECT bool_and(proven) FROM fx_status) AS executed, false AS chain_verified,
        (SELECT bool_and(surface_a <> 'plugin:custody' AND surface_b <> 'file:readme') FROM fx_status)
            AS surface_validated,
        (SELECT count(*) + count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 7 = 0) FROM fx_panel)
            AS deferred_disapprovals,
        (SELECT count(*) FILTER (k % 4 = 0) = 0 FROM fx_panel) AS control_backed,
        (SELECT count(*) FROM (SELECT DISTINCT claim, field, reason IS NOT NULL FROM fx_gone)) AS scope_retractions,
        (SELECT count(*) FROM (SELECT DISTINCT claim, field FROM fx_gone WHERE reason IS NULL))
            AS scope_retractions_unjustified, false AS release_assured""",
                             STATUS + ", " + _PANEL + ", " + _SCOPE))
def assurance(spark, sf):
    return E.assurance(status(spark, sf), E.retractions(gone_items(spark, sf)),
                       E.latest_panels(panels(spark, sf)), chain_intact=True, chain_keyed=False,
                       questionnaire_filled=True).select(
        "total", "proven", "executed", "chain_verified", "surface_validated",
        "deferred_disapprovals", "control_backed", "scope_retractions",
        "scope_retractions_unjustified", "release_assured")


@query("e_14_regressions", duck(VIEWS, """
    SELECT concat(claim, ' was proven before this change and is not proven after it') AS finding
    FROM fx_status WHERE proven AND n % 3 = 0
    UNION ALL SELECT DISTINCT concat('control ', control_a, ' lost its evidence') FROM fx_status s
        WHERE proven AND control_a NOT IN (SELECT control_a FROM fx_status WHERE proven AND n % 3 <> 0)
    UNION ALL SELECT 'the ledger was keyed-verified before and is not after — a strength downgrade'
        FROM (SELECT count(*) AS c FROM fx_status) WHERE c > 0""", STATUS))
def regressions(spark, sf):
    s = status(spark, sf).where("proven")
    n = F.regexp_extract("claim", "([0-9]+)", 1).cast("long")
    one = view(spark, sf, "fx_claim").agg(F.count(F.lit(1)).alias("n")).where("n > 0")

    def snapshot(rows, flags):
        return (rows.select(F.lit("claim").alias("kind"), F.col("claim").alias("name"))
                .unionByName(rows.select(F.lit("control").alias("kind"),
                                         F.element_at("aicm", 1).alias("name")).distinct())
                .unionByName(one.select(F.lit("flag").alias("kind"), F.explode(F.array(*[
                    F.lit(x) for x in flags])).alias("name"))))

    return E.regressions(snapshot(s, ["chain_intact", "chain_keyed"]),
                         snapshot(s.where(n % 3 != 0), ["chain_intact", "goal_met"])).select("finding")


@query("e_15_status_metrics", duck(VIEWS, """
    SELECT 'total' AS measure, count(*) AS value FROM fx_status
    UNION ALL SELECT 'live_refs', count(live_ref) FROM fx_status
    UNION ALL SELECT 'superseded_refs', sum(superseded)::bigint FROM fx_status
    UNION ALL SELECT 'proven', count(*) FROM fx_status WHERE proven
    UNION ALL SELECT 'application_claims', count(*) FROM fx_status WHERE claim <> 'CLAIM-21'
    UNION ALL SELECT 'application_proven', count(*) FROM fx_status WHERE claim <> 'CLAIM-21' AND proven
    UNION ALL SELECT concat('kind:', proof_kind), count(*) FROM fx_status GROUP BY 1
    UNION ALL SELECT 'controls', count(*) FROM (SELECT control_a FROM fx_status WHERE proven
        UNION SELECT control_b FROM fx_status WHERE proven)
    UNION ALL SELECT concat('answer:', a), count(*) FROM (
        SELECT CASE WHEN c = 'LOG-12' THEN 'No' ELSE 'Yes' END AS a FROM (
            SELECT control_a AS c FROM fx_status WHERE proven AND claim <> 'CLAIM-21'
            UNION SELECT control_b FROM fx_status WHERE proven AND claim <> 'CLAIM-21')
        UNION ALL SELECT 'No' FROM (VALUES ('LOG-12'), ('STA-09')) t(c) WHERE c NOT IN (
            SELECT control_b FROM fx_status WHERE proven AND claim <> 'CLAIM-21')) GROUP BY 1""", STATUS))
def status_metrics(spark, sf):
    from provlake.operators import answers as N
    s, cc = status(spark, sf), claim_controls(spark, sf)
    return E.status_metrics(s, N.derive(s, cc), E.controls_evidenced(s, cc))


@query("e_15_stale_epoch", duck(VIEWS, """
    SELECT carried, (concat(p, '/', t) <> carried)::int::bigint AS stale_epoch FROM (VALUES ('3/7'), ('right')) v(x),
        (SELECT count(*) FILTER (proven) AS p, count(*) AS t FROM fx_status WHERE claim <> 'CLAIM-21') s,
        (SELECT CASE WHEN x = 'right' THEN concat(p, '/', t) ELSE x END AS carried)""", STATUS))
def stale_epoch(spark, sf):
    """A workbook that carries an old count of proven claims, and one that carries the derived count."""
    from provlake.operators import answers as N
    s, cc = status(spark, sf), claim_controls(spark, sf)
    n = {r["measure"]: r["value"] for r in E.status_metrics(s, N.derive(s, cc), E.controls_evidenced(s, cc)).collect()}
    right = f"{n['application_proven']}/{n['application_claims']}"
    rows = [E.status_metrics(s, N.derive(s, cc), E.controls_evidenced(s, cc), carried=c).where(
        "measure = 'stale_epoch'").select(F.lit(c).alias("carried"), F.col("value").alias("stale_epoch"))
        for c in ("3/7", right)]
    return rows[0].unionByName(rows[1])


def _demo_key(spark):
    """A demonstration key, shipped to the tasks as a file; deployments name their own."""
    folder = scratch_path(spark, "key")
    spark.range(1).selectExpr("'demonstration key, not a secret' AS value").coalesce(
        1).write.text(folder)
    part = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
            .select("path").first()["path"])
    spark.sparkContext.addFile(part)
    return KeySource("demo", shipped=part.rsplit("/", 1)[-1])


@query("e_16_envelopes", duck(["fx_predicate"], """
    SELECT ledger_id, seq, event_id % 40 <> 7 AND event_id % 40 <> 8 AS ok,
        event_id % 40 <> 7 AS readable FROM fx_predicate"""))
def envelopes(spark, sf):
    key = _demo_key(spark)
    p = view(spark, sf, "fx_predicate").select("ledger_id", "seq", F.col("predicate").alias("statement"))
    env = E.sign_statements(p, key)
    bad = env.withColumn("envelope", F.when(F.col("seq") % 40 == 7, "{broken").when(
        F.col("seq") % 40 == 8, F.regexp_replace("envelope", '"sig": "....', '"sig": "AAAA')
    ).otherwise(F.col("envelope")))
    return E.verify_envelopes(bad, key).select(
        "ledger_id", "seq", "ok", (~F.col("reason").startswith("malformed")).alias("readable"))
