"""Registered queries: policy decisions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import labels as L
from provlake.functions.rules import condition
from provlake.operators import matching as M
from provlake.operators import policy as P
from provlake.operators import taint as T
from provlake.operators import validate as V
from provlake.plans import inputs as I
from provlake.plans.q_artifacts import link_rows
from provlake.plans.registry import ORACLES, query
from provlake.session import cut_lineage
from provlake.sources import ledger as S
from provlake.sources.tables import duck, table, view


@query("p_01_conditions", duck(["fx_call"], """
    SELECT event_id, tool = 'Bash' AS c_eq, outcome <> 'deny' AS c_ne, k >= 50 AS c_gte,
        k > 50 AS c_gt, k <= 10 AS c_lte, k < 10 AS c_lt, op IN ('artifact.read', 'x') AS c_in,
        list_contains(flags, 'pii') AS c_contains,
        len(list_intersect(flags, ['pii', 'credential'])) > 0 AS c_contains_any,
        regexp_matches(c.path, 'customers_[0-9]+') AS c_matches,
        (action_id IS NULL) AS c_null, (value > 20) AS c_true, NOT (value > 20) AS c_false,
        c.path LIKE '%notes%' AS c_substring
    FROM fx_call c JOIN fx_path p ON p.path = c.path""", I.DUCK_PATHS))
def conditions(spark, sf):
    from provlake.operators.artifacts import classify
    df = classify(view(spark, sf, "fx_call"))
    c, arr = F.col, "array"
    tests = {
        "c_eq": condition("eq", c("tool"), "Bash"), "c_ne": condition("ne", c("outcome"), "deny"),
        "c_gte": condition("gte", c("k"), 50), "c_gt": condition("gt", c("k"), 50),
        "c_lte": condition("lte", c("k"), 10), "c_lt": condition("lt", c("k"), 10),
        "c_in": condition("in", c("op"), ["artifact.read", "x"]),
        "c_contains": condition("contains", c("labels"), "pii", arr),
        "c_contains_any": condition("contains_any", c("labels"), ["pii", "credential"], arr),
        "c_matches": condition("matches", c("path"), "customers_[0-9]+"),
        "c_null": condition("eq", c("action_id"), None),
        "c_true": condition("is_true", c("value") > 20, True),
        "c_false": condition("is_false", c("value") > 20, True),
        "c_substring": condition("contains", c("path"), "notes")}
    return df.select("event_id", *[v.alias(k) for k, v in tests.items()])


#: Per-call facts and running state under recorded outcomes, then the published policy set.
_P02 = I.DUCK_RUNNING + """,
fx_state AS (
    SELECT c.*, p.rnk, p.flags, (p.rnk >= 2 OR len(p.flags) > 0) AS classified,
        coalesce(s.depth, 0) AS depth, coalesce(list_contains(s.flags, 'credential'), false) AS cred,
        NOT coalesce(s.has, false) AS first_touch,
        c.op = 'artifact.egress' AS is_egress, c.posture IN ('steer', 'bar') AS enforcing
    FROM fx_call c JOIN fx_path p ON p.path = c.path
    LEFT JOIN fx_seen s ON s.session_id = c.session_id AND s.seq = c.seq),
fx_match AS (
    SELECT *, list_filter([
        CASE WHEN enforcing AND is_egress AND cred THEN '30-classified#forbid-credential-egress' END,
        CASE WHEN enforcing AND is_egress AND depth >= 1 THEN '30-classified#forbid-tainted-egress' END,
        CASE WHEN enforcing AND depth >= 4 AND classified
            THEN '30-classified#forbid-accumulation-threshold' END,
        CASE WHEN posture = 'bar' AND classified THEN '40-bar#forbid-direct-classified-read' END],
        lambda x: x IS NOT NULL) AS forbids,
        posture = 'steer' AND classified AND first_touch AS asks,
        list_filter([
        CASE WHEN NOT classified THEN '10-base#allow-unclassified' END,
        CASE WHEN op = 'custody.checkpoint' THEN '10-base#allow-non-data-ops' END,
        CASE WHEN posture = 'observe' THEN '10-base#observe-records-does-not-block' END,
        CASE WHEN posture = 'steer' AND classified AND NOT first_touch
            THEN '20-steer#classified-subsequent-touch' END], lambda x: x IS NOT NULL) AS permits
    FROM fx_state),
fx_decision AS (
    SELECT *, CASE WHEN len(forbids) > 0 THEN forbids[1] WHEN asks
            THEN '20-steer#classified-first-touch' WHEN len(permits) > 0 THEN permits[1]
            ELSE 'default#deny-by-default' END AS determining_policy,
        CASE WHEN len(forbids) > 0 THEN 'deny' WHEN asks THEN 'ask' WHEN len(permits) > 0
            THEN 'allow' ELSE 'deny' END AS decision,
        CASE WHEN len(forbids) > 0 AND (asks OR len(permits) > 0) THEN concat('would have been ',
            array_to_string(CASE WHEN asks AND len(permits) > 0 AND permits[1] < '20'
                    THEN list_concat(permits, ['20-steer#classified-first-touch'])
                WHEN asks THEN list_concat(['20-steer#classified-first-touch'], permits)
                ELSE permits END, ', '), ' but forbid overrides')
            WHEN asks AND len(permits) > 0 THEN concat('would have been ',
                array_to_string(permits, ', '), ' but ask overrides') ELSE '' END AS counterfactual
    FROM fx_match)"""


def _state(spark, sf):
    from provlake.operators.artifacts import classify
    recs = I.records(spark, sf)
    rows = classify(view(spark, sf, "fx_call")).drop("matched_rules", "sources", "outcome")
    return T.running_state(T.select_effects(recs), rows).withColumns({
        "is_egress": F.col("op") == "artifact.egress", "is_write": F.lit(False),
        "is_own_binary": F.lit(False), "is_ledger": F.lit(False)})


def _decided(spark, sf):
    return P.decide(_state(spark, sf), F.col("op"), F.col("posture"), P.call_context())


@query("p_02_decision", duck(["fx_call"], """
    SELECT event_id, decision AS outcome, determining_policy, counterfactual FROM fx_decision""",
                             _P02))
def decision(spark, sf):
    return _decided(spark, sf).select("event_id", "outcome", "determining_policy",
                                      "counterfactual")


#: A policy for every part: scope, depth, labels and first touch by its number.
_PART_POLICIES = """SELECT cast(p_partkey AS int) AS ord, concat('part#', cast(p_partkey AS string)) AS id,
    CASE p_partkey % 3 WHEN 0 THEN 'forbid' WHEN 1 THEN 'ask' ELSE 'permit' END AS effect,
    concat('{{"session.taint_depth": {{"gte": ', cast(p_size % 9 AS string), ', "ne": ', cast(p_size % 5 AS string),
        '}}, "artifact.classified": ', CASE WHEN p_partkey % 11 < 9 THEN 'true' ELSE 'false' END,
        CASE p_partkey % 7 WHEN 0 THEN ', "artifact.labels": {{"contains": "pii"}}'
            WHEN 1 THEN ', "artifact.labels": {{"contains_any": ["credential", "regulated"]}}'
            WHEN 2 THEN ', "artifact.first_touch": {{"is_true": true}}'
            WHEN 3 THEN ', "artifact.first_touch": {{"is_false": true}}' ELSE '' END, '}}') AS when_json,
    concat('because of part ', cast(p_partkey AS string)) AS reason,
    CASE p_partkey % 4 WHEN 0 THEN array('artifact.egress') WHEN 1 THEN array('artifact.read', 'artifact.write')
        ELSE cast(array() AS array<string>) END AS actions,
    CASE p_partkey % 5 WHEN 0 THEN array('bar') WHEN 1 THEN array('steer', 'observe') ELSE cast(array() AS array<string>) END AS postures,
    '' AS guidance, cast(p_size % 4 AS int) AS priority FROM {part}"""


@query("p_02_policy_table", duck(["fx_call"], """
    SELECT event_id, CASE prec WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' WHEN 1 THEN 'allow' ELSE 'deny' END AS outcome,
        coalesce(id, 'default#deny-by-default') AS determining_policy,
        coalesce('because of part ' || substr(id, 6), 'no policy permitted this action — deny by default') AS reason,
        coalesce(n_over, 0) AS overridden, sha256(CASE WHEN n_over > 0 THEN concat('would have been ', over, ' but ',
            ['permit', 'ask', 'forbid'][prec], ' overrides') ELSE '' END) AS counterfactual_sha256
    FROM fx_state LEFT JOIN (
        SELECT event_id, any_value(top) AS prec, any_value(id) FILTER (score = best) AS id,
            count(*) FILTER (prec < top) AS n_over, string_agg(id, ', ' ORDER BY ord) FILTER (prec < top) AS over
        FROM (SELECT *, max(score) OVER w AS best, max(prec) OVER w AS top FROM fx_fire
            WINDOW w AS (PARTITION BY event_id)) GROUP BY event_id) USING (event_id)""", _P02 + """,
fx_pol AS (SELECT p_partkey AS ord, concat('part#', p_partkey) AS id, 3 - p_partkey % 3 AS prec, p_size % 4 AS priority,
    p_size % 9 AS least, p_size % 5 AS other FROM part),
fx_fire AS (SELECT event_id, ord, id, prec, prec * 1000000000000::bigint + priority * 1000000000::bigint - ord AS score
    FROM fx_state JOIN fx_pol ON depth >= least AND depth <> other AND classified = (ord % 11 < 9)
        AND CASE ord % 7 WHEN 0 THEN list_contains(flags, 'pii')
            WHEN 1 THEN list_has_any(flags, ['credential', 'regulated']) WHEN 2 THEN classified AND first_touch
            WHEN 3 THEN NOT (classified AND first_touch) ELSE true END
        AND CASE ord % 4 WHEN 0 THEN op = 'artifact.egress' WHEN 1 THEN op IN ('artifact.read', 'artifact.write')
            ELSE true END
        AND CASE ord % 5 WHEN 0 THEN posture = 'bar' WHEN 1 THEN posture IN ('steer', 'observe') ELSE true END)"""))
def decision_by_table(spark, sf):
    """One policy for every part."""
    parts = spark.sql(_PART_POLICIES, part=table(spark, sf, "part"))
    read = ["event_id", "op", "posture", "taint", "taint_depth", "artifacts_touched", "since_last_egress", "classified",
            "labels", "first_touch", "is_ledger", "is_egress", "is_write", "is_own_binary"]
    # The state is read twice: for the situations and for the calls that are in them.
    state = cut_lineage(_state(spark, sf).select(*read))
    return M.decide_by_table(state, F.col("op"), F.col("posture"), P.call_context(), parts, {
        "overridden": F.regexp_count("counterfactual", F.lit("part#")).cast("long"),
        "counterfactual_sha256": F.sha2("counterfactual", 256)}).select(
        "event_id", "outcome", "determining_policy", "reason", "overridden", "counterfactual_sha256")


@query("p_03_policy_pin", duck(["fx_call"], f"""
    SELECT profile, mismatch, CASE WHEN mismatch THEN concat('POLICY SET MISMATCH: loaded ',
        '{P.set_digest(vocab.POLICIES)[:16]}', ', pinned other') END AS detail
    FROM (SELECT DISTINCT project AS profile, user_id % 7 IN (1, 4) AS mismatch FROM fx_call)"""))
def policy_pin(spark, sf):
    profiles = view(spark, sf, "fx_call").select(F.col("project").alias("profile")).distinct()
    digest = P.set_digest(vocab.POLICIES)
    pins = profiles.where("profile <> 'p2'").withColumn("expected_digest", F.when(
        F.col("profile").isin("p1", "p4"), "other").otherwise(F.lit(digest)))
    return P.pin_findings(profiles.withColumn("digest", F.lit(digest)), pins).select(
        "profile", "mismatch", "detail")


_LAYERS = """
    CASE k % 5 WHEN 0 THEN 'observe' WHEN 1 THEN 'steer' WHEN 2 THEN 'bar' WHEN 3 THEN 'loud' END
        AS project_posture,
    CASE event_id % 4 WHEN 0 THEN 'steer' WHEN 1 THEN 'bar' WHEN 2 THEN 'x' END AS profile_posture,
    CASE event_id % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'nope' END AS legacy_posture,
    CASE event_id % 7 WHEN 0 THEN 'bar' WHEN 1 THEN 'steer' WHEN 2 THEN 'off' END AS managed_posture"""


@query("p_04_posture", duck(["fx_call"], """
    SELECT event_id, CASE
            WHEN want IS NULL THEN coalesce(floor_p, 'observe')
            WHEN floor_p IS NOT NULL AND list_position(['observe', 'steer', 'bar'], want)
                < list_position(['observe', 'steer', 'bar'], floor_p) THEN floor_p
            ELSE want END AS effective_posture,
        CASE WHEN coalesce(a, b) IS NOT NULL AND floor_p IS NOT NULL AND
                list_position(['observe', 'steer', 'bar'], coalesce(a, b))
                < list_position(['observe', 'steer', 'bar'], floor_p) THEN 'managed policy'
            WHEN a IS NOT NULL THEN 'project config' WHEN b IS NOT NULL THEN 'profile config'
            WHEN c IS NOT NULL THEN 'legacy state file'
            WHEN floor_p IS NOT NULL THEN 'managed policy' ELSE 'default' END AS posture_source
    FROM (SELECT *, coalesce(a, b, c) AS want FROM (
        SELECT event_id, CASE WHEN project_posture <> 'loud' THEN project_posture END AS a,
            CASE WHEN profile_posture <> 'x' THEN profile_posture END AS b,
            CASE WHEN legacy_posture <> 'nope' THEN legacy_posture END AS c,
            CASE WHEN managed_posture <> 'off' THEN managed_posture END AS floor_p
        FROM fx_layer))""", f"fx_layer AS (SELECT event_id, {_LAYERS} FROM fx_call)"))
def posture(spark, sf):
    layers = view(spark, sf, "fx_call").selectExpr("event_id", *[
        x.strip().rstrip(",") for x in _LAYERS.replace("END\n        AS", "END AS").split(",\n")])
    return P.resolve_posture(layers).select("event_id", "effective_posture", "posture_source")


@query("p_05_downgrade", duck(["fx_call"], """
    SELECT event_id, CASE WHEN decision = 'ask' AND permission_mode IN ('bypassPermissions',
            'acceptEdits') THEN 'allow' ELSE decision END AS outcome,
        CASE WHEN decision = 'ask' AND permission_mode IN ('bypassPermissions', 'acceptEdits')
            THEN 'ask' END AS downgraded_from,
        CASE WHEN regexp_matches(command, 'git\\s+push|curl[^|]*(-X\\s*POST)|\\b(scp)\\b.*:|\\baws\\s+s3\\b.*\\bcp\\b')
            THEN 'artifact.egress' WHEN tool = 'Write' THEN 'artifact.write' ELSE 'artifact.read'
            END AS derived_op
    FROM fx_decision""", _P02))
def downgrade(spark, sf):
    from provlake.operators.artifacts import egress
    out = egress(P.downgrade(_decided(spark, sf)).drop("is_egress"))
    return out.select("event_id", "outcome", "downgraded_from",
                      P.op_for(F.col("tool"), F.col("is_egress")).alias("derived_op"))


# One step of the recursion per relevant call; the state is carried in lists.
_P06 = f"""
fx_arg AS (SELECT *, CASE WHEN tool <> 'Bash' THEN path END AS file_path,
    CASE WHEN tool = 'Bash' THEN command ELSE '' END AS cmd FROM fx_call),
fx_fact AS (
    SELECT session_id, seq, posture, permission_mode, tool = 'Write' AS is_write,
        regexp_matches(cmd, 'git\\s+push|curl[^|]*(-X\\s*POST)|\\b(scp)\\b.*:|\\baws\\s+s3\\b.*\\bcp\\b')
            AS is_egress,
        CASE WHEN tool <> 'Bash' THEN path
            WHEN event_id % 12 IN (3, 7) THEN path
            WHEN event_id % 12 = 9 THEN '/etc/passwd'
            WHEN event_id % 12 = 11 THEN './customers.csv' ELSE NULL END AS p,
        event_id FROM fx_arg),
fx_lab AS (
    SELECT *, CASE WHEN p IS NOT NULL THEN {I.duck_rank('p')} ELSE 0 END AS rnk,
        CASE WHEN p IS NOT NULL THEN {I.duck_flags('p')} ELSE [] END AS flags FROM fx_fact),
fx_rel AS (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n
    FROM (SELECT *, rnk >= 2 OR len(flags) > 0 AS classified FROM fx_lab)
    WHERE classified OR is_egress),
fx_fold AS (
    SELECT session_id, 0::bigint AS n, NULL::bigint AS seq, []::varchar[] AS held, false AS cred,
        ''::varchar AS outcome, ''::varchar AS pol, 0::bigint AS depth_before,
        0::bigint AS touched, 0::bigint AS since, 0::bigint AS since_before
    FROM (SELECT DISTINCT session_id FROM fx_rel)
    UNION ALL
    SELECT session_id, n, seq,
        CASE WHEN classified AND outcome <> 'deny' AND NOT list_contains(held, p)
            THEN list_append(held, p) ELSE held END,
        cred OR (classified AND outcome <> 'deny' AND list_contains(flags, 'credential')),
        outcome, pol, len(held),
        touched + CASE WHEN classified AND outcome <> 'deny' THEN 1 ELSE 0 END,
        CASE WHEN classified AND outcome <> 'deny' THEN since + 1
            WHEN NOT classified AND outcome = 'allow' THEN 0 ELSE since END, since
    FROM (
        SELECT *, CASE
            WHEN pol LIKE '%#forbid%' OR pol LIKE 'default%' THEN 'deny'
            WHEN pol = '20-steer#classified-first-touch' AND permission_mode NOT IN
                ('bypassPermissions', 'acceptEdits') THEN 'ask' ELSE 'allow' END AS outcome
        FROM (
            SELECT r.session_id, r.n, r.seq, r.classified, r.flags, r.p, r.permission_mode,
                f.held, f.cred, f.touched, f.since,
                CASE WHEN r.posture <> 'observe' AND r.is_egress AND f.cred
                    THEN '30-classified#forbid-credential-egress'
                WHEN r.posture <> 'observe' AND r.is_egress AND len(f.held) >= 1
                    THEN '30-classified#forbid-tainted-egress'
                WHEN r.posture <> 'observe' AND len(f.held) >= 4 AND r.classified
                    THEN '30-classified#forbid-accumulation-threshold'
                WHEN r.posture = 'bar' AND r.classified THEN '40-bar#forbid-direct-classified-read'
                WHEN r.posture = 'steer' AND r.classified AND NOT list_contains(f.held, r.p)
                    THEN '20-steer#classified-first-touch'
                WHEN NOT r.classified THEN '10-base#allow-unclassified'
                WHEN r.posture = 'observe' THEN '10-base#observe-records-does-not-block'
                WHEN r.posture = 'steer' THEN '20-steer#classified-subsequent-touch'
                ELSE 'default#deny-by-default' END AS pol
            FROM fx_fold f JOIN fx_rel r ON r.session_id = f.session_id AND r.n = f.n + 1)))"""


@query("p_06_replay", duck(["fx_call"], """
    SELECT session_id, seq, outcome, pol AS determining_policy, depth_before AS taint_depth,
        since_before AS since_last_egress FROM fx_fold WHERE n > 0""", _P06, recursive=True))
def replay(spark, sf):
    calls = view(spark, sf, "fx_call").withColumn(
        "file_path", F.when(F.col("tool") != "Bash", F.col("path"))).drop(
            "op", "outcome", "path", "artifact_id", "out_path", "out_id", "props")
    return P.replay(P.call_facts(calls)).select(
        "session_id", "seq", "outcome", "determining_policy", "taint_depth", "since_last_egress")


#: Egress needs two touches since the last one, so every decision hangs on the one before it.
_ALTERNATING = [
    vocab.Policy("a#forbid-hasty-egress", "forbid",
                 {"call.is_egress": True, "session.since_last_egress": {"lt": 2}}),
    vocab.Policy("b#permit", "permit")]


@query("p_06_long_dependency", duck(["fx_call"], """
    SELECT session_id, seq, outcome, since_before AS since_last_egress FROM fx_hasty WHERE n > 0""",
    _P06.split("fx_fold AS (")[0] + """
fx_hasty AS (
    SELECT session_id, 0::bigint AS n, NULL::bigint AS seq, ''::varchar AS outcome,
        0::bigint AS since, 0::bigint AS since_before FROM (SELECT DISTINCT session_id FROM fx_rel)
    UNION ALL
    SELECT r.session_id, r.n, r.seq,
        CASE WHEN r.is_egress AND f.since < 2 THEN 'deny' ELSE 'allow' END,
        CASE WHEN r.is_egress AND f.since < 2 THEN f.since WHEN r.classified THEN f.since + 1 ELSE 0 END,
        f.since
    FROM fx_hasty f JOIN fx_rel r ON r.session_id = f.session_id AND r.n = f.n + 1)""",
    recursive=True))
def long_dependency(spark, sf):
    calls = view(spark, sf, "fx_call").withColumn(
        "file_path", F.when(F.col("tool") != "Bash", F.col("path"))).drop(
            "op", "outcome", "path", "artifact_id", "out_path", "out_id", "props")
    return P.replay(P.call_facts(calls), _ALTERNATING).select(
        "session_id", "seq", "outcome", "since_last_egress")


def linked_calls(calls):
    """Calls that name their file by a link to a link to it."""
    return calls.withColumn("file_path", F.when(
        F.col("tool") != "Bash", F.concat(F.lit("/lnk/f"), F.col("k").cast("string")))).drop(
            "op", "outcome", "path", "artifact_id", "out_path", "out_id", "props")


@query("p_06_linked", ORACLES["p_06_replay"])
def replay_linked(spark, sf):
    """The same calls through links decide the same."""
    facts = P.call_facts(linked_calls(view(spark, sf, "fx_call")), links=link_rows(spark, sf))
    return P.replay(facts).select(
        "session_id", "seq", "outcome", "determining_policy", "taint_depth", "since_last_egress")


@query("p_06_aliases", duck(["fx_call"], f"""
    SELECT session_id, seq, concat('/lnk/f', cast(k AS string)) AS given, c.path AS resolves_to,
        p.labels AS labels_gained
    FROM fx_call c JOIN fx_path p ON p.path = c.path
    WHERE tool <> 'Bash' AND (rnk >= 2 OR len(flags) > 0)""", I.DUCK_PATHS))
def aliases(spark, sf):
    facts = P.call_facts(linked_calls(view(spark, sf, "fx_call")), links=link_rows(spark, sf))
    return facts.select("session_id", "seq", F.inline("aliases")).withColumn(
        "labels_gained", L.text(F.col("labels_gained")))


@query("p_06_records", duck(["fx_call"], """
    SELECT f.session_id, f.seq, f.n - 1 AS ledger_seq, f.outcome, f.pol AS determining_policy, f.depth_before AS taint_depth,
        'chain-only' AS strength, 0 AS problems, true AS accepted FROM fx_fold f WHERE n > 0""", _P06, recursive=True))
def decision_records(spark, sf):
    """Every decision's record has no problem and goes into the ledger of its session."""
    calls = view(spark, sf, "fx_call").withColumn(
        "file_path", F.when(F.col("tool") != "Bash", F.col("path"))).drop(
            "op", "outcome", "path", "artifact_id", "out_path", "out_id", "props")
    # Facts and records are read twice each: they are written once.
    facts = cut_lineage(P.call_facts(calls))
    recs = cut_lineage(P.decision_records(facts, P.replay(facts), P.set_digest(vocab.POLICIES), at="at_iso").select(
        "session_id", "seq", "record_id", "event", F.size("problems").alias("problems")))
    good, _ = V.split_events(recs.select(F.col("session_id").alias("ledger_id"), F.col("seq").alias("ord"), "event"))
    chained = S.append(S.admit(good)[0])
    body = F.parse_json("raw")
    get = lambda p, t: F.try_variant_get(body, p, t)
    stored = chained.select(
        F.col("ledger_id").alias("session_id"), F.col("seq").alias("ledger_seq"), get("$.outcome", "string").alias("outcome"),
        get("$.statement.predicate.policy.determining_policy", "string").alias("determining_policy"),
        get("$.statement.predicate.decision.basis.taint_depth", "long").alias("taint_depth"),
        get("$.statement.predicate.verification.strength", "string").alias("strength"),
        get("$.statement.predicate.record.id", "string").alias("record_id"))
    ids = recs.select("session_id", "seq", "record_id", "problems")
    n = F.row_number().over(W.partitionBy("session_id").orderBy("seq")) - 1
    return ids.withColumn("ledger_seq", n.cast("long")).join(stored, ["session_id", "ledger_seq"]).select(
        "session_id", "seq", "ledger_seq", "outcome", "determining_policy", "taint_depth", "strength", "problems",
        (ids["record_id"] == stored["record_id"]).alias("accepted"))
