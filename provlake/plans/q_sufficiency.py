"""Registered queries: sufficiency regimes, answers, exports and audits."""

from pyspark.sql import functions as F

from provlake import vocab
from provlake.operators import answers as N
from provlake.operators import audit as M
from provlake.operators import export as X
from provlake.operators import sufficiency as Q
from provlake.plans import q_evidence as E
from provlake.plans.q_ledger import _VERDICT, _j, planted, predicates
from provlake.plans.registry import query
from provlake.session import cut_lineage
from provlake.sources.tables import duck, table, view


# ── regimes ─────────────────────────────────────────────────────────────────────────────────
def _missing(path):
    if path in vocab.ASSERTION_PATHS:
        return f"({_j(path)} IS NULL)"
    return f"coalesce({_j(path)} IN ('null', '\"\"', '[]', '{{}}'), true)"


_OP = "json_extract_string(predicate, '$.action.op')"
_PATHS = sorted({p for ps in vocab.REGIMES.values() for p in ps})
_ROWS = "fx_row AS MATERIALIZED (SELECT event_id, ledger_id, " + _OP + " AS opx, " + ", ".join(
    f"{_missing(p)} AS m{i}" for i, p in enumerate(_PATHS)) + " FROM fx_predicate)"


def _col(path):
    return f"m{_PATHS.index(path)}"


def _applies(r):
    kinds = vocab.REGIME_OPS.get(r)
    return "true" if kinds is None else "opx IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"


_REGIME = _ROWS + ", fx_regime AS (" + " UNION ALL ".join(
    f"SELECT event_id, ledger_id, '{r}' AS regime, {_applies(r)} AS app, "
    f"list_filter([{', '.join(f'''CASE WHEN {_col(p)} THEN '{p}' END''' for p in ps)}], "
    "lambda x: x IS NOT NULL) AS miss FROM fx_row" for r, ps in vocab.REGIMES.items()) + """),
fx_rollup AS (SELECT ledger_id, regime, count(*) FILTER (app AND len(miss) = 0) AS complete,
    count(*) FILTER (app) AS applicable, count(*) AS total FROM fx_regime GROUP BY ledger_id, regime)"""


@query("q_01_record_regimes", duck(["fx_predicate"], """
    SELECT event_id, regime, array_to_string(miss, ',') AS missing FROM fx_regime""", _REGIME))
def record_regimes(spark, sf):
    per = Q.regime_missing(F.col("pred"))
    rows = F.array(*[F.struct(F.lit(r).alias("regime"), F.array_join(c, ",").alias("missing"))
                     for r, c in per.items()])
    return predicates(spark, sf).select("event_id", F.inline(rows))


@query("q_02_regime_rollup", duck(["fx_predicate"], """
    SELECT ledger_id, regime, complete AS complete_records, applicable AS applicable_records,
        total AS total_records, total - applicable AS not_applicable,
        applicable > 0 AND complete = applicable AS fully_populated FROM fx_rollup""", _REGIME))
def regime_rollup(spark, sf):
    return Q.assess(predicates(spark, sf)).drop("missing")


_QUESTION = _REGIME + ", fx_q AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{q}', '{r}')" for q, rs in vocab.QUESTIONS.items() for r in rs) + ") t(question, regime))"


@query("q_03_questions", duck(["fx_predicate"], """
    SELECT ledger_id, question, array_to_string(list_sort(list(q.regime) FILTER (
            NOT (applicable > 0 AND complete = applicable))), ',') AS blocked_by,
        bool_and(applicable > 0 AND complete = applicable) AS answerable
    FROM fx_q q JOIN fx_rollup r ON r.regime = q.regime GROUP BY ledger_id, question""", _QUESTION))
def questions(spark, sf):
    out = Q.questions(Q.assess(predicates(spark, sf)))
    joined = F.array_join(F.array_sort("blocked_by"), ",")
    return out.select("ledger_id", "question",
                      F.when(joined != "", joined).alias("blocked_by"), "answerable")


@query("q_03_verdict", duck(["fx_predicate"], """
    SELECT ledger_id, count(*) FILTER (ok) AS answerable, count(*) AS questions_total,
        CASE WHEN bool_and(ok) THEN 'sufficient' ELSE 'incomplete' END AS verdict
    FROM (SELECT ledger_id, question, bool_and(applicable > 0 AND complete = applicable) AS ok
          FROM fx_q q JOIN fx_rollup r ON r.regime = q.regime GROUP BY ledger_id, question)
    GROUP BY ledger_id""", _QUESTION))
def verdict(spark, sf):
    return Q.verdict(Q.questions(Q.assess(predicates(spark, sf))))


_ORDER = "CASE path " + " ".join(f"WHEN '{p}' THEN {ps.index(p)}"
                                 for ps in vocab.REGIMES.values() for p in ps) + " END"


@query("q_04_gaps", duck(["fx_predicate"], f"""
    SELECT ledger_id, regime, path, records FROM (
        SELECT *, row_number() OVER (PARTITION BY ledger_id, regime ORDER BY records DESC, {_ORDER}) AS rn
        FROM (SELECT ledger_id, regime, path, count(*) AS records FROM (
            SELECT ledger_id, regime, unnest(miss) AS path FROM fx_regime WHERE app)
            GROUP BY ledger_id, regime, path)) WHERE rn <= 3""", _REGIME))
def gaps(spark, sf):
    return Q.gaps(Q.assess(predicates(spark, sf))).select("ledger_id", "regime", "path", "records")


# ── answers ─────────────────────────────────────────────────────────────────────────────────
_DERIVED = E.STATUS + f""", fx_pair AS (
    SELECT DISTINCT claim, control FROM (SELECT claim, control_a AS control FROM fx_claim
        UNION ALL SELECT claim, control_b FROM fx_claim)),
fx_found AS (SELECT control, list_sort(list(p.claim)) AS claims, list_sort(list(DISTINCT live_ref)) AS refs,
        string_agg(regexp_replace(statement, '\\.+$', ''), '; ' ORDER BY p.claim) AS st
    FROM fx_pair p JOIN fx_status s ON s.claim = p.claim
    WHERE proven AND p.claim <> 'CLAIM-21' GROUP BY control),
fx_answer AS (
    SELECT control, CASE WHEN control IN ('LOG-12', 'STA-09') THEN 'No' ELSE 'Yes' END AS answer,
        CASE control WHEN 'LOG-12' THEN '{vocab.NEGATIVE_CONTROLS["LOG-12"]}'
            WHEN 'STA-09' THEN '{vocab.NEGATIVE_CONTROLS["STA-09"]}' ELSE concat(st, '. Proven by ', len(refs),
            ' record(s) in this toolchain''s own keyed chain-of-custody ledger (', array_to_string(refs, ', '),
            '), each produced by an executable procedure and re-verified by `custody claims check`.') END AS implementation,
        array_to_string(claims, ',') AS claims, array_to_string(refs, ',') AS refs FROM fx_found
    UNION ALL
    SELECT c, 'No', why, '', '' FROM (VALUES ('LOG-12', '{vocab.NEGATIVE_CONTROLS["LOG-12"]}'),
        ('STA-09', '{vocab.NEGATIVE_CONTROLS["STA-09"]}')) t(c, why)
    WHERE c NOT IN (SELECT control FROM fx_found))"""


def derived(spark, sf):
    return N.derive(E.status(spark, sf), E.claim_controls(spark, sf))


@query("q_05_answers", duck(E.VIEWS, """
    SELECT control, answer, implementation, claims, refs FROM fx_answer""", _DERIVED))
def answers(spark, sf):
    return derived(spark, sf).select("control", "answer", "implementation",
                                     F.array_join("claims", ",").alias("claims"),
                                     F.array_join("refs", ",").alias("refs"))


_PROPOSED = "('IAM-AG-03', 'LOG-AG-01', 'LOG-AG-02', 'AG-GV.2', 'AG-GV.3')"


@query("q_06_published_counts", duck(E.VIEWS, f"""
    SELECT 'published_controls_answered' AS measure, count(*) AS value FROM fx_answer
        WHERE control NOT IN {_PROPOSED}
    UNION ALL SELECT 'proposed_controls_recorded', count(*) FROM fx_answer WHERE control IN {_PROPOSED}
    UNION ALL SELECT 'claims_proven', count(*) FROM fx_status WHERE proven AND claim <> 'CLAIM-21'
    UNION ALL SELECT 'claims_total', count(*) FROM fx_status WHERE claim <> 'CLAIM-21'""", _DERIVED))
def published_counts(spark, sf):
    return N.counts(derived(spark, sf), E.status(spark, sf))


@query("q_06_published", duck(E.VIEWS, f"""
    SELECT control, control NOT IN {_PROPOSED} AS published FROM fx_answer""", _DERIVED))
def published(spark, sf):
    d = derived(spark, sf)
    return N.published(d).select("control", F.lit(True).alias("published")).unionByName(
        N.proposed(d).select("control", F.lit(False).alias("published")))


def _stored(spark, sf):
    """Stored answers that went stale: one flips, one loses an owner, one loses refs, one is gone."""
    n = F.regexp_extract("control", "([0-9]+)$", 1).try_cast("int") % 5
    d = N.published(derived(spark, sf))
    return d.where(F.coalesce(n != 4, F.lit(True))).withColumns({
        "answer": F.when(n == 0, "No").otherwise(F.col("answer")),
        "ssrm": F.when(n == 1, "Not Determined").otherwise(F.col("ssrm")),
        "refs": F.when(n == 2, F.array(F.lit("sg:0:gone"))).otherwise(F.col("refs")),
        "implementation": F.when(n == 3, F.concat("implementation", F.lit("  "))).otherwise(
            F.col("implementation"))})


_STORED = _DERIVED + f""", fx_stored AS (SELECT *, coalesce(try_cast(regexp_extract(control, '([0-9]+)$', 1)
    AS int), 99) % 5 AS n FROM fx_answer WHERE control NOT IN {_PROPOSED})"""


@query("q_07_answer_drift", duck(E.VIEWS, """
    SELECT control, CASE n WHEN 4 THEN concat(control, ': derived from the ledger, missing from the file')
        WHEN 0 THEN concat(control, ': answer is ''No'', ledger derives ''', answer, '''')
        WHEN 1 THEN concat(control, ': ssrm is ''Not Determined'', ledger derives ''Owned by OSP''')
        WHEN 2 THEN concat(control, ': evidence refs differ from those the ledger derives') END AS finding
    FROM fx_stored WHERE n IN (1, 2, 4) OR (n = 0 AND answer = 'Yes')""", _STORED))
def answer_drift(spark, sf):
    return N.drift(_stored(spark, sf), N.published(derived(spark, sf)))


@query("q_08_evidence_counts", duck(E.VIEWS, """
    SELECT control, CASE WHEN n = 2 THEN 1 ELSE len(string_split(refs, ',')) END AS total,
        CASE WHEN n = 2 THEN 0 ELSE len(string_split(refs, ',')) END AS resolving,
        CASE WHEN n = 2 THEN 1 ELSE 0 END AS stale
    FROM fx_stored WHERE n <> 4 AND (n = 2 OR refs <> '')""", _STORED))
def evidence_counts(spark, sf):
    live = E.status(spark, sf).where("live_ref IS NOT NULL").select(F.col("live_ref").alias("ref"))
    return N.evidence_counts(_stored(spark, sf), live)


@query("q_09_fill", duck([*E.VIEWS, "fx_question"], """
    SELECT q.question_id, a.answer, a.implementation FROM fx_question q
    LEFT JOIN fx_answer a ON a.control = regexp_replace(q.question_id, '\\.[^.]*$', '')""", _DERIVED))
def fill(spark, sf):
    return N.fill_rows(view(spark, sf, "fx_question"), derived(spark, sf)).select(
        "question_id", "answer", "implementation")


@query("q_09_fill_refusals", duck([*E.VIEWS, "fx_question"], """
    SELECT control, 'control not present in the questionnaire' AS refusal FROM fx_answer
    WHERE control NOT IN (SELECT regexp_replace(question_id, '\\.[^.]*$', '') FROM fx_question)""",
                                   _DERIVED))
def fill_refusals(spark, sf):
    return N.fill_refusals(view(spark, sf, "fx_question"), derived(spark, sf))


# ── exports ─────────────────────────────────────────────────────────────────────────────────
def export_records(spark, sf):
    return X.export_view(predicates(spark, sf).select("ledger_id", "seq", F.col("pred").alias("body")))


@query("x_01_export_gate", duck(["fx_call"], f"""
    SELECT ledger_id, reason, cast(0 AS bigint) AS exported FROM ({_VERDICT}) WHERE broken_at IS NOT NULL
    UNION ALL SELECT ledger_id, NULL, records FROM ({_VERDICT}) WHERE broken_at IS NULL"""))
def export_gate(spark, sf):
    from provlake.operators import integrity as G
    p = planted(spark, sf)
    usable = G.verify(p).select("ledger_id", F.col("intact").alias("usable"), "reason")
    ok, refused = X.gate(p, usable)
    return ok.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("exported")).select(
        "ledger_id", F.lit(None).cast("string").alias("reason"), "exported").unionByName(
        refused.withColumn("exported", F.lit(0).cast("long")))


def _s(path):
    return f"json_extract_string(predicate, '$.{path}')"


_X = f"""fx_x AS MATERIALIZED (SELECT *, coalesce({_s('record.id')}, concat('seq-', seq)) AS rid,
        coalesce({_s('actor.agent_id')}, 'unknown') AS agent,
        json_extract(predicate, '$.resources.used') AS u, json_extract(predicate, '$.resources.generated') AS g
    FROM fx_predicate),
fx_ref AS (
    SELECT ledger_id, seq, rid, 0 AS side, json_extract_string(u, '$[0].artifact_id') AS id,
        json_extract_string(u, '$[0].path') AS path, NULL::varchar AS digest
    FROM fx_x WHERE coalesce(json_array_length(u), 0) > 0
    UNION ALL
    SELECT ledger_id, seq, rid, 1, json_extract_string(g, '$[0].artifact_id'),
        json_extract_string(g, '$[0].path'), json_extract_string(g, '$[0].digest')
    FROM fx_x WHERE coalesce(json_array_length(g), 0) > 0)"""


@query("x_02_prov_entities", duck(["fx_predicate"], """
    SELECT ledger_id, concat('sg:artifact/', id) AS entity, arg_max(path, seq * 2 + side) AS path,
        arg_max(coalesce(digest, '-'), seq * 2 + side) AS digest
    FROM fx_ref GROUP BY ledger_id, id""", _X))
def prov_entities(spark, sf):
    return X.prov(export_records(spark, sf))["entity"].select(
        "ledger_id", "entity", "path", F.coalesce("digest", F.lit("-")).alias("digest"))


@query("x_02_prov_activities", duck(["fx_predicate"], f"""
    SELECT ledger_id, concat('sg:activity/', rid) AS activity, {_s('record.at')} AS start_time,
        {_s('action.op')} AS op, outcome, {_s('policy.determining_policy')} AS determining_policy
    FROM fx_x""", _X))
def prov_activities(spark, sf):
    return X.prov(export_records(spark, sf))["activity"]


@query("x_02_prov_agents", duck(["fx_predicate"], f"""
    SELECT DISTINCT ledger_id, concat('sg:agent/', agent) AS agent, 'prov:SoftwareAgent' AS type FROM fx_x
    UNION ALL SELECT DISTINCT ledger_id, concat('sg:person/', {_s('actor.acted_on_behalf_of.human_id')}),
        'prov:Person' FROM fx_x WHERE {_s('actor.acted_on_behalf_of.human_id')} IS NOT NULL""", _X))
def prov_agents(spark, sf):
    return X.prov(export_records(spark, sf))["agent"].drop("agent_type")


@query("x_02_prov_relations", duck(["fx_predicate"], f"""
    SELECT ledger_id, seq, CASE side WHEN 0 THEN 'used' ELSE 'wasGeneratedBy' END AS relation,
        concat('sg:activity/', rid) AS subject, concat('sg:artifact/', id) AS object FROM fx_ref
    UNION ALL SELECT ledger_id, seq, 'wasAssociatedWith', concat('sg:activity/', rid),
        concat('sg:agent/', agent) FROM fx_x
    UNION ALL SELECT ledger_id, seq, 'actedOnBehalfOf', concat('sg:agent/', agent),
        concat('sg:person/', {_s('actor.acted_on_behalf_of.human_id')}) FROM fx_x
        WHERE {_s('actor.acted_on_behalf_of.human_id')} IS NOT NULL
    UNION ALL SELECT ledger_id, seq, 'wasDerivedFrom',
        concat('sg:artifact/', json_extract_string(predicate, '$.resources.derived_from[0].generated')),
        concat('sg:artifact/', json_extract_string(predicate, '$.resources.derived_from[0].source'))
        FROM fx_x WHERE json_extract(predicate, '$.resources.derived_from') IS NOT NULL""", _X))
def prov_relations(spark, sf):
    return X.prov_relations(export_records(spark, sf))


def case_records(spark, sf):
    """The export view for the case graph, which reads it twice: it is written once."""
    return cut_lineage(export_records(spark, sf).select(*X.CASE_COLUMNS))


@query("x_03_case_graph", duck(["fx_predicate"], """
    SELECT ledger_id, 'artifact' AS chain, concat('kb:artifact-', id) AS id,
        arg_min(path, seq * 2 + side) AS path FROM fx_ref GROUP BY ledger_id, id
    UNION ALL SELECT ledger_id, 'custody', concat('kb:custody-', rid), NULL FROM fx_x
    UNION ALL SELECT ledger_id, 'evidence', concat('kb:evidence-', rid), NULL FROM fx_x""", _X))
def case_graph(spark, sf):
    return X.case_graph(case_records(spark, sf)).select(
        "ledger_id", "chain", "id",
        F.get_json_object("node", "$['uco-core:hasFacet'][0]['uco-observable:filePath']").alias("path"))


def _q(x):
    """A JSON string or null."""
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE concat('\"', {x}, '\"') END"


_IDS = """'[', CASE WHEN coalesce(json_array_length({0}), 0) > 0 THEN concat('{{"@id":"kb:artifact-',
    json_extract_string({0}, '$[0].artifact_id'), '"}}') ELSE '' END, ']'"""


@query("x_03_case_nodes", duck(["fx_predicate"], f"""
    SELECT ledger_id, concat('kb:custody-', rid) AS id, concat('{{"@id":"kb:custody-', rid,
        '","@type":"uco-action:Action","uco-core:name":"custody-transfer","sg:chain":"custody","uco-action:startTime":',
        {_q(_s('record.at'))}, ',"uco-action:performer":{{"@id":"kb:agent-', agent,
        '","@type":"uco-identity:Identity","sg:operator":', {_q(_s('actor.operator.identity'))},
        ',"sg:actedOnBehalfOf":', {_q(_s('actor.acted_on_behalf_of.human_id'))}, '}},"sg:authority":{{"posture":',
        {_q(_s('authority.posture'))}, ',"capability":', coalesce(cast(json_extract(predicate, '$.authority.capability')
            AS varchar), 'null'), '}},"sg:alterations":[]}}') AS node FROM fx_x
    UNION ALL
    SELECT ledger_id, concat('kb:evidence-', rid), concat('{{"@id":"kb:evidence-', rid,
        '","@type":"uco-action:Action","uco-core:name":', {_q(_s('action.op'))}, ',"sg:chain":"evidence","sg:method":',
        {_q(_s('action.method.kind'))}, ',"sg:tool":', {_q(_s('action.tool.name'))},
        ',"sg:script":null,"uco-action:object":', {_IDS.format('u')}, ',"uco-action:result":', {_IDS.format('g')}, '}}')
    FROM fx_x
    UNION ALL
    SELECT ledger_id, concat('kb:artifact-', id), concat('{{"@id":"kb:artifact-', id,
        '","@type":"uco-observable:ObservableObject","sg:classification":[],"uco-core:hasFacet":[',
        '{{"@type":"uco-observable:FileFacet","uco-observable:filePath":"', path, '"}}', CASE WHEN digest = '-' THEN '' ELSE
            concat(',{{"@type":"uco-observable:ContentDataFacet","uco-observable:hash":[{{"@type":"uco-core:Hash",',
            '"uco-core:hashMethod":"SHA256","uco-core:hashValue":"', replace(digest, 'sha256:', ''), '"}}]}}') END, ']}}')
    FROM (SELECT ledger_id, id, arg_min(path, seq * 2 + side) AS path, arg_min(coalesce(digest, '-'), seq * 2 + side)
        AS digest FROM fx_ref GROUP BY ledger_id, id)""", _X))
def case_nodes(spark, sf):
    """The nodes themselves, as JSON text."""
    return X.case_graph(case_records(spark, sf)).select("ledger_id", "id", "node")


@query("x_04_spans", duck(["fx_predicate"], f"""
    SELECT ledger_id, seq, substr(sha256(concat('otel-id-v1:', session_id)), 1, 32) AS trace_id,
        substr(sha256(concat('otel-id-v1:', seq)), 1, 16) AS span_id, {_s('action.tool.name')} AS name,
        CASE WHEN outcome = 'deny' THEN 2 ELSE 1 END AS status_code,
        14 + CASE WHEN {_s('actor.agent_id')} IS NULL THEN 0 ELSE 1 END
            + CASE WHEN {_s('policy.determining_policy')} IS NULL THEN 0 ELSE 1 END
            + CASE WHEN {_s('decision.basis')} IS NULL THEN 0 ELSE 1 END
            + CASE WHEN {_s('verification.recorder')} IS NULL THEN 0 ELSE 1 END AS attributes
    FROM fx_x""", _X))
def spans(spark, sf):
    return X.spans(export_records(spark, sf)).select(
        "ledger_id", "seq", "trace_id", "span_id", "name", "status_code",
        F.size("attributes").cast("long").alias("attributes"))


# ── audits ──────────────────────────────────────────────────────────────────────────────────
#: Words of the generated prose stand in for call sites, the published patterns come on top.
_SITES = (*vocab.NETWORK_PATTERNS, ("socket", r"\b(the|and)\b"), ("prose", r"\bder\b"))


def _lines(spark, sf):
    return view(spark, sf, "fx_line")


def _allowed(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 7 = 0").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit("prose").alias("pattern"), F.lit("stated").alias("reason"))


def _duck_sites():
    pats = ", ".join("CASE WHEN regexp_matches(line, '" + p.replace("'", "''") + f"') THEN '{n}' END"
                     for n, p in _SITES)
    return f"""fx_site AS (SELECT path, line_no, pattern, text,
        (pattern = 'socket' AND regexp_matches(line, '\\bAF_UNIX\\b'))
        OR (pattern = 'prose' AND cast(split_part(path, '/', 2) AS bigint) % 7 = 0) AS allowed
    FROM (SELECT path, line_no, line, substr(trim(line), 1, 100) AS text,
        unnest(list_filter([{pats}], lambda x: x IS NOT NULL)) AS pattern FROM fx_line
        WHERE NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '"')))"""


@query("m_01_call_sites", duck(["fx_line"], """
    SELECT path, line_no, pattern, allowed FROM fx_site""", _duck_sites()))
def call_sites(spark, sf):
    return M.call_sites(_lines(spark, sf), _allowed(spark, sf), _SITES).select(
        "path", "line_no", "pattern", "allowed")


@query("m_01_offline_verdict", duck(["fx_line"], """
    SELECT count(*) AS sites, count(*) FILTER (NOT allowed) AS unexpected,
        bool_and(allowed) AS offline_by_default FROM fx_site""", _duck_sites()))
def offline_verdict(spark, sf):
    return M.offline_verdict(M.call_sites(_lines(spark, sf), _allowed(spark, sf), _SITES))


_SWAP = [(" the ", " THE "), ("ung", "UNG")]


@query("m_02_prefix_hits", duck(["fx_line"], """
    SELECT path, line_no FROM fx_line WHERE contains(line, ' the ') OR contains(line, 'ung')"""))
def prefix_hits(spark, sf):
    return M.prefix_hits(_lines(spark, sf), _SWAP).select("path", "line_no")


@query("m_02_rewrite", duck([], """
    SELECT d.doc_id, sha256(replace(replace(text, ' the ', ' THE '), 'ung', 'UNG')) AS digest,
        coalesce(n.n, 0) AS changed_lines
    FROM documents d LEFT JOIN (
        SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line
            FROM documents) WHERE contains(line, ' the ') OR contains(line, 'ung') GROUP BY doc_id) n
        ON n.doc_id = d.doc_id"""))
def rewrite(spark, sf):
    out = M.rewrite(table(spark, sf, "documents").select("doc_id", "text"), _SWAP)
    return out.select("doc_id", F.sha2("rewritten", 256).alias("digest"), "changed_lines")


@query("m_02_local_roots", duck([], """
    SELECT page_id, x AS root FROM (SELECT page_id, unnest(regexp_extract_all(concat(url, ' ', html),
        '(https?://[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1)) AS x FROM pages)"""))
def local_roots(spark, sf):
    lines = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("line"))
    return M.local_roots(lines, r"https?://[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+").select("page_id", "root")


@query("m_03_triage", duck(["fx_line"], """
    SELECT bucket, count(*) AS hits FROM (
        SELECT CASE WHEN cast(split_part(path, '/', 2) AS bigint) % 3 = 0 THEN 'not-shipped'
            WHEN ends_with(path, '7') OR ends_with(path, '11') THEN 'deliberate' ELSE 'real' END AS bucket
        FROM fx_line WHERE (contains(line, ' the ') OR contains(line, 'ung'))
            AND NOT starts_with(ltrim(line), '#')) GROUP BY bucket"""))
def triage(spark, sf):
    tracked = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    hits = M.prefix_hits(_lines(spark, sf), _SWAP)
    return M.triage(hits, tracked, ["7", "11"]).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("hits"))


@query("m_04_status_rollup", duck(["fx_finding"], """
    SELECT status, count(*) AS findings, count(*) FILTER (confidence = 'behavioural') AS behavioural,
        count(*) FILTER (confidence <> 'behavioural') AS structural FROM fx_finding GROUP BY status"""))
def status_rollup(spark, sf):
    return M.status_rollup(view(spark, sf, "fx_finding"))


@query("m_04_weak_ids", duck(["fx_finding"], """
    SELECT id FROM fx_finding WHERE status = 'ABSENT' AND confidence <> 'behavioural'
    ORDER BY id LIMIT 12"""))
def weak_ids(spark, sf):
    return M.weak_ids(view(spark, sf, "fx_finding"))


@query("m_05_outstanding", duck(["fx_finding"], """
    SELECT row_number() OVER (ORDER BY id) AS rank, id, title, severity FROM fx_finding
    WHERE status = 'PRESENT' AND (severity = 'CRITICAL' OR NOT EXISTS (SELECT 1 FROM fx_finding
        WHERE status = 'PRESENT' AND severity = 'CRITICAL')) ORDER BY id LIMIT 6"""))
def outstanding(spark, sf):
    return M.outstanding(view(spark, sf, "fx_finding")).withColumn("rank", F.col("rank").cast("long"))


@query("m_05_document_order", duck(["fx_finding"], """
    SELECT row_number() OVER (ORDER BY cast(substr(id, 3) AS int) DESC) AS rank, id, title, severity FROM fx_finding
    WHERE status = 'PRESENT' AND (severity = 'CRITICAL' OR NOT EXISTS (SELECT 1 FROM fx_finding
        WHERE status = 'PRESENT' AND severity = 'CRITICAL')) ORDER BY rank LIMIT 6"""))
def outstanding_in_order(spark, sf):
    """In the order of a document that lists the newest part first."""
    f = view(spark, sf, "fx_finding")
    return M.outstanding(f, order=F.substring("id", 3, 20).cast("int").desc()).withColumn(
        "rank", F.col("rank").cast("long"))


@query("m_05_outstanding_counts", duck(["fx_finding"], """
    SELECT count(*) FILTER (status = 'PRESENT') AS present, count(*) FILTER (status = 'ABSENT') AS fixed,
        count(*) FILTER (status = 'DYNAMIC') AS unverified, greatest(0, CASE WHEN count(*) FILTER (
            status = 'PRESENT' AND severity = 'CRITICAL') > 0 THEN count(*) FILTER (
            status = 'PRESENT' AND severity = 'CRITICAL') ELSE count(*) FILTER (status = 'PRESENT') END - 6) AS more
    FROM fx_finding"""))
def outstanding_counts(spark, sf):
    return M.outstanding_counts(view(spark, sf, "fx_finding"))


@query("m_06_to_file", duck(["fx_finding"], """
    SELECT id, concat(id, ': ', title) AS issue_title FROM fx_finding
    WHERE status IN ('PRESENT', 'DYNAMIC') AND severity <> 'LOW'"""))
def to_file(spark, sf):
    f = view(spark, sf, "fx_finding")
    known = f.where("severity = 'LOW'").select(F.concat("id", F.lit(": "), "title").alias("title"))
    return M.to_file(f, known).select("id", "issue_title")
