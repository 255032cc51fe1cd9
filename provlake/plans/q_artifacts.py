"""Registered queries: artifacts and labels."""

import json

from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import labels as L
from provlake.operators import artifacts as A
from provlake.operators.policy import load_handlers
from provlake.plans import inputs as I
from provlake.plans.registry import ORACLES, query
from provlake.session import scratch_path
from provlake.sources.tables import duck, table, view

_IDS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def _duck_ids(x, rules):
    return _IDS.format(", ".join(
        f"CASE WHEN {I.duck_match(x, r.pattern)} THEN '{r.id}' END" for r in rules))


@query("c_01_classify_paths", duck(["fx_call"], f"""
    SELECT event_id, p.path, p.labels, rules, (rnk >= 2 OR len(flags) > 0) AS classified
    FROM fx_call c JOIN (SELECT *, {_duck_ids('path', vocab.classify_rules())} AS rules
                         FROM fx_path) p ON p.path = c.path""", I.DUCK_PATHS))
def classify_paths(spark, sf):
    return A.classify(view(spark, sf, "fx_call")).select(
        "event_id", "path", L.text(F.col("labels")).alias("labels"),
        F.array_join("matched_rules", ",").alias("rules"), "classified")


@query("c_01_classify_urls", f"""
    SELECT page_id, url, {_duck_ids('url', vocab.classify_rules())} AS rules,
        {I.duck_labels(I.duck_rank('url'), I.duck_flags('url'))} AS labels FROM pages""")
def classify_urls(spark, sf):
    return A.classify(table(spark, sf, "pages").select("page_id", "url"), "url").select(
        "page_id", "url", F.array_join("matched_rules", ",").alias("rules"),
        L.text(F.col("labels")).alias("labels"))


@query("c_01_rule_table", duck(["fx_call"], """
    SELECT count(*) AS n, p.labels FROM fx_call c JOIN fx_path p ON p.path = c.path
    GROUP BY p.labels""", I.DUCK_PATHS))
def classify_rule_table(spark, sf):
    rules = spark.createDataFrame(
        [(r.id, r.pattern, list(r.labels)) for r in vocab.classify_rules()],
        "id string, pattern string, labels array<string>")
    out = A.classify_by_table(view(spark, sf, "fx_call"), rules, ["event_id"])
    return out.groupBy(L.text(F.col("labels")).alias("labels")).agg(
        F.count(F.lit(1)).alias("n"))


#: A rule for every part: its number after a kind of name that the calls' paths have, or none of them.
_PART_RULES = """SELECT concat('P', cast(p_partkey AS string)) AS id, p_partkey AS ord,
    concat(CASE p_partkey % 4 WHEN 0 THEN '(^|/)(roster|customers)_' WHEN 1 THEN '/(n|m)' WHEN 2 THEN 'API_keys_'
        ELSE 'dump_?' END, cast(p_partkey % 97 AS string), '{dot}(csv|md|py|txt|sql)$') AS pattern,
    CASE p_partkey % 3 WHEN 0 THEN {a}'pii', 'internal'{z} WHEN 1 THEN {a}'restricted'{z} ELSE {a}'regulated'{z}
        END AS labels FROM {part}"""
_DUCK_PARTS = "fx_part AS (" + _PART_RULES.format(dot="\\.", a="[", z="]", part="part") + """),
    fx_hit AS (SELECT path, p.* EXCLUDE (labels), p.labels AS given FROM fx_path
        JOIN fx_part p ON regexp_matches(path, pattern, 'i'))"""


def part_rules(spark, sf):
    return spark.sql(_PART_RULES.format(dot="\\\\.", a="array(", z=")", part="{part}"),
                     part=table(spark, sf, "part"))


@query("c_01_large_rule_table", duck(["fx_call"], """
    SELECT event_id, coalesce(ids, '') AS rules, coalesce(l, 'public') AS labels
    FROM fx_call c LEFT JOIN (SELECT path, string_agg(id, ',' ORDER BY id) AS ids,
        CASE WHEN bool_or(list_contains(given, 'restricted')) THEN
            CASE WHEN bool_or(list_contains(given, 'pii')) THEN CASE WHEN bool_or(list_contains(given, 'regulated'))
                THEN 'pii,regulated,restricted' ELSE 'pii,restricted' END
            WHEN bool_or(list_contains(given, 'regulated')) THEN 'regulated,restricted' ELSE 'restricted' END
        WHEN bool_or(list_contains(given, 'pii')) THEN CASE WHEN bool_or(list_contains(given, 'regulated'))
            THEN 'internal,pii,regulated' ELSE 'internal,pii' END ELSE 'public,regulated' END AS l
        FROM fx_hit GROUP BY path) h ON h.path = c.path""", I.DUCK_PATHS + ", " + _DUCK_PARTS))
def classify_large_table(spark, sf):
    """One rule for every part over the paths of all calls. The lists of rules, long where parts are many, are
    written once a path."""
    calls = view(spark, sf, "fx_call").select("event_id", "path")
    found = A.classify_by_table(calls.select("path").distinct(), part_rules(spark, sf), ["path"]).select(
        F.col("path").alias("_path"), F.array_join("matched_rules", ",").alias("rules"),
        L.text(F.col("labels")).alias("labels"))
    return calls.join(found, F.col("path").eqNullSafe(F.col("_path"))).select("event_id", "rules", "labels")


@query("c_02_rule_table", duck(["fx_call"], f"""
    SELECT event_id, array_to_string(list_sort(string_split({_duck_ids('command', vocab.EGRESS_RULES)}, ',')), ',')
        AS rules, {_duck_ids('command', vocab.EGRESS_RULES)} <> '' AS is_egress FROM fx_call"""))
def egress_rule_table(spark, sf):
    rules = spark.createDataFrame([(r.id, r.pattern, r.reason) for r in vocab.EGRESS_RULES],
                                  "id string, pattern string, reason string")
    return A.egress_by_table(view(spark, sf, "fx_call").select("event_id", "command"), rules).select(
        "event_id", F.array_join("egress_rules", ",").alias("rules"), "is_egress")


@query("c_02_egress", duck(["fx_call"], f"""
    SELECT event_id, command, {_duck_ids('command', vocab.EGRESS_RULES)} AS rules,
        {_duck_ids('command', vocab.EGRESS_RULES)} <> '' AS is_egress FROM fx_call"""))
def egress(spark, sf):
    return A.egress(view(spark, sf, "fx_call")).select(
        "event_id", "command", F.array_join("egress_rules", ",").alias("rules"), "is_egress")


def _duck_mentions():
    """Mention lists of a call; RE2 has no need of look-around here."""
    pats = [p.replace("'", "''") for p in vocab.COMMAND_PATH_PATTERNS]
    found = ", ".join(f"regexp_extract_all(cmd, '{p}', 1)" for p in pats)
    concat = f"list_concat(list_concat({found.split(', regexp')[0]}, regexp{found.split(', regexp')[1]}), regexp{found.split(', regexp')[2]})"
    return f"""fx_cmd AS (SELECT event_id, path, tool, CASE WHEN tool = 'Bash' THEN command ELSE ''
        END AS cmd FROM fx_call),
    fx_found AS (SELECT event_id, list_concat(CASE WHEN tool = 'Bash' THEN [] ELSE [path] END,
        {concat}) AS l FROM fx_cmd),
    fx_mention AS (SELECT event_id, x AS path, min(i) AS i FROM (
        SELECT event_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM fx_found)
        GROUP BY event_id, x)"""


def mention_rows(spark, sf):
    calls = view(spark, sf, "fx_call").withColumn(
        "file_path", F.when(F.col("tool") != "Bash", F.col("path"))).drop("path")
    return A.mentions(calls, ["event_id"], path_args=["file_path"])


@query("c_03_mentions", duck(["fx_call"], """
    SELECT event_id, path, row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS pos
    FROM fx_mention""", _duck_mentions()))
def mentions(spark, sf):
    return mention_rows(spark, sf).select("event_id", "path", F.col("pos").cast("long").alias("pos"))


_ALIAS = """fx_given AS (SELECT event_id, CASE WHEN event_id % 3 = 0
        THEN concat('/tmp/link_', cast(k AS string), '.txt') ELSE path END AS given,
        path AS canonical FROM fx_call)"""


def alias_rows(spark, sf):
    """Calls that present two spellings of their artifact, one of them possibly a link."""
    c = view(spark, sf, "fx_call")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(
        F.lit("/tmp/link_"), F.col("k").cast("string"), F.lit(".txt"))).otherwise(F.col("path"))
    links = c.select(given.alias("path"), F.col("path").alias("canonical_path")).where(
        "path <> canonical_path").groupBy("path").agg(
            F.min("canonical_path").alias("canonical_path"))
    rows = c.select("event_id", F.posexplode(F.array(given, F.concat(
        F.lit("/notes/../"), F.col("k").cast("string"), F.lit("/secret.env")))
    ).alias("pos", "path"))
    return A.with_aliases(rows, links)


@query("c_04_worst_input", duck(["fx_call"], f"""
    SELECT event_id, path, canonical_path, {I.duck_labels('rnk', 'flags')} AS labels, aliases
    FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, pos) AS rn,
            string_agg(CASE WHEN finding THEN path END, ',' ORDER BY path) OVER (PARTITION BY event_id) AS aliases
          FROM (SELECT *, 1 + len(flags) AS n FROM fx_both WHERE rnk >= 2 OR len(flags) > 0)
    ) WHERE rn = 1""", _ALIAS + f""", fx_link AS (
        SELECT given AS path, min(canonical) AS canonical_path FROM fx_given
        WHERE given <> canonical GROUP BY given),
    fx_in AS (
        SELECT event_id, 0 AS pos, given AS path FROM fx_given
        UNION ALL
        SELECT event_id, 1 AS pos, concat('/notes/../', cast(k AS string), '/secret.env') FROM fx_call),
    fx_canon AS (SELECT i.*, coalesce(l.canonical_path, replace(i.path, '/notes/..', ''))
        AS canonical_path FROM fx_in i LEFT JOIN fx_link l ON l.path = i.path),
    fx_both AS (SELECT *, {I.duck_rank('canonical_path')} AS rnk,
        {I.duck_flags('canonical_path')} AS flags,
        path <> canonical_path AND ({I.duck_rank('path')} < 2 AND len({I.duck_flags('path')}) = 0)
            AND ({I.duck_rank('canonical_path')} >= 2 OR len({I.duck_flags('canonical_path')}) > 0)
            AS finding FROM fx_canon)"""))
def worst_input(spark, sf):
    # A link's public spelling adds the label "public" to the raw union; the set is normalised here.
    out = A.worst_input(alias_rows(spark, sf).withColumn(
        "labels", L.join_sets(F.col("labels"))), ["event_id"])
    return out.select("event_id", "path", "canonical_path", L.text(F.col("labels")).alias("labels"),
                      F.when(F.size("aliases") > 0, F.array_join("aliases", ",")).alias("aliases"))


#: Links over the calls' files: a chain of three through folders, a chain to the file, a loop, and a
#: link below itself.
_FOLDER, _BASE = "regexp_replace(path, '/[^/]*$', '')", "regexp_extract(path, '[^/]*$', 0)"
_LINKS = f"""fx_file AS (SELECT DISTINCT cast(k AS string) AS n, path, {_FOLDER} AS folder, {_BASE} AS base
    FROM fx_call),
fx_link AS (
    SELECT concat('/lnk/a', n) AS path, concat('/lnk/b', n) AS canonical_path FROM fx_file
    UNION ALL SELECT concat('/lnk/b', n), concat('c', n) FROM fx_file
    UNION ALL SELECT concat('/lnk/c', n), folder FROM fx_file
    UNION ALL SELECT concat('/lnk/f', n), concat('../lnk/g', n) FROM fx_file
    UNION ALL SELECT concat('/lnk/g', n), path FROM fx_file
    UNION ALL SELECT concat('/loop/x', n), concat('/loop/y', n) FROM fx_file
    UNION ALL SELECT concat('/loop/y', n), concat('/loop/x', n) FROM fx_file
    UNION ALL SELECT concat('/grow', n), concat('/grow', n, '/d') FROM fx_file)"""
_SPELLED = """SELECT event_id, n, path, CASE event_id % 6
        WHEN 0 THEN concat('/lnk/a', n, '/', base) WHEN 1 THEN concat('/lnk/f', n)
        WHEN 2 THEN concat('/lnk/a', n, '/../q', n, '.txt') WHEN 3 THEN concat('/loop/x', n, '/f')
        WHEN 4 THEN concat('/grow', n, '/f') ELSE concat('/lnk/./b', n, '//', base) END AS spelled
    FROM (SELECT c.event_id, f.* FROM fx_call c JOIN fx_file f ON f.path = c.path)"""


def _from_calls(spark, sf, sql):
    calls = view(spark, sf, "fx_call")
    return spark.sql(f"WITH fx_call AS (SELECT * FROM {{calls}}), {_LINKS} {sql}", calls=calls)


def link_rows(spark, sf):
    return _from_calls(spark, sf, "SELECT path, canonical_path FROM fx_link")


#: A resolution step by step: the longest linked folder is replaced, else a ``..`` is taken out.
_WALK = rf"""{_LINKS}, fx_spelled AS ({_SPELLED}),
fx_target AS (SELECT path AS source, CASE WHEN canonical_path LIKE '/%' THEN canonical_path ELSE
    concat({_FOLDER}, '/', canonical_path) END AS target FROM fx_link),
fx_walk AS (
    SELECT DISTINCT spelled, spelled AS now, 0 AS hops, false AS done FROM fx_spelled
    UNION ALL
    SELECT spelled, CASE
            WHEN source IS NOT NULL THEN concat(target, substr(head, length(source) + 1), rest)
            WHEN rest <> '' THEN concat(regexp_replace(head, '/[^/]*$', ''), substr(rest, 4))
            ELSE head END,
        hops + CASE WHEN source IS NULL THEN 0 ELSE 1 END, source IS NULL AND rest = ''
    FROM (
        SELECT w.spelled, w.hops, w.head, w.rest, max_by(l.source, length(l.source)) AS source,
            max_by(l.target, length(l.source)) AS target
        FROM (SELECT spelled, hops, regexp_replace(clean, '/\.\.(/.*)?$', '') AS head,
                substr(clean, length(regexp_replace(clean, '/\.\.(/.*)?$', '')) + 1) AS rest
            FROM (SELECT *, regexp_replace(now, '/(\./|/)+', '/', 'g') AS clean FROM fx_walk
                WHERE NOT done AND hops <= 40)) w
        LEFT JOIN fx_target l ON w.head = l.source OR starts_with(w.head, concat(l.source, '/'))
        GROUP BY w.spelled, w.hops, w.head, w.rest)),
fx_real AS (SELECT s.spelled, coalesce(max(w.now) FILTER (w.done), s.spelled) AS real
    FROM (SELECT DISTINCT spelled FROM fx_spelled) s JOIN fx_walk w ON w.spelled = s.spelled
    GROUP BY s.spelled)"""


@query("c_04_linked", duck(["fx_call"], """
    SELECT event_id, s.spelled AS path, real AS canonical_path,
        concat('art_', substr(sha256(concat('sg-artifact-v1:', real)), 1, 16)) AS artifact_id
    FROM fx_spelled s JOIN fx_real r ON r.spelled = s.spelled""", _WALK, recursive=True))
def linked(spark, sf):
    rows = _from_calls(spark, sf, _SPELLED).select("event_id", F.col("spelled").alias("path"))
    return A.identify(rows, links=link_rows(spark, sf)).select(
        "event_id", "path", "canonical_path", "artifact_id")


@query("c_05_relative", duck(["fx_call"], """
    SELECT event_id, path AS canonical_path, artifact_id FROM fx_call"""))
def relative(spark, sf):
    """Spellings from the root, from a working folder and from home share one id."""
    rows = view(spark, sf, "fx_call").select("event_id", F.expr("""CASE event_id % 7
        WHEN 0 THEN path WHEN 1 THEN concat('.', path) WHEN 2 THEN substr(path, 2)
        WHEN 3 THEN regexp_replace(path, '^/home/u[0-9]+', '~') WHEN 4 THEN concat('../..', path)
        WHEN 5 THEN concat(path, '/') ELSE concat('/.//x/..', path) END""").alias("path"),
        F.when(F.col("event_id") % 7 == 4, "/work/in").otherwise("/").alias("cwd"),
        F.regexp_extract("path", "^/home/u[0-9]+", 0).alias("home"))
    return A.identify(rows, cwd=F.col("cwd"), home=F.col("home")).select(
        "event_id", "canonical_path", "artifact_id")


@query("c_05_identity", duck(["fx_call"], "SELECT event_id, path, artifact_id FROM fx_call"))
def identity(spark, sf):
    return A.identify(view(spark, sf, "fx_call").drop("artifact_id")).select(
        "event_id", "path", "artifact_id")


@query("c_06_snapshot", duck(["fx_manifest"], """
    SELECT m.rel, d.digest, d.size, d.digest IS NOT NULL AS present
    FROM fx_manifest m LEFT JOIN (
        SELECT concat(source, '/', cast(doc_id AS string)) AS rel, sha256(text) AS digest,
            strlen(text) AS size FROM documents) d ON d.rel = m.rel
    WHERE m.side = 'expected'"""))
def snapshot(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"),
        F.col("text").alias("content"))
    wanted = view(spark, sf, "fx_manifest").where("side = 'expected'").select("rel")
    return A.snapshot(wanted, files)


def _diff(spark, sf):
    m = view(spark, sf, "fx_manifest")
    return A.manifest_diff(m.where("side = 'expected'"), m.where("side = 'actual'"))


_DUCK_DIFF = """fx_diff AS (SELECT coalesce(e.rel, a.rel) AS rel,
        CASE WHEN e.rel IS NULL THEN 'untracked' WHEN a.rel IS NULL THEN 'missing'
            WHEN e.digest = a.digest THEN 'ok' ELSE 'changed' END AS bucket
    FROM (SELECT * FROM fx_manifest WHERE side = 'expected') e
    FULL OUTER JOIN (SELECT * FROM fx_manifest WHERE side = 'actual') a ON a.rel = e.rel)"""


@query("c_07_manifest_diff", duck(["fx_manifest"], "SELECT rel, bucket FROM fx_diff", _DUCK_DIFF))
def manifest_diff(spark, sf):
    return _diff(spark, sf).select("rel", "bucket")


@query("c_07_manifest_verdict", duck(["fx_manifest"], """
    SELECT count(*) FILTER (bucket = 'ok') AS ok, count(*) FILTER (bucket = 'changed') AS changed,
        count(*) FILTER (bucket = 'missing') AS missing,
        count(*) FILTER (bucket = 'untracked') AS untracked, bool_and(bucket = 'ok') AS intact
    FROM fx_diff""", _DUCK_DIFF))
def manifest_verdict(spark, sf):
    return A.manifest_verdict(_diff(spark, sf))


_HANDLERS = [
    {"id": "people", "labels": ["pii"], "pattern": r"roster.*\.csv$"},
    {"id": "dumps", "labels": ["regulated"], "pattern": None},
    {"id": "any-csv", "labels": [], "pattern": r"\.csv$"},
    {"id": "secrets", "labels": ["credential"], "pattern": r"api_keys"},
]


@query("c_08_handler", duck(["fx_call"], """
    SELECT event_id, CASE
        WHEN list_contains(flags, 'pii') AND regexp_matches(c.path, 'roster.*\\.csv$', 'i')
            THEN 'people'
        WHEN list_contains(flags, 'regulated') THEN 'dumps'
        WHEN regexp_matches(c.path, '\\.csv$', 'i') THEN 'any-csv'
        WHEN list_contains(flags, 'credential') AND regexp_matches(c.path, 'api_keys', 'i')
            THEN 'secrets' END AS handler
    FROM fx_call c JOIN fx_path p ON p.path = c.path""", I.DUCK_PATHS))
def handler(spark, sf):
    return A.classify(view(spark, sf, "fx_call")).select(
        "event_id", A.find_handler(F.col("path"), F.col("labels"), _HANDLERS).alias("handler"))


@query("c_08_loaded_handlers", ORACLES["c_08_handler"])
def loaded_handlers(spark, sf):
    """The same handlers from an index file."""
    folder = scratch_path(spark, "handlers")
    doc = {"handlers": [{"id": h["id"], "script": f"{h['id']}.py", "match": {k: h[k] for k in ("labels", "pattern")}}
                        for h in _HANDLERS]}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(folder)
    known = load_handlers(spark, folder, suffix=".txt")
    return A.classify(view(spark, sf, "fx_call")).select(
        "event_id", A.find_handler(F.col("path"), F.col("labels"), known).alias("handler"))


@query("c_08_handler_table", duck(["fx_call"], """
    SELECT event_id, CASE WHEN least(o, CASE WHEN list_contains(flags, 'credential') THEN 50 END) = 50
        THEN 'keys' ELSE 'P' || cast(o AS string) END AS handler
    FROM fx_call c JOIN fx_path p ON p.path = c.path LEFT JOIN (
        SELECT h.path, min(ord) AS o FROM fx_hit h JOIN fx_path q ON q.path = h.path
        WHERE ord <> 50 AND (ord % 5 = 0 OR list_has_any(given, list_concat(q.flags, string_split(q.labels, ','))))
        GROUP BY h.path) t ON t.path = c.path""", I.DUCK_PATHS + ", " + _DUCK_PARTS))
def handler_table(spark, sf):
    """A handler for every part, every fifth of them for any label, and one for credentials only."""
    parts = part_rules(spark, sf).select(
        "ord", "id", F.when(F.col("ord") % 5 != 0, F.col("labels")).alias("labels"), "pattern")
    keys = spark.createDataFrame([(50, "keys", ["credential"], None)], parts.schema)
    known = parts.where("ord <> 50").unionByName(keys).withColumn("ord", F.col("ord").cast("int"))
    return A.handler_by_table(A.classify(view(spark, sf, "fx_call")), known).select("event_id", "handler")


@query("c_09_disclosure", """
    SELECT doc_id, concat('sha256:', substr(sha256(text), 1, 16)) AS handle,
        cast(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10)))
            - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS bigint) AS lines,
        strlen(text) AS bytes, sha256(text) AS digest,
        regexp_replace(regexp_replace(substr(string_split(text, chr(10))[1], 1, 60),
            '\\p{L}', 'A', 'g'), '\\p{Nd}', 'N', 'g') AS first_line_shape
    FROM documents""")
def disclosure(spark, sf):
    return A.disclose(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


# ── labels ──────────────────────────────────────────────────────────────────────────────────
@query("t_01_label_join", duck(["fx_call"], f"""
    SELECT session_id, {I.duck_labels('max(rnk)', 'coalesce(flatten(list(flags)), [])')} AS labels
    FROM fx_call c JOIN fx_path p ON p.path = c.path GROUP BY session_id""", I.DUCK_PATHS))
def label_join(spark, sf):
    return A.classify(view(spark, sf, "fx_call")).groupBy("session_id").agg(
        L.text(L.join_agg(F.col("labels"))).alias("labels"))


@query("t_02_label_predicates", duck(["fx_call"], """
    SELECT event_id, ['public', 'internal', 'confidential', 'restricted'][rnk + 1] AS sensitivity,
        (rnk >= 2 OR len(flags) > 0) AS classified,
        rnk >= 2 AND list_contains(flags, 'pii') AS dominates_confidential_pii,
        array_to_string(list_concat(
            [['public', 'internal', 'confidential', 'restricted'][rnk + 1]], list_sort(flags)), ',')
            AS description
    FROM fx_call c JOIN fx_path p ON p.path = c.path""", I.DUCK_PATHS))
def label_predicates(spark, sf):
    lab = F.col("labels")
    return A.classify(view(spark, sf, "fx_call")).select(
        "event_id", L.rank_name(L.sens_rank(lab)).alias("sensitivity"), "classified",
        L.dominates(lab, F.array(F.lit("confidential"), F.lit("pii"))).alias(
            "dominates_confidential_pii"), L.describe(lab).alias("description"))
