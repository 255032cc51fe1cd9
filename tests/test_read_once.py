"""What is read or searched per row is read once, and after the rows are spread."""

import json

from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import pointwise
from provlake.operators import export as X
from provlake.operators import policy as P
from provlake.operators import taint as T
from provlake.operators import validate as V
from provlake.sources import ledger as S


def plan(df):
    return str(df._jdf.queryExecution().optimizedPlan())


def test_a_body_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", 0)], "raw string, seq long")
    body = F.parse_json("raw")
    for tests in (V.tier_a(body), V.tier_b(body), V.strength(body), V.boundary(body)):
        assert plan(df.select(tests.alias("x"))).lower().count("parsejson") == 1
    events = df.select(F.lit("a").alias("ledger_id"), F.col("seq").alias("ord"), F.col("raw").alias("event"))
    assert plan(S.admit(events)[0]).lower().count("parsejson") <= 2  # in the filter and its null test


def test_members_keep_their_answers(spark):
    rows = [json.dumps({"action": {"op": "x", "method": {"kind": None}}, "alterations": "no"}), "null", "[]", None]
    got = [r.a for r in spark.createDataFrame([(r,) for r in rows], "raw string").select(
        V.tier_a(F.parse_json("raw")).alias("a")).collect()]
    assert "action.op (x is not in the controlled vocabulary)".replace("x", "'x'", 1) in got[0]
    assert any(p.startswith("alterations (must be a list") for p in got[0])
    assert got[1] == got[2] and "action.op (absent)" in got[1]


def test_calls_are_spread_before_they_are_searched(spark):
    calls = spark.createDataFrame(
        [("s", i, "Read" if i % 2 else "Bash", "ls", "bar", "default", f"/data/customers_{i}.csv") for i in range(6)],
        "session_id string, seq long, tool string, command string, posture string, permission_mode string, file_path string")
    facts = P.call_facts(calls.withColumn("file_path", F.when(F.col("tool") != "Bash", F.col("file_path"))).repartition(4))
    below = plan(facts).split("Repartition")[-1]
    assert "customers" not in below and "Filter" not in below
    assert sorted(r.seq for r in facts.collect()) == [1, 3, 5]


def test_ready_policies_decide_as_given_ones():
    many = [vocab.Policy("a", "permit"), vocab.Policy("b", "ask", {"n": {"gte": 2}}, priority=1),
            vocab.Policy("c", "ask", {"n": {"gte": 1}}, priority=1), vocab.Policy("d", "forbid", {"n": {"gt": 5}})]
    ready = pointwise.ready(many)
    assert pointwise.ready(ready) is ready
    got = [pointwise.decide(ready, "x", "bar", {"n": n}) for n in (0, 1, 2, 6, None)]
    assert got == [("allow", "a"), ("ask", "c"), ("ask", "b"), ("deny", "d"), ("allow", "a")]


def test_refs_keep_what_a_json_parser_gives(spark):
    used = ['[{"artifact_id":"a","path":"é","labels":["x","y"]},{"digest":""}]', "[]", '[{"labels":[]}]', '{"artifact_id":"one"}',
            '[{"artifact_id":7,"path":null,"labels":["x",1]}]', '[{"path":"q\\"q"}]', '"none"', "null", "[1]", '[{"path":["l"]}]']
    rows = [(i, f'{{"predicate":{{"resources":{{"used":{u}}}}}}}') for i, u in enumerate(used)]
    rows += [(90, '{"predicate":{"resources":{}},"resources":{"used":[{"path":"flat"}]}}'),
             (91, '{"predicate":{"resources":{"generated":[]}},"resources":{"used":[{"path":"hidden"}]}}'), (92, "{}")]
    df = spark.createDataFrame(rows, "seq long, raw string").select("seq", F.lit("L").alias("ledger_id"), F.parse_json("raw").alias("body"))
    got = {r.seq: r.used for r in X.export_view(df).select("seq", "used").collect()}
    want = spark.createDataFrame([(i, u) for i, u in enumerate(used)], "seq long, u string").select(
        "seq", F.coalesce(F.from_json(F.to_json(F.parse_json("u")), X.REFS), F.array().cast(X.REFS)).alias("used")).collect()
    for r in want:
        assert got[r.seq] == r.used, used[r.seq]
    assert [x.path for x in got[90]] == ["flat"] and got[91] == [] and got[92] == []


def test_a_case_graph_reads_its_records_twice_at_most(spark):
    body = '{"record":{"id":"r"},"resources":{"used":[{"artifact_id":"a","path":"p"}]}}'
    df = spark.createDataFrame([("L", 1, body)], "ledger_id string, seq long, raw string").select(
        "ledger_id", "seq", F.parse_json("raw").alias("body"))
    graph = X.case_graph(X.export_view(df))
    assert plan(graph).lower().count("parsejson(raw") <= 2 and plan(graph).count("LogicalRDD") <= 2
    assert sorted(r.id for r in graph.collect()) == ["kb:artifact-a", "kb:custody-r", "kb:evidence-r"]


def test_running_state_makes_its_effects_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ref = "[{'artifact_id': 'a', 'path': 'p', 'labels': ['confidential']}]"
    given = spark.range(3).selectExpr("'s' AS session_id", "id AS seq", "'artifact.read' AS op", f"from_json(\"{ref}\", '{T.REF}') AS used",
                                      f"cast(array() AS {T.REF}) AS generated", "cast(null AS string) AS declassified")
    effects = given.mapInArrow(counted, given.schema)
    asked = spark.range(3).selectExpr("'s' AS session_id", "id AS seq", "'a' AS artifact_id")
    got = {r.seq: (r.taint_depth, r.artifacts_touched, r.first_touch) for r in T.running_state(effects, asked).collect()}
    assert got == {0: (0, 0, True), 1: (1, 1, False), 2: (1, 2, False)}
    assert seen.value == 3
