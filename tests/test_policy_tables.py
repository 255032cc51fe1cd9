"""Policy tables against the unrolled form, operator by operator and at size."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.functions import pointwise
from provlake.operators import matching as M
from provlake.operators import policy as P
from provlake.vocab import POLICIES, Policy

SCHEMA = ("n long, action string, posture string, taint array<string>, depth long, share double, path string, flag boolean")
PATHS = {"session.taint": "taint", "session.taint_depth": "depth", "share": "share", "path": "path",
         "artifact.classified": "flag"}
RESULT = ("outcome", "determining_policy", "reason", "guidance", "evaluated", "counterfactual")


def context():
    return {path: F.col(c) for path, c in PATHS.items()}


def calls(spark, n=120):
    rng = random.Random(1)
    rows = [(i, rng.choice(["read", "write", "egress", None]), rng.choice(["observe", "steer", "bar", None]),
             rng.choice([None, [], ["pii"], ["credential", "pii"], ["public"]]), rng.choice([None, 0, 1, 2, 5, 9]),
             rng.choice([None, 0.5, 1.5, -2.0]), rng.choice([None, "", "/a/secret.env", "/b/notes.md", "pii"]),
             rng.choice([None, True, False])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def policies(n):
    rng = random.Random(2)
    pool = [("session.taint", {"contains": "pii"}), ("session.taint", {"contains_any": ["credential", "x"]}),
            ("session.taint", {"contains_any": []}), ("session.taint_depth", {"gte": 2}), ("session.taint_depth", {"gt": 1, "lte": 5}),
            ("session.taint_depth", {"lt": 2}), ("session.taint_depth", 5), ("session.taint_depth", {"ne": 5}),
            ("session.taint_depth", {"in": [0, 9, None]}), ("share", {"gte": 0.5}), ("share", {"in": [1.5]}), ("share", {"in": []}),
            ("path", "/b/notes.md"), ("path", {"eq": None}), ("path", {"ne": None}), ("path", {"ne": "pii"}),
            ("path", {"matches": r"secret\.\w+$"}), ("path", {"matches": "^/b/"}), ("path", {"contains": "not"}),
            ("path", {"in": ["pii", None]}), ("artifact.classified", True), ("artifact.classified", {"is_true": True}),
            ("artifact.classified", {"is_false": True}), ("artifact.classified", {"ne": False}), ("unknown.path", {"eq": None}),
            ("unknown.path", {"gte": 1}), ("unknown.path", {"is_false": True})]
    out = []
    for i in range(n):
        when = dict(rng.sample(pool, rng.choice([0, 1, 1, 2, 3])))
        out.append(Policy(f"p{i}", rng.choice(["permit", "ask", "forbid"]), when, rng.choice(["", f"why {i}"]),
                          rng.choice([(), (), ("read",), ("write", "egress")]), rng.choice([(), (), ("bar",), ("steer", "observe")]),
                          rng.choice(["", "ask first"]), rng.choice([0, 0, 3, -1])))
    return out


def decided(df):
    return {r["n"]: tuple(r[c] for c in RESULT) for r in df.collect()}


@pytest.mark.parametrize("chosen", [policies(40), policies(200)[150:], [], list(POLICIES)])
def test_table_decides_like_the_unrolled_form(spark, chosen):
    df = calls(spark)
    a, p = F.col("action"), F.col("posture")
    got = decided(M.decide_by_table(df, a, p, context(), P.policy_table(spark, chosen)))
    if chosen:
        assert got == decided(P.decide(df, a, p, context(), chosen))
    else:
        assert {v[:2] for v in got.values()} == {("deny", "default#deny-by-default")}


def test_five_thousand_policies(spark):
    many = policies(5000)
    df = calls(spark, 30)
    got = decided(M.decide_by_table(df, F.col("action"), F.col("posture"), context(), P.policy_table(spark, many)))
    for r in df.collect():
        want = pointwise.decide(many, r["action"], r["posture"], {p: r[c] for p, c in PATHS.items()})
        assert got[r["n"]][:2] == want


def test_unknown_effects_and_operators_are_refused(spark):
    df = calls(spark, 3)
    for bad in (Policy("x", "shrug"), Policy("x", "permit", {"path": {"near": 1}}), Policy("x", "permit", {"path": {"gte": "a"}})):
        with pytest.raises(Exception, match="unknown|compared"):
            M.decide_by_table(df, F.col("action"), F.col("posture"), context(), P.policy_table(spark, [bad])).collect()


def test_no_calls(spark):
    out = M.decide_by_table(calls(spark).limit(0), F.col("action"), F.col("posture"), context(),
                            P.policy_table(spark, policies(5)))
    assert out.collect() == []


def test_derived_columns_cost_once_a_situation(spark):
    tried = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def length(text):
        tried.add(1)
        return len(text)

    few = calls(spark)
    situations = few.drop("n").distinct().count()
    many = few.crossJoin(spark.range(40)).drop("id")
    a, p = F.col("action"), F.col("posture")
    got = M.decide_by_table(many, a, p, context(), P.policy_table(spark, policies(200)), {"long": length("counterfactual")})
    rows = got.select("n", "counterfactual", "long").collect()
    assert len(rows) == 40 * few.count() and all(r["long"] == len(r["counterfactual"]) for r in rows)
    assert situations > M.BLOCK and tried.value <= situations


def test_a_small_guess_of_a_table_broadcasts_nothing(spark, tmp_path):
    """A table that takes little room in its file is not sent to the driver by the file's size."""
    rows = spark.range(3000).selectExpr(
        "cast(id AS int) AS ord", "concat('p', id) AS id", "'ask' AS effect", "concat('{\"share\": ', id % 7, '.5}') AS when_json",
        "repeat('why ', 9) AS reason", "cast(array() AS array<string>) AS actions", "cast(array() AS array<string>) AS postures",
        "'' AS guidance", "0 AS priority")
    rows.write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    got = M.decide_by_table(calls(spark), F.col("action"), F.col("posture"), context(), table)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["determining_policy"] for r in got.collect()} >= {"p0", "p1"}
