"""Small literal fixtures and properties."""

import gzip
import hashlib
import hmac
import random

from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import labels as L
from provlake.functions import pointwise as P
from provlake.functions.ordered import dense_index, running, top_k_per_key
from provlake.operators import integrity as G
from provlake.operators import policy
from provlake.operators import reconcile as R
from provlake.operators import taint as T
from provlake.sources import ledger as S
from provlake.sources.keys import KeySource


def events(spark, n=40, ledger="a"):
    return spark.range(n).select(
        F.lit(ledger).alias("ledger_id"), F.col("id").alias("ord"),
        F.concat(F.lit('{"op":"x","n":'), "id", F.lit(',"é":"\\u00e9 1.5"}')).alias("event"))


def entries(chained):
    return S.parse(chained.select("ledger_id", F.col("seq").alias("idx"), "raw"))


def test_running_equals_window_with_tiny_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): (r.s, r.last, r.m) for r in running(df, ["k"], "o", {
        "s": ("sum", F.col("v")), "last": ("last", F.col("v")), "m": ("max", F.col("v"))},
        chunk_rows=7).collect()}
    for k in "ab":
        seen = []
        for kk, o, v in rows:
            if kk != k:
                continue
            known = [x for x in seen if x is not None]
            assert got[(k, o)] == (sum(known), known[-1] if known else None,
                                   max(known) if known else None)
            seen.append(v)


def test_top_k_and_index(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    top = top_k_per_key(df, ["k"], [F.col("id").desc()], 4).collect()
    assert sorted((r.k, r.id) for r in top) == sorted((i % 3, i) for i in range(488, 500))
    idx = dense_index(df, ["k"], "id", "i", chunk_rows=10).where("i <> floor(id / 3)")
    assert idx.count() == 0


def test_chain_breaks_are_named(spark):
    c = S.append(events(spark)).cache()
    assert G.verify(entries(c), chunk_rows=7).first().intact
    edits = {
        "content does not match": F.replace("raw", F.lit('"op":"x"'), F.lit('"op":"y"')),
        "is missing 'seq'": F.regexp_replace("raw", '"seq":[0-9]+', '"sec":1'),
        "does not chain": F.regexp_replace("raw", '"prev_hash":"....', '"prev_hash":"0000')}
    for text, raw in edits.items():
        bad = c.withColumn("raw", F.when(F.col("seq") == 17, raw).otherwise(F.col("raw")))
        v = G.verify(entries(bad), chunk_rows=7).first()
        assert (v.intact, v.broken_at) == (False, 17) and text in v.reason


def test_noncanonical_but_equal_line_still_verifies(spark):
    c = S.append(events(spark, 5))
    spaced = c.withColumn("raw", F.replace("raw", F.lit('"op":"x"'), F.lit('"op": "x"')))
    assert G.verify(entries(spaced)).first().intact


def test_keyed_chain_and_splice(spark, tmp_path):
    f = tmp_path / "key"
    f.write_text("secret-material")
    key = KeySource("k1", path=str(f))
    c = S.append(events(spark, 12), key=key)
    e = entries(c)
    assert G.verify(e, key).first().verified_keyed
    assert not G.verify(e).first().verified_keyed
    other = tmp_path / "other"
    other.write_text("not it")
    assert "edited in place" in G.verify(e, KeySource("k1", path=str(other))).first().reason
    assert "spliced" in G.verify(entries(S.append(events(spark, 3))), key).first().reason
    assert "secret-material" not in c._jdf.queryExecution().toString()


def test_append_continues_from_heads(spark):
    both = S.append(events(spark, 8)).orderBy("seq").collect()
    first = S.append(events(spark, 5))
    rest = S.append(events(spark, 8).where("ord >= 5"), G.heads(entries(first)))
    assert [r.hash for r in rest.orderBy("seq").collect()] == [r.hash for r in both[5:]]


def test_damage(spark, tmp_path):
    good = [r.raw for r in S.append(events(spark, 6)).orderBy("seq").collect()]
    body = "\n".join(good).encode()
    files = {"torn": body[:-9], "middle": body.replace(good[2].encode(), b"{x") + b"\n",
             "garbage": body + b"\n{x\n", "utf8": body.replace(b"\xc3\xa9", b"\xff", 1) + b"\n",
             "fine": b"\n" + body + b"\n"}
    for name, data in files.items():
        d = tmp_path / f"ledger_id={name}"
        d.mkdir()
        (d / "part.jsonl").write_bytes(data)
    lines = S.scan(spark, str(tmp_path))
    damaged = S.damage(lines)
    got = {r.ledger_id: (r.truncated, r.malformed_at, r.decode_error_at)
           for r in damaged.collect()}
    assert got == {"torn": (True, None, None), "middle": (False, 3, None),
                   "garbage": (False, 7, None), "utf8": (False, None, 1),
                   "fine": (False, None, None)}
    n = {r.ledger_id: r["count"] for r in
         S.entries(lines, damaged).groupBy("ledger_id").count().collect()}
    assert n == {"torn": 5, "middle": 2, "garbage": 6, "fine": 6}


def test_seal_mac(spark, tmp_path):
    f = tmp_path / "key"
    f.write_text("k")
    key = KeySource("k1", path=str(f))
    seg = spark.createDataFrame([("s", i, f"p{i}", 3, 0, 2, "h") for i in range(3)],
                                "series string, index long, path string, records long, "
                                "first_seq long, last_seq long, head_hash string")
    files = seg.select("path", F.col("path").cast("binary").alias("content"))
    seals = G.seal(seg, files, "t", key).cache()
    rows = seals.orderBy("index").collect()
    assert [r.prev_seal_digest for r in rows[1:]] == [r.seal_digest for r in rows[:-1]]
    want = hmac.new(b"k", b"sg-seal-v1:" + G.seal_material(rows[0].asDict()), hashlib.sha256)
    assert rows[0].mac == want.hexdigest()
    facts = seals.select("series", "index", "path", F.lit(True).alias("intact"),
                         F.lit(0).alias("broken_at"), F.lit("").alias("reason"),
                         F.lit(3).cast("long").alias("n_entries"), F.lit("h").alias("last_hash"),
                         F.col("file_digest").alias("digest_now"))
    ok = G.verify_series(G.verify_sealed(facts, seals, key), chunk_rows=2)
    assert G.series_summary(ok).first().ok
    forged = seals.withColumn("records", F.lit(2).cast("long"))
    found = G.verify_sealed(facts, forged, key).first().findings
    assert any("MAC does not verify" in x for x in found)


def naive_state(rows):
    """Replay of one session as a fold, the specification of the rollup."""
    labels, src, touched, since, gen, seen = ["public"], {}, 0, 0, 0, set()
    for op, outcome, act, ref, target in rows:
        if act is not None:
            if (act, op) in seen:
                continue
            seen.add((act, op))
        if outcome == "deny":
            continue
        if ref:
            touched, since = touched + 1, since + 1
            if P.is_classified(ref[1]):
                src[ref[0]] = ref[1]
            labels = P.join(labels, ref[1])
        if op == "artifact.egress":
            since = 0
        if op == "custody.checkpoint":
            gen += 1
        if op == "custody.declassify" and target:
            src.pop(target, None)
            labels = P.join(["public"], *src.values())
    return sorted(labels), len(src), touched, since, gen


def test_rollup_equals_fold(spark):
    rng = random.Random(7)
    sets = [["public"], ["internal"], ["confidential", "pii"], ["restricted", "credential"]]
    ops = ["artifact.read", "artifact.read", "artifact.egress", "custody.checkpoint",
           "custody.declassify"]
    rows, want = [], {}
    for s in range(60):
        mine = []
        for i in range(rng.randrange(1, 14)):
            op = rng.choice(ops)
            a = f"a{rng.randrange(3)}"
            ref = (a, rng.choice(sets)) if op.startswith("artifact") else None
            rec = (op, rng.choice(["allow", "ask", "deny"]), rng.choice([None, "x", "y"]), ref,
                   a if op == "custody.declassify" else None)
            mine.append(rec)
            rows.append((f"s{s}", i, rec[0], rec[1], rec[2],
                         [(ref[0], "p", None, ref[1])] if ref else [], [], [], rec[4]))
        want[f"s{s}"] = naive_state(mine)
    df = spark.createDataFrame(rows, "session_id string, seq long, op string, outcome string, "
                               f"action_id string, used {T.REF}, generated {T.REF}, "
                               f"derived_from {T.DERIVED}, declassified string")
    got = {r.session_id: (r.labels, r.depth, r.touched, r.since_last_egress,
                          r.compaction_generation) for r in T.rollup(df).collect()}
    assert got == want


def test_lattice_laws(spark):
    sets = [["public"], ["internal", "pii"], ["restricted"], ["confidential", "credential", "pii"]]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets],
                               "a array<string>, b array<string>")
    r = df.select("a", "b", L.join_sets(F.col("a"), F.col("b")).alias("ab"),
                  L.join_sets(F.col("b"), F.col("a")).alias("ba")).withColumn(
        "up", L.dominates(F.col("ab"), F.col("a")) & L.dominates(F.col("ab"), F.col("b")))
    for x in r.collect():
        assert x.ab == x.ba == P.join(x.a, x.b) and x.up


def test_reconcile_needs_a_nonce(spark):
    d = spark.createDataFrame([("l", 0, "a", "x", "n0"), ("l", 1, "a", "y", "n1")],
                              "ledger_id string, seq long, actor string, action string, nonce string")
    r = spark.createDataFrame([("l", 0, 0, "b", "x", None), ("l", 0, 1, "a", "x", "n0"),
                               ("l", 9, 2, "a", "x", "n0")],
                              "ledger_id string, seq long, report_no long, actor string, "
                              "action string, nonce string")
    kinds = sorted(x.kind for x in R.reconcile(d, r).collect())
    assert kinds == ["actor", "fabricated", "no-nonce", "replayed", "unreported"]


def test_unknown_effect_and_operator(spark):
    import pytest

    from provlake.functions.rules import condition
    with pytest.raises(ValueError):
        condition("almost", F.lit(1), 1)
    with pytest.raises(ValueError):
        policy.decide(spark.range(1), F.lit("a"), F.lit("b"), {}, [vocab.Policy("p", "maybe")])


def test_policy_files(spark, tmp_path):
    (tmp_path / "10-a.json").write_text('{"policies": [{"id": "one", "effect": "permit"}]}')
    (tmp_path / "20-b.json").write_text('{"policies": [{"id": "two", "effect": "forbid", '
                                        '"when": {"call.is_egress": {"is_true": true}}}]}')
    got, digest = policy.load_policies(spark, str(tmp_path))
    assert [p.id for p in got] == ["10-a#one", "20-b#two"] and len(digest) == 64
    assert P.decide(got, "x", "steer", {"call.is_egress": True}) == ("deny", "20-b#two")
    assert policy.policy_table(spark, got).count() == 2


def test_a_declassification_takes_its_artifact_back(spark):
    """The running state after the last record equals the rollup of the same records."""
    ref = lambda a, *labels: [(a, f"/{a}", None, list(labels))]
    rows = [("s", 0, "artifact.read", ref("a", "restricted", "pii"), None),
            ("s", 1, "artifact.read", ref("b", "internal"), None),
            ("s", 2, "custody.declassify", [], "a"), ("s", 3, "artifact.read", ref("a", "pii"), None),
            ("s", 4, "custody.declassify", [], "other"), ("s", 5, "artifact.egress", [], None),
            ("t", 0, "artifact.read", ref("a", "restricted"), None), ("t", 1, "artifact.read", [], None)]
    e = spark.createDataFrame(
        [(*r[:3], "allow", None, r[3], [], [], r[4], r[3][0][0] if r[3] else None) for r in rows],
        "session_id string, seq long, op string, outcome string, action_id string, "
        f"used {T.REF}, generated {T.REF}, derived_from {T.DERIVED}, declassified string, artifact_id string")
    ask = e.select("session_id", "seq", "artifact_id").unionByName(spark.createDataFrame(
        [("s", 9, "a"), ("t", 9, "a")], "session_id string, seq long, artifact_id string"))
    got = {(r.session_id, r.seq): r for r in T.running_state(e, ask).collect()}
    end = {r.session_id: r for r in T.rollup(e).collect()}
    for s in ("s", "t"):
        last = got[s, 9]
        assert (sorted(last.taint), last.taint_depth, last.artifacts_touched, last.since_last_egress) == (
            sorted(end[s].labels), end[s].depth, end[s].touched, end[s].since_last_egress)
    assert (got["s", 2].taint, got["s", 2].taint_depth) == (["pii", "restricted"], 1)
    assert (got["s", 3].taint, got["s", 3].taint_depth, got["s", 3].first_touch) == (["public"], 0, True)
    assert (got["s", 9].first_touch, got["t", 9].first_touch) == (False, False)


def test_candidates_without_limits(spark):
    from provlake.operators import risk
    name = "aaaa_bbbb_cccc_dddd_eeee_ffff_gggg.py"
    writes = spark.createDataFrame([(name,)], "file_path string")
    corpus = spark.createDataFrame([(f"c{i}", "gggg AAAA") for i in range(7)] + [(name, "aaaa")],
                                   "path string, content string")
    got = {tuple(r)[1:] for r in risk.candidates(writes, corpus, None, None).collect()}
    assert got == {(t, f"c{i}") for t in ("aaaa", "gggg") for i in range(7)}
    got = {tuple(r)[1:] for r in risk.candidates(writes, corpus).collect()}
    assert got == {("aaaa", f"c{i}") for i in range(4)}


def test_drift_against_a_table_of_current_values(spark):
    from provlake.operators import evidence as E
    from provlake.plans import q_evidence as Q
    n = E.MAX_LITERALS + 900
    now = spark.createDataFrame([(f"m{i}", f"v{i % 7}") for i in range(n)], "key string, value string")
    rows = spark.createDataFrame(
        [("a", {f"m{i}": "v0" for i in (0, 1, n - 1)}), ("b", {"m7": "v0", "none": "x", "m8": ""}),
         ("c", {}), ("d", None)], "ref string, recorded map<string,string>")
    seen = E.with_current(rows, "recorded", now, "now")
    got = {r.ref: (r.impl, sorted(r.subj)) for r in seen.select(
        "ref", E.implementation_drift(F.col("recorded"), F.col("now")).alias("impl"),
        E.subject_drift(F.col("recorded"), F.col("now")).alias("subj")).collect()}
    moved = ["m1", f"m{n - 1}"] if (n - 1) % 7 else ["m1"]
    values = {"m1": "v1", f"m{n - 1}": f"v{(n - 1) % 7}"}
    assert got.pop("a") == tuple([f"{m} changed {w} this proof (v0 -> {values[m]})" for m in moved]
                                 for w in ("after", "since"))
    assert got == {k: ([], []) for k in "bcd"}

    sf = "/root/testdata/sf0.001"

    def judged(subject, modules):
        return sorted(map(repr, E.judge_refs(Q.refs(spark, sf), Q.claims(spark, sf), Q.proofs(spark, sf),
                                             Q.procedures(spark, sf), subject, modules).collect()))
    tables = [spark.createDataFrame(list(d.items()), "key string, value string") for d in (Q.SUBJECT, Q.MODULES)]
    want = judged(Q.SUBJECT, Q.MODULES)
    assert judged(*tables) == want and any("changed" in r for r in want)


def test_files_are_digested_as_they_are_in_pieces(spark, tmp_path):
    mark = b"\xef\xbb\xbf"
    files = {"ended": b"a\nb\n", "open": b"a\nb", "blank": b"a\n\n", "newline": b"\n", "returns": b"a\r\nb\r\n", "mark": mark,
             "marked": mark + b"abcd\n", "marked-open": mark + b"abcd", "odd": b"{\xff\x00}\n" * 3, "inner": b"abc\n" + mark + b"\n",
             "long": b"".join(b"%d %s\n" % (i, b"x" * (i % 700)) for i in range(9000)), "packed.gz": gzip.compress(b"a\nb\n")}
    for name, content in files.items():
        (tmp_path / f"ledger_id={name}").mkdir()
        (tmp_path / f"ledger_id={name}" / f"part-{name}").write_bytes(content)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r.file.split("part-")[1]: r.file_digest for r in S.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in files.items()}


def test_seals_hold_no_file_in_memory(spark, tmp_path):
    """A file is refused as one row from the reader's limit on; its digest is made all the same."""
    S.write_jsonl(S.append(events(spark, 200)), str(tmp_path / "f"))
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        digests = S.file_digests(spark, str(tmp_path / "f")).select(F.lit("a").alias("path"), "file_digest")
        seg = spark.createDataFrame([("s", 0, "a", 200, 0, 199, "h")], "series string, index long, path string, records long, "
                                    "first_seq long, last_seq long, head_hash string")
        got = G.seal(seg, digests, "t").first()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)
    content = b"".join(p.read_bytes() for p in (tmp_path / "f").rglob("part-*"))
    assert len(content) > 1000 and got.file_digest == hashlib.sha256(content).hexdigest()
