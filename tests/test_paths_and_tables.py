"""Real paths, running state with declassifications, literal index and rule tables, by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provlake import vocab
from provlake.functions import literals, pointwise
from provlake.functions import text as T
from provlake.operators import artifacts as A
from provlake.operators import policy as P
from provlake.operators import risk as K
from provlake.operators import taint

LINKS = [("/a", "/b"), ("/b", "c"), ("/c", "/real/dir"), ("/real/dir/up", ".."), ("/x", "/y"), ("/y", "/x"),
         ("/grow", "/grow/d"), ("/lead", "/x/in"), ("/self", "/self"), ("/t/f", "/real/file"), ("/t", "/real/t")]


def _real(path, links, own=None, used=()):
    """A plain resolution; None in a loop."""
    for _ in range(400):
        parts = [p for p in path.split("/") if p not in ("", ".")]
        up = parts.index("..") if ".." in parts else len(parts)
        for n in range(up, 0, -1):
            source = "/" + "/".join(parts[:n])
            if source in links:
                if source in used or source == own:
                    return None
                target = _real(links[source], links, source, (*used, source))
                if target is None:
                    return None
                path = target + "/" + "/".join(parts[n:])
                break
        else:
            if up == len(parts):
                return "/" + "/".join(parts)
            path = "/" + "/".join(parts[:max(0, up - 1)] + parts[up + 1:])
    return None


PATHS = ["/a/f", "/a/../z", "/b/./f//g/", "/c/up/q", "/c/up/../k", "/x/f", "/y", "/grow/f", "/lead/f", "/self/f", "/t/f",
         "/t/g", "/plain/../p", "/a/up/dir/up/m", "rel/../f", "./a", "..", "../../q", "", "/", "/..", "~/n", "/a"]


def test_links_chains_and_loops(spark):
    table = {s: (t if t.startswith("/") else s.rsplit("/", 1)[0] + "/" + t) for s, t in LINKS if s != t}
    links = spark.createDataFrame(LINKS, "path string, canonical_path string")
    paths = spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string")
    got = {r["path"]: (r["canonical_path"], r["loops"]) for r in A.resolve(paths, links).collect()}
    lexical = {r[0]: r[1] for r in paths.select("path", T.lexical_path(F.col("path"))).collect()}
    for p in PATHS:
        real = _real(p, table) if p.startswith("/") else lexical[p]
        assert got[p] == ((lexical[p], True) if real is None else (real, False)), p
    row = paths.select("path", T.real_path(F.col("path"), A.link_map(links)).alias("r")).collect()
    assert {r["path"]: r["r"] for r in row if r["path"] is not None} == {p: v[0] for p, v in got.items()}
    assert lexical == {**lexical, "./a": "a", "..": "..", "../../q": "../../q", "rel/../f": "f", "": "", "/..": "/"}


def test_one_file_has_one_id(spark):
    rows = spark.createDataFrame([("./a", "/w", None), ("a", "/w", None), ("/w/a", None, None), ("~/a", None, "/w"),
                                  ("/one/a", None, None), ("/p/sub/../../w/./a", None, None), (None, "/w", "/w")],
                                 "path string, cwd string, home string")
    links = spark.createDataFrame([("/one", "/two"), ("/two", "/three"), ("/three", "/w")],
                                  "path string, canonical_path string")
    got = A.identify(rows, links=links, cwd=F.col("cwd"), home=F.col("home")).collect()
    assert {r["artifact_id"] for r in got if r["path"] is not None} == {
        A.identify(rows.limit(1).select(F.lit("/w/a").alias("path"))).first()["artifact_id"]}


def test_aliases_decide_like_their_files(spark):
    calls = [("s", 1, "Read", "/tmp/public.txt"), ("s", 2, "Read", "/home/u/.ssh/id_rsa"), ("s", 3, "Read", "/tmp/notes")]
    df = spark.createDataFrame([(*c, None, "steer", "default") for c in calls],
                               "session_id string, seq long, tool string, file_path string, command string, "
                               "posture string, permission_mode string")
    links = spark.createDataFrame([("/tmp/public.txt", "/keys/id_rsa"), ("/keys", "/home/u/.ssh")],
                                  "path string, canonical_path string")
    facts = P.call_facts(df, links=links)
    rows = {r["seq"]: r for r in facts.collect()}
    assert set(rows) == {1, 2} and rows[1]["artifact_id"] == rows[2]["artifact_id"]
    assert [(a["given"], a["resolves_to"]) for a in rows[1]["aliases"]] == [("/tmp/public.txt", "/home/u/.ssh/id_rsa")]
    assert rows[2]["aliases"] == []
    assert [r["outcome"] for r in P.replay(facts).orderBy("seq").collect()] == ["ask", "allow"]


# ── T-06 ────────────────────────────────────────────────────────────────────────────────────
def _fold(effects, asked):
    """Plain running state per (session, seq): labels, depth, touched, since, first touch."""
    out = {}
    for s in {a[0] for a in asked}:
        held, labels, touched, since = {}, ["public"], 0, 0
        rows = sorted([(e[1], 1, e) for e in effects if e[0] == s] + [(a[1], 0, a) for a in asked if a[0] == s],
                      key=lambda r: r[:2])
        for seq, kind, r in rows:
            if kind == 0:
                out[s, seq] = (sorted(labels), len(held), touched, since, r[2] not in held)
                continue
            _, _, op, refs, dropped = r
            for artifact, own in refs:
                touched, since = touched + 1, since + 1
                if pointwise.is_classified(own):
                    held[artifact] = own
                labels = pointwise.join(labels, own)
            since = 0 if op == "artifact.egress" else since
            if op == "custody.declassify" and dropped:
                held.pop(dropped, None)
                labels = pointwise.join(["public"], *held.values())
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 16), (3, 5)])
def test_running_state_equals_plain_fold(spark, seed, chunk):
    rng = random.Random(seed)
    sets = [["public"], ["internal"], ["confidential"], ["restricted", "pii"], ["internal", "credential"]]
    effects, asked = [], []
    for seq in range(400):
        s = "hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}"
        op = rng.choice(["artifact.read", "artifact.read", "custody.declassify", "artifact.egress", "tool.result"])
        refs = [(f"a{rng.randrange(5)}", rng.choice(sets)) for _ in range(rng.randrange(3))]
        effects.append((s, seq, op, refs, rng.choice(["a0", "a1", "a9", "", None]) if op == "custody.declassify" else None))
        asked.append((s, seq, rng.choice(["a0", "a1", "a2", "a7", None])))
    refs = taint.REF
    eff = spark.createDataFrame(
        [(s, n, op, [(a, None, None, x) for a, x in r], [], d) for s, n, op, r, d in effects],
        f"session_id string, seq long, op string, used {refs}, generated {refs}, declassified string")
    ask = spark.createDataFrame(asked, "session_id string, seq long, artifact_id string")
    got = {(r["session_id"], r["seq"]): (sorted(r["taint"]), r["taint_depth"], r["artifacts_touched"],
                                         r["since_last_egress"], r["first_touch"])
           for r in taint.running_state(eff, ask, chunk_rows=chunk).collect()}
    assert got == _fold(effects, asked)
    empty = taint.running_state(eff.limit(0), ask.limit(3))
    assert {tuple(r["taint"]) for r in empty.collect()} == {("public",)}
    assert taint.running_state(eff, ask.limit(0)).collect() == []


# ── literals ────────────────────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("pattern,found", [
    (r"secret\.env$", {"secret.env"}), (r"(^|/)\.ssh/", {".ssh/"}), (r"(roster|customers)_\d+\.csv", {"roster", "customers"}),
    (r"a?bc*de", {"de"}), (r"(?:key)?x{2}", set()), (r"[a-z]+\.PEM", {".pem"}), (r"foo|b", set()), (r"foo|bar", {"foo", "bar"}),
    (r"(?i)foo", set()), (r"\Qa+b\E", set()), (r"ab(?!cd)ef", {"ab"}), (r"über", {"ber"}), (r"", set()), (r"x[\]]yz", {"yz"}),
    (r"x[\\]yz", {"yz"}), (r"(ab", set()), (r"ab{0,2}cd", {"cd"}), (r"(ab+)+c", {"ab"})])
def test_required_literals(pattern, found):
    assert literals.required(pattern) == found or (
        len(found) == 1 and literals.required(pattern) and min(map(len, literals.required(pattern))) == len(min(found)))


def test_required_literals_occur_in_matches():
    rng = random.Random(6)
    words = ["ab", "cd", "x", r"\.", "e?", "(ab|cde)", "[xy]", "(?:q|ab)?", "d+", "b{2}", ".", "^", "c*"]
    texts = ["".join(rng.choice("abcdexq.") for _ in range(rng.randint(0, 9))) for _ in range(800)]
    for _ in range(400):
        p = "".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        p = p if rng.random() < 0.7 else p + "|" + rng.choice(words)
        need = literals.required(p)
        assert all(any(x in t for x in need) for t in texts if need and re.search(p, t, re.I)), (p, need)


def test_published_rules_have_literals():
    lost = [r.id for r in vocab.classify_rules() if not literals.required(r.pattern)]
    assert len(lost) < len(vocab.classify_rules()) / 4


def test_rule_table_equals_every_rule_on_every_path(spark):
    rng = random.Random(1)
    rules = [(f"r{i:05}", rng.choice([r"/n{}\.md$", r"(^|/)k{}_", r"(secret|token)_{}\b", r"^.{}$", r"[a-f]{}"]).replace(
        "{}", str(i % 700)), [rng.choice(["pii", "restricted", "internal"])]) for i in range(10_000)]
    paths = [f"/x/{rng.choice(['n', 'K', 'secret_', 'TOKEN_', 'a', 'ſecret_'])}{rng.randrange(800)}{rng.choice(['.md', '_q', ''])}"
             for _ in range(300)] + ["", None, "é", "a7"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n long, path string")
    table = spark.createDataFrame(rules, "id string, pattern string, labels array<string>")
    got = {r["n"]: r["matched_rules"] for r in A.classify_by_table(df, table, ["n"]).collect()}
    tried = [(i, re.compile(p.replace("\\b", "(?!\\w)"), re.I)) for i, p, _ in rules]
    for n, p in enumerate(paths):
        assert got[n] == [i for i, r in tried if p is not None and r.search(p)], p


def test_candidates_in_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "omega", "zeta9"]
    texts = [(f"c{i}", " ".join(rng.choice(words).upper() for _ in range(3))) for i in range(60)] + [("null", None)]
    writes = [(f"/w/{'_'.join(rng.sample(words, 3))}-{i}.py",) for i in range(20)] + [("c1",), (None,)]
    corpus = spark.createDataFrame(texts, "path string, content string")
    files = spark.createDataFrame(writes, "file_path string")
    for most in (200_000, 2):
        monkeypatch.setattr(literals, "MOST", most)
        got = {tuple(r) for r in K.candidates(files, corpus, None, None).collect()}
        want = {(f, t, c) for (f,) in writes if f for t in re.split("[_.-]", f.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                if len(t) > 3 for c, x in texts if x and t in x.lower()}
        assert got == want
        four = [tuple(r) for r in K.candidates(files, corpus).collect()]
        assert sorted(four) == sorted((f, t, c) for f, t in {w[:2] for w in want}
                                      for c in sorted(w[2] for w in want if w[:2] == (f, t))[:4])
    assert K.candidates(files.limit(0), corpus).collect() == []


def test_a_call_meets_one_handler_a_label_not_all_that_fit(spark):
    """A thousand handlers fit one path; what calls are joined with holds a few entries."""
    handlers = spark.createDataFrame(
        [(i, f"h{i}", [["pii"], ["regulated", None], None, [None]][i % 4], "roster_[0-9]") for i in range(6, 1006)]
        + [(2, "first", ["credential"], "roster"), (5, "plain", ["public"], None)],
        "ord int, id string, labels array<string>, pattern string")
    calls = spark.createDataFrame(
        [(1, "/hr/roster_1", ["pii"]), (2, "/hr/roster_1", ["regulated"]), (3, "/hr/roster_1", []), (4, "/hr/roster_1", None),
         (5, "/hr/roster_1", ["credential", "pii"]), (6, "/hr/roster_1", ["public"]), (7, None, ["pii"]), (8, "/x", ["pii"])],
        "n int, path string, labels array<string>")
    out = A.handler_by_table(calls, handlers)
    assert {r["n"]: r["handler"] for r in out.collect()} == {
        1: "h6", 2: "h6", 3: "h6", 4: "h6", 5: "first", 6: "plain", 7: None, 8: None}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"collect_list\(\w*struct\(id, id#\d+, wanted", plan)


def test_a_text_with_many_hits_sends_them_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(literals, "MOST_HITS", 5)
    words = [f"w{i:02d}" for i in range(23)]
    texts = spark.createDataFrame([("a", " ".join(words)), ("b", "w00 w22"), ("c", None)], "hit string, text string")
    known = spark.createDataFrame([(w,) for w in words], "low string")
    found = literals.scan(texts, known)
    assert sorted(map(tuple, found.collect())) == sorted([(w, "a") for w in words] + [("w00", "b"), ("w22", "b")])


def test_a_scan_of_many_short_rows_is_spread_by_rows(spark, monkeypatch, tmp_path):
    from provlake import session

    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(session, "UNCOUNTED", 0)
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    out = session.spread(spark.read.parquet(str(tmp_path / "t.parquet")))
    assert out.rdd.getNumPartitions() == 40
    assert out.count() == 40_000
