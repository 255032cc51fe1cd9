"""Cases that showed a defect once, and plain recomputations of learned scores."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provlake.llm import chat, common, fingerprint, language, mixing, packing, quality, toxicity


def test_large_conversation_ids_beside_a_null_one(spark):
    big = 1 << 53
    turns = spark.createDataFrame([(big, 0, "user", "a"), (big + 1, 0, "user", "b"), (None, 0, "user", "c"),
                                   (big + 1, 1, "assistant", "d")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.render(chat.fold(chat.log_of_turns(turns)))).collect()}
    assert got == {big: 1, big + 1: 2, None: 1}


def test_quality_score_is_that_of_its_dictionaries(spark):
    """Scores recomputed from the two dictionaries, byte by byte and without the operator's classes."""
    import zstandard as zstd
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "mountain", "signal", "theory"]) for _ in range(80)) for _ in range(40)]
    bad = [" ".join(rng.choice(["buy", "click", "cheap", "now!!"]) for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    sizes = {}
    for k in ("good", "bad"):
        d = zstd.ZstdCompressionDict(model[k])
        d.precompute_compress(level=quality.LEVEL)
        c = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                write_dict_id=False)
        sizes[k] = lambda t, c=c: sum(len(c.compress(t[i:i + 2048])) for i in range(0, len(t), 2048))
    for r in quality.score(docs, model).collect():
        t = r["text"].encode()
        x = (sizes["bad"](t) - sizes["good"](t) + 48 * model["usual"]) / (len(t) + 48)
        z = model["slope"] * np.tanh(x / model["scale"]) + model["cut"]
        assert r["quality"]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r["quality"]["difference"] == pytest.approx(x, abs=1e-12)
        assert (r["quality"]["score"] > 0.5) == (r["doc_id"] < 40)


def _texts(rng, kind, n):
    voc = [f"w{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(voc) for _ in range(40)]
        for there, word in ((a, "insult"), (b, "group")):
            if there:
                w.insert(rng.randrange(40), word)
        yield i, int(a != b if kind == "xor" else a and b), " ".join(w)


@pytest.mark.parametrize("kind", ["xor", "and"])
def test_pairs_are_learned_that_no_word_shows_alone(kind):
    rows = pd.DataFrame(_texts(random.Random(3), kind, 2400), columns=["doc_id", "y", "text"])
    model = toxicity._fit(rows.y.mean())(rows[:1600])
    score = toxicity._scorer(model)(rows[1600:].text).score
    assert ((score >= 0.5) == (rows.y[1600:] == 1).to_numpy()).mean() > 0.97


def test_machine_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    x, w, v, b = rng.random((5, 12)), rng.normal(size=12), rng.normal(size=(12, 3)), 0.4
    got = toxicity._logit(x, w, v, b)[0]
    want = [b + sum(w[i] * r[i] for i in range(12)) + sum(
        (v[i] @ v[j]) * r[i] * r[j] for i, j in itertools.combinations(range(12), 2)) for r in x]
    assert np.allclose(got, want)


def test_scores_are_those_of_the_pairs_of_a_text():
    rows = pd.DataFrame(_texts(random.Random(5), "and", 600), columns=["doc_id", "y", "text"])
    m = toxicity._fit(rows.y.mean())(rows)
    place = {int(a): i for i, a in enumerate(m["active"])}
    for t in [*rows.text[:20], "", None, "insult insult group"]:
        n = collections.Counter(place[x] for token in (t or "").split() for x in toxicity.terms(token) if x in place)
        x = {i: np.log2(1 + c) for i, c in n.items()}
        z = m["b"] + sum(m["w"][i] * a for i, a in x.items()) + sum(
            float(m["v"][i] @ m["v"][j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        want = 1 / (1 + np.exp(-np.clip(m["slope"] * np.arcsinh(z / m["scale"]), -30, 30)))
        assert toxicity._scorer(m)(pd.Series([t])).score[0] == pytest.approx(want, abs=1e-4)


def test_models_of_repeated_ids_repeat(spark):
    rows = [(i // 2, f"{'good' if i % 4 < 2 else 'bad'} text {i} " * 20, "en" if i % 4 < 2 else "de") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    for learnt in (lambda d: common.labelled_sample(d, labels, "toxic"), ):
        a, b = (sorted(map(tuple, learnt(d).collect())) for d in (docs, docs.repartition(7).orderBy(F.rand(3))))
        assert a == b and len(a) == len({r[:2] for r in a})
    a, b = (language.train(d) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a["weights"], b["weights"])


# ── mixing ──────────────────────────────────────────────────────────────────────────────────
def _sources(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 6}", rng.randint(1, 60)) for i in range(2400)] + [(None, "s1", k % 7) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, source string, n int").select(
        "doc_id", "source", F.expr("concat(repeat('w ', n), ' ', coalesce(doc_id, n))").alias("text")).cache()


def test_documents_are_taken_because_their_blocks_are_drawn(spark):
    d = _sources(spark)
    plans = mixing.plan(d, shards=12, block_words=300)
    drawn = mixing._drawn(spark, plans, mixing.SEED).collect()
    per = collections.defaultdict(collections.Counter)
    for p in plans:
        own = [r for r in drawn if r["n"] == p["n"]]
        assert len(own) == 1 << p["bits"] and len(own) >= 12
        assert sorted(r["rank"] for r in own) == list(range(len(own)))
        counts = collections.Counter(s for r in own for s in r["whole"])
        counts.update(r["last"] for r in own if r["rank"] < p["part"])
        # Exact quotas, drawn without repetition: every block once in a pass, every draw in one shard.
        assert sum(counts.values()) == p["quota"] == p["whole"] * len(own) + p["part"]
        assert all(len(r["whole"]) == p["whole"] for r in own)
        bounds = np.diff([0, *p["bounds"]])
        assert [counts[k] for k in range(12)] == bounds.tolist()
        for k in range(12):
            per[k][p["n"]] = counts[k]
    total = [sum(c.values()) for c in per.values()]
    assert max(total) - min(total) <= 1 and all(sum(v > 0 for v in c.values()) >= 5 for c in per.values())
    # Every shard's share of a source is near the quotas' share.
    for p in plans:
        share = p["quota"] / sum(q["quota"] for q in plans)
        assert all(abs(c[p["n"]] / sum(c.values()) - share) < 0.25 for c in per.values())
    blocks = {(r["n"], r["block"]): r for r in drawn}
    for r in mixing.draws(d, plans).withColumn("at", mixing.place()).collect():
        p = next(p for p in plans if p["source"] == r["source"])
        b = blocks[p["n"], r["at"] >> (63 - p["bits"]) if p["bits"] else 0]
        shards = [x["shard"] for x in r["mix"]["draws"]]
        assert shards[:p["whole"]] == b["whole"] and shards[p["whole"]:] in ([], [b["last"]])
        if b["rank"] + 1 < p["part"] and 0 < r["mix"]["size"] <= p["room"]:
            assert len(shards) == p["whole"] + 1
    d.unpersist()


def test_null_ids_are_spread_and_targets_met(spark):
    rng = random.Random(4)
    rows = [(i if i % 2 else None, "s", rng.randint(20, 60), i) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n int, k int").select(
        "doc_id", "source", F.expr("concat(repeat('w ', n), k)").alias("text"))
    plans = mixing.plan(d, share=0.4)
    taken = mixing.draws(d, plans).select((F.col("mix.size") * F.size("mix.draws")).alias("t")).agg(F.sum("t")).first()[0]
    assert 0.4 * plans[0]["source_size"] - taken < 20


def test_mixed_rows_are_shuffled_in_their_shards(spark):
    d = _sources(spark)
    plans = mixing.plan(d)
    mixed = mixing.mix(d, plans).toPandas()
    want = collections.Counter()
    for r in mixing.draws(d, plans).collect():
        want.update((r["text"], x["shard"]) for x in r["mix"]["draws"])
    assert collections.Counter(zip(mixed.text, mixed._shard)) == want
    for _, g in mixed.groupby("_shard"):
        assert g.source.nunique() > 3 and not g.doc_id.dropna().is_monotonic_increasing
    d.unpersist()


# ── fingerprints ────────────────────────────────────────────────────────────────────────────
def _plain_fingerprint(text, n=fingerprint.SAMPLES):
    """Word by word, all samples of all words, without what the operator remembers."""
    best = []
    for word, times in collections.Counter(text.split()).items():
        h = fingerprint._hashes([word])
        best.append((fingerprint.samples(h, np.array([float(times)]), n)[0], h[0], times))
    if not best:
        return np.zeros(n, np.uint16)
    pick = np.array([b[0] for b in best]).argmin(0)
    return fingerprint.drawn(np.array([[best[p][1] for p in pick]], np.uint64),
                             np.array([[best[p][2] for p in pick]]))[0]


def test_edited_texts_take_the_words_of_their_documents():
    rng, sampler = random.Random(2), fingerprint.Sampler(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab  \u3000\n") for _ in range(rng.randrange(12))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        of_a, of_b = sampler.ids([a, b])
        assert sampler.joined(a[:i], of_a, b[:j], of_b).tolist() == sampler.ids([a[:i] + b[:j]])[0].tolist()


def test_words_are_worked_out_once_and_without_t_where_they_come_once(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice([f"w{rng.randrange(900)}", "the", "of"]) for _ in range(rng.randrange(200)))
             for _ in range(60)] + ["", " ", "x", "x x x"]
    want = np.array([_plain_fingerprint(t) for t in texts])
    asked, real = collections.Counter(), fingerprint.samples

    def counted(word_hash, weight, n):
        asked.update((int(h), 1 if weight is None else int(weight[i])) for i, h in enumerate(word_hash))
        assert weight is None or (weight > 1).all()
        return real(word_hash, weight, n)
    monkeypatch.setattr(fingerprint, "samples", counted)
    sampler = fingerprint.Sampler()
    assert (sampler.of_ids(sampler.ids(texts)) == want).all()
    assert all((sampler(t) == w).all() for t, w in zip(texts, want, strict=True))
    assert max(asked.values()) == 1


def test_fingerprints_of_more_rows_than_are_sampled_at_once(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(40)))
             for _ in range(4 * fingerprint.ROWS + 3)]
    docs = spark.createDataFrame([(3 * i, t or None) for i, t in enumerate(texts)], "doc_id long, text string")
    got = fingerprint.fingerprints(docs.repartition(5)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [3 * i for i in range(len(texts))]
    for r, a, b in zip(got, texts, texts[1:] + texts[:1], strict=True):
        half = len(a) // 2
        edited = a[:len(a) - half] + b[:half]
        own, e, after = map(_plain_fingerprint, (a, edited, b))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.written(own), fingerprint.written(e))
        assert (r["near_edited"], r["near_next"]) == ((own == e).mean(), (own == after).mean())


# ── packing ─────────────────────────────────────────────────────────────────────────────────
def test_packing_remembers_a_bounded_number_of_words():
    import public_tokenizers
    cache = packing.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    batch = 20_000
    for k in range(8):
        texts = [" ".join(f"q{k}x{i + j}" for j in range(100)) for i in range(0, batch, 100)]
        ids = list(cache.ids(texts))
        assert len(ids) == len(texts)
        assert ids[0].tolist() == cache.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert sum(map(len, cache.words.values())) <= 100_000 + batch
