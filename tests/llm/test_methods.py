"""The operators against brute-force versions, held-out accuracy and round trips."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import duck_rows, spark_rows

from provlake.llm import (chat, covertree, fingerprint, language, mixing, ngram_join, packing,
                          sharding)
from provlake.llm.common import components
from provlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op2_chat", "op5_covertree", "op10_ngram_join"])
def test_equals_oracle(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLES[name], SF)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality"](spark, sf).toPandas().merge(
        spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.96
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_toxicity"](spark, sf).toPandas().merge(
        spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held.predicted[held.toxic == 1].mean() > 0.8


def test_language_held_out(spark, documents):
    got = QUERIES["op3_language"](spark, SF).toPandas().merge(documents[["doc_id", "lang"]])
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than LANGS, the rarest of which are known by their own words."""
    rng = random.Random(5)
    langs = [f"l{i:02}" for i in range(language.LANGS + 6)]
    vocab = {g: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)]
             for g in langs}
    rows = [(f"{g}-{i}", g, " ".join(rng.choices(vocab[g], k=30)))
            for g in langs for i in range(8 if g > "l63" else 12)]
    monkeypatch.setattr(language, "fit_in_task", lambda sample, fit: fit(sample.toPandas()))
    monkeypatch.setattr(language, "STEPS", 10)
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string").cache()
    model = language.train(docs)
    assert model["langs"] == langs
    got = language.score(docs.filter("lang > 'l63'"), model, as_name="found").collect()
    assert len(got) == 48 and all(r.found.lang == r.lang for r in got)


def test_code_switched_words(spark, documents):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    a = documents[documents.lang == "de"].text.iloc[3].split()[:40]
    b = documents[documents.lang == "fr"].text.iloc[3].split()[:60]
    d = spark.createDataFrame([(" ".join(a + b),)], "text string")
    runs = language.switches(d, model).first()["labelled"]["runs"]
    words = [r["lang"] for r in runs for _ in range(r["words"])]
    right = sum(w == t for w, t in zip(words, ["de"] * 40 + ["fr"] * 60, strict=True))
    assert right > 90 and len(runs) < 8


def test_forward_backward_is_that_of_the_whole_chain():
    rng = np.random.default_rng(0)
    t, length = np.exp(rng.normal(size=(3, 3))), np.array([0, 5, 700, 1, 256, 257])
    e = np.exp(rng.normal(size=(length.sum(), 3)))
    p, pairs = language.forward_backward(e, length, t)
    at, want = 0, np.zeros((3, 3))
    for n in length:
        x = e[at:at + n]
        f, b = [], [np.ones(3)] * n
        for i in range(n):
            v = ((f[-1] if f else np.ones(3)) @ t) * x[i]
            f.append(v / v.sum())
        for i in range(n - 2, -1, -1):
            v = t @ (x[i + 1] * b[i + 1])
            b[i] = v / v.sum()
        for i in range(n):
            q = f[i] * b[i]
            assert np.allclose(q / q.sum(), p[at + i])
            if i:
                m = f[i - 1][:, None] * t * (x[i] * b[i])
                want += m / m.sum()
        at += n
    assert np.allclose(want, pairs)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""),
           (1, 3, "delta", 2, None, "he"), (1, 5, "delta", 2, None, "lo"), (1, 4, "delta", 2, None, "l"),
           (1, 6, "message", 3, "user", "more"), (1, 7, "message", 4, "assistant", "wrong"),
           (1, 8, "regenerate", 2, None, None), (1, 9, "delta", 2, None, "bye"),
           (1, 10, "message", 5, "user", "x"), (1, 11, "edit", 5, None, "y"), (1, 12, "delta", 5, None, "z"),
           (2, 1, "delta", 7, "user", "late"), (2, 0, "message", 8, None, None)]
    rows = list(log)
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id long, role string, text string")
    got = chat.fold(d).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [
        (1, "user", "hi"), (1, "assistant", "bye"), (1, "user", "yz"), (2, "", ""), (2, "user", "late")]


def test_escapes_round_trip(spark):
    parts = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "assistant", "\n", "<\\|", "x"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    d = spark.createDataFrame([(0, i, i, t[:5], t) for i, t in enumerate(texts)],
                              "conv_id long, position long, message_id long, role string, text string")
    formatted = "".join(r.piece for r in chat.render(d).orderBy("position").collect())
    assert chat.parse(formatted) == [(t[:5], t) for t in texts]


def test_best_fit_decreasing():
    rng = random.Random(3)
    items = [(i, rng.randint(1, 60)) for i in range(300)]
    placed = sharding.best_fit_decreasing(items, 100)
    room, want = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            left, b = min(fits, key=lambda x: (x[0], -x[1]))
        else:
            left, b = 100, len(room)
            room.append(100)
        room[b], want[name] = left - size, b
    sizes = collections.Counter()
    for name, size in items:
        sizes[placed[name]] += size
    assert max(sizes.values()) <= 100 and len(sizes) == len(room)
    assert sorted(sizes.values()) == sorted(100 - r for r in room)


def test_shards_are_even_whole_and_gapless(spark, documents):
    got = QUERIES["op4_sharding"](spark, SF).toPandas().merge(documents[["doc_id", "text"]])
    assert len(got) == len(documents)
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() <= 1.01 * per.min()
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()


def test_hot_group_of_a_third(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got[got.doc_id % 3 == 0]["shard"].nunique() == 1 and len(got) == 900


@pytest.mark.parametrize("cosine", [0.9, 0.6])
def test_cover_tree_join(spark, cosine):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6))
    x = np.array([base[rng.integers(30) if i % 3 else 0] + rng.normal(size=6) * rng.choice([0, .01, .2, .5])
                  for i in range(900)])
    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(900), "embedding": x.tolist()}))
    got = covertree.near_duplicates(d, cosine, home=90, sample_size=200, most_cells=12).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    comp = np.arange(900)
    for _ in range(900):
        new = np.minimum(comp, np.where(link, comp[None, :], 900).min(1))
        if (new == comp).all():
            break
        comp = new
    assert (got.n_links.sort_index() == link.sum(1)).all()
    assert (got.component_id.sort_index() == comp).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)]
    rng.shuffle(edges)
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(d).collect()}
    loops = {a for a, b in edges if a == b}
    assert {i: top(i) for i in root if i in got or i not in loops} == got


def test_sharding_opens_as_many_shards_as_the_capacity_needs(spark):
    """Texts of 600 and 400 bytes pair up; one is larger than the capacity."""
    d = spark.createDataFrame(
        [(i, f"{i:04}" + "x" * (595 if i % 2 else 395)) for i in range(40)] + [(40, "y" * 1500)],
        "doc_id long, text string")
    by, slots = collections.defaultdict(int), collections.defaultdict(list)
    for r in sharding.shard(d, capacity=1000).collect():
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(by.values()) == [1000] * 20 + [1501] and set(by) == set(range(21))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # More bundles than ITEMS, each with many groups.
    d = spark.range(60_000).selectExpr("id AS doc_id", "concat(id, repeat('z', 60)) AS text")
    by = collections.Counter()
    for r in sharding.shard(d, capacity=20_000).select("shard", "size").collect():
        by[r.shard] += r.size
    assert max(by.values()) <= 20_000 and len(by) <= 1.02 * sum(by.values()) / 20_000 + 1


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000]) == [20.0, 1495.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_splitting_tree():
    counts = mixing.split([50, 3, 0, 200], 7, np.random.default_rng(1))
    assert counts.sum(0).tolist() == [50, 3, 0, 200]
    assert counts.sum(1).max() - counts.sum(1).min() <= 1


def test_mixture(spark, documents):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plans = mixing.plan(d, shards=5, block_words=8000)
    again = mixing.plan(d.repartition(7), shards=5, block_words=8000)
    assert plans == again
    got = mixing.draws(d, plans).toPandas()
    got["size"] = got["mix"].map(lambda m: m["size"])
    got["taken"] = got["mix"].map(lambda m: m["size"] * len(m["draws"]))
    want = mixing.targets(documents.assign(s=documents.text.str.split().str.len()).groupby("source").s.sum()
                          .sort_index().tolist())
    for (_, g), t in zip(got.groupby("source"), want, strict=True):
        assert abs(g["mix"].iloc[0]["target"] - t) < 1e-6 and -0.03 * t <= g.taken.sum() - t <= 1e-6
    assert (got.taken <= 2 * got["size"]).all()
    # Each source's block draws are disjoint, fill the shards' quotas and use every number once.
    blocks = collections.defaultdict(set)
    for r in got.itertuples():
        for x in r.mix["draws"]:
            blocks[r.source].add(x["shard"])
    assert all(len(b) > 1 for b in blocks.values())
    mixed = mixing.mix(d, plans)
    assert mixed.columns == [*d.columns, "_shard"]
    assert mixed.count() == sum(len(m["draws"]) for m in got["mix"])


def _greedy(rows, room):
    """Places taken of rows (place, words), in order, each that fits; the words taken."""
    taken, left = set(), room
    for at, size in sorted(rows):
        if 0 < size <= left:
            taken.add(at)
            left -= size
    return taken, room - left


@pytest.mark.parametrize("seed", [1, 2, 3, 20])
def test_mixture_fills_the_room_after_a_long_document(spark, seed):
    """A source with documents of 10% or more of its words, and many short ones, meets its target."""
    from pyspark.sql import functions as F
    sizes = [40 + i % 21 for i in range(2000)] + [30_000, 31_000, 32_000]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").select(
        "doc_id", F.lit("s").alias("source"), F.expr("repeat('w ', n)").alias("text"))
    plans = mixing.plan(d, share=0.6, shards=5, seed=seed, block_words=4000)
    got = mixing.draws(d, plans, seed=seed).select("doc_id", "mix.*").collect()
    room = int(0.6 * sum(sizes))
    want, words = _greedy([(r.place, r["size"]) for r in got], room)
    assert {r.place for r in got if r.draws} == want
    assert plans[0]["filled"] == words and room - words < 40
    filled = collections.Counter()
    for r in got:
        for x in r.draws:
            filled[x["shard"]] += r["size"]
    assert sum(filled.values()) == words and set(filled) <= set(range(5))


def test_mixture_takes_equal_ids_together(spark):
    from pyspark.sql import functions as F
    rng = random.Random(4)
    rows = [(i // 2, rng.choice([0, 3, 50, 200, 900])) for i in range(400)] + [(None, 700), (None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, n int").select(
        "doc_id", F.lit(None).cast("string").alias("source"), F.expr("repeat('w ', n)").alias("text"))
    for seed in range(3):
        plans = mixing.plan(d, share=0.55, shards=3, seed=seed, block_words=500)
        got = mixing.draws(d, plans, seed=seed).collect()
        by, times = collections.Counter(), collections.defaultdict(set)
        for r in got:
            by[r.mix["place"]] += r.mix["size"]
            times[r.mix["place"]].add(len(r.mix["draws"]))
        assert len(got) == len(rows) and all(len(t) == 1 for t in times.values())
        want, words = _greedy(list(by.items()), int(0.55 * sum(n for _, n in rows)))
        assert {p for p, t in times.items() if t == {1} and by[p]} == want
        assert words == plans[0]["filled"]


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op7_packing"](spark, SF).toPandas()
    assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in got.length)
    by = dict(list(got.sort_values("start").groupby("doc_id")))
    for r in documents.itertuples():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        g = by[r.doc_id]
        assert g.start.tolist() == [0, *itertools.accumulate(g.length.tolist()[:-1])]
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert zlib.crc32(ids[s:s + n].tobytes()) == c


def test_words_are_tokenized_as_the_tokenizer_does():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, cache = Tokenizer.from_file(path), packing.WordCache(path)
    parts = [" ", "  ", "\n", " \n", "a", "Bc", "'s", ".", "<|endoftext|>", "é", "\x85", "　", "\t", "12", "😀",
             "\x1c", "\xa0"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for t, ids in zip(texts, cache.ids(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_the_tokenizer_is_loaded_once_a_text_needs_it():
    cache = packing.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(len(ids) for ids in cache.ids(["plain words", "and, some. more"])) and "tokenizer" not in vars(cache)
    assert [len(ids) for ids in cache.ids(["<|endoftext|>"])] == [
        len(cache.tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids)]


def _jaccard(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(spark, documents):
    got = QUERIES["op9_fingerprint"](spark, SF).toPandas().sort_values("doc_id")
    texts = documents.text.tolist()
    assert got.doc_id.tolist() == documents.doc_id.tolist() and got.n_chars.tolist() == list(map(len, texts))
    after = texts[1:] + texts[:1]
    edited = [a[:len(a) - len(a) // 2] + b[:len(a) // 2] for a, b in zip(texts, after, strict=True)]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    for est, other in ((got.near_edited, edited), (got.near_next, after)):
        true = np.array([_jaccard(a, b) for a, b in zip(texts, other, strict=True)])
        assert abs((est - true).mean()) < 0.02 and np.abs(est - true).mean() < 0.06
    by = collections.defaultdict(set)
    for t, f in zip(texts, got.fingerprint, strict=True):
        by[t].add(f)
    assert all(len(v) == 1 for v in by.values())


def test_weighted_samples_estimate_generalised_jaccard():
    sampler = fingerprint.Sampler(4096)
    a, b = "x x x y z z", "x y y y z z w"
    assert abs(fingerprint.likeness(sampler(a), sampler(b)) - _jaccard(a, b)) < 0.03
    assert (sampler("") == 0).all() and (sampler("a") != 0).all()


def _links(sets, percent):
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def test_tree_loses_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        s = rng.integers(0, 1 << 64, rng.integers(1, 90), dtype=np.uint64)
        for _ in range(rng.integers(1, 6)):
            keep = s[rng.random(len(s)) > 0.08]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 64, 2, dtype=np.uint64))))
    size = np.array([len(s) for s in sets])
    found = set()
    for a, b, _ in ngram_join.Tree(ngram_join.points(sets), size).pairs(85):
        found |= {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert _links([set(s.tolist()) for s in sets], 85) <= found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_join_of_hot_and_near_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, texts = make(60), make(200), []
    for _ in range(150):
        texts.append(make(rng.randint(3, 120)) + passage * (rng.random() < 0.5) + make(rng.randint(0, 40)))
    for _ in range(700):  # more than one shard of near copies
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(t)
    texts += [passage] * 30 + [passage[:50], passage[:40], ["A", "B"], ["a", "b"], ["a"]]
    rng.shuffle(texts)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        t = [w.lower() for w in t]
        sets.append({tuple(t[i:i + 4]) for i in range(len(t) - 3)} if len(t) > 3 else {tuple(t)} - {()})
    comp = list(range(len(sets)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i, j in sorted(_links(sets, 85)):
        a, b = sorted((top(i), top(j)))
        comp[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(d).collect()}
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_prefixes_meet():
    for n in range(1, 200):
        assert ngram_join.prefix_length(n) == n - math.ceil(0.85 * n - 1e-9) + 1


def test_bitmap_keeps_what_is_wanted_and_little_else(spark):
    docs = spark.range(20000).selectExpr("id AS rep", "cast(id AS string) AS text")
    ids = spark.createDataFrame([(i,) for i in range(0, 20000, 100)] + [(None,)], "rep long")
    kept = {r.rep for r in ngram_join._among(docs, ids, "rep").collect()}
    assert set(range(0, 20000, 100)) <= kept and len(kept) < 230
