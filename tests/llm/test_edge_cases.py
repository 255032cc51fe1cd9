"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import edge
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provlake.llm import (chat, covertree, fingerprint, language, mixing, ngram_join, packing,
                          quality, sharding, toxicity)

BPE = public_tokenizers.path("byte_bpe_50k.json")
ROWS = 33


def _quality(d, labels):
    return quality.score(d, quality.train(d, labels), as_name="score")


def _toxicity(d, labels):
    return toxicity.score(d, toxicity.train(d, labels), as_name="score")


def _language(d, labels):
    return language.score(d, language.train(d), as_name="score")


PER_ROW = {
    "quality": _quality, "toxicity": _toxicity, "language": _language,
    "sharding": lambda d, _: sharding.shard(d),
    "mixing": lambda d, _: mixing.draws(d, mixing.plan(d)),
    "fingerprint": lambda d, _: fingerprint.fingerprints(d),
    "ngram_join": lambda d, _: ngram_join.classes(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(spark, name):
    out = PER_ROW[name](edge.documents(spark), edge.labels(spark)).collect()
    assert len(out) == ROWS


@pytest.mark.parametrize("name", PER_ROW)
def test_no_rows(spark, name):
    assert PER_ROW[name](edge.empty(spark), edge.labels(spark).limit(0)).collect() == []


def test_scores_keep_clashing_columns(spark):
    d = edge.documents(spark)
    out = quality.score(d, quality.train(d, edge.labels(spark)), as_name="score")
    assert out.columns == [*d.columns, "score_"]
    assert {r["score"] for r in out.collect()} == {1.0}
    assert all(0 <= r["score_"]["score"] <= 1 for r in out.collect())


def test_language_without_letters_is_und(spark):
    d = edge.documents(spark)
    got = {r["doc_id"]: (r["language"]["lang"], r["language"]["score"])
           for r in language.score(d, language.train(d)).collect()}
    assert {i for i, v in got.items() if v == ("und", 0.0)} == {20, 21, 22, 24, 30}


def test_without_labels(spark):
    d = edge.documents(spark)
    none = edge.labels(spark).limit(0)
    assert {r["quality"]["score"] for r in quality.score(d, quality.train(d, none)).collect()} == {0.5}
    assert {r["toxicity"]["score"] for r in toxicity.score(d, toxicity.train(d, none)).collect()} == {0.0}
    assert {r["language"]["lang"] for r in language.score(d, None).collect()} == {"und"}


def test_packing(spark):
    got = packing.pack(edge.documents(spark), BPE)
    rows = got.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == max(r.sequence_id for r in rows) + 1
    one = {r.doc_id: r.doc_tokens for r in rows}
    assert one[20] == one[21] == one[30] == 1
    assert packing.pack(edge.empty(spark), BPE).collect() == []
    twice = [r for r in rows if r.doc_id == 27]
    assert sum(r.length for r in twice) == 2 * one[27]


def test_ngram_join(spark):
    got = ngram_join.classes(edge.documents(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[i].component_id for i in (26, 27, 28)} == {26}
    assert all(by[i].component_id == i and by[i].n_shingles == 0 for i in (20, 21, 22, 30))
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = ngram_join.representatives(edge.documents(spark))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.documents(spark).columns
    assert sorted(i for i in ids if i is not None) == [i for i in range(32) if i not in (27, 28, 29)]
    assert ids.count(None) == 1


def test_near_duplicates_of_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]),
            (2, [1.0, 0.1]), (None, [1.0, 0.0]), (11, [1e300, 1e299]), (12, [1e-300, 0.0])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(d).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 11: (4, 0), 12: (4, 0), None: (0, None),
                   **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    assert len(covertree.near_duplicates(d).collect()) == len(rows)
    assert covertree.near_duplicates(d.limit(0)).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", ""),
            (2, 0, "a\nb\\", "<|im_end|> <\\|im_start|> \\<|"), (2, 1, "assistant", "<")]
    turns = spark.createDataFrame([(*r, 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, seq int")
    messages = chat.fold(chat.log_of_turns(turns))
    pieces = chat.render(messages)
    got = {r.conv_id: r for r in chat.digest(pieces).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[2].loss_chars == 1
    text = "".join(r.piece for r in pieces.where("conv_id = 2").orderBy("position").collect())
    assert chat.parse(text) == [(r[2], r[3]) for r in rows[4:]]
    assert chat.digest(chat.render(chat.fold(chat.log_of_turns(turns.limit(0))))).collect() == []


def test_sharding_and_mixing_groups(spark):
    got = sharding.shard(edge.documents(spark)).collect()
    assert len({r["shard"] for r in got if r.doc_id in (26, 27, None)}) == 1
    mixed = mixing.draws(edge.documents(spark), mixing.plan(edge.documents(spark)))
    assert mixed.columns[-1] == "_mix" + "_" or "mix" in mixed.columns
    sizes = {r.doc_id: r["mix"]["size"] for r in mixed.collect()}
    assert sizes[20] == sizes[21] == sizes[22] == 0 and sizes[25] == 1


@pytest.mark.parametrize("make", [edge.documents, edge.empty])
def test_pipeline_stages(spark, tmp_path, make):
    edge.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packed":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.filter(F.col("length") > 0).count() == docs.count()
