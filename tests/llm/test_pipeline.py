"""The pipeline's stages against plain versions on the tables of sf0.01."""

import itertools

import pytest

import corpus_pipeline
from provlake.llm import mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out[name] = docs.toPandas()
    return out


def test_stages_keep_the_columns(kept):
    for name in ("language_id", "toxicity", "near_duplicates", "mixture"):
        assert list(kept[name].columns) == list(kept["documents"].columns)


def test_clean_documents_stay(spark, kept):
    assert len(kept["language_id"]) >= 0.99 * len(kept["documents"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    gone = kept["language_id"][~kept["language_id"].doc_id.isin(kept["toxicity"].doc_id)].merge(labels)
    assert len(gone) and gone.toxic.mean() > 0.9


def test_one_document_of_each_group_stays(kept):
    before, after = kept["toxicity"].sort_values("doc_id"), set(kept["near_duplicates"].doc_id)
    sets, index = {}, {}
    for r in before.itertuples():
        w = r.text.translate({c: c + 32 for c in range(65, 91)}).split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        for x in sets[r.doc_id]:
            index.setdefault(x, []).append(r.doc_id)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    pairs = {p for ids in index.values() for p in itertools.combinations(ids, 2)}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            top[b] = a
    assert after == {i for i in sets if root(i) == i}


def test_mixture_takes_the_targets(kept):
    before, after = kept["near_duplicates"], kept["mixture"]
    size = lambda d: d.text.str.split().str.len().groupby(d.source).sum().sort_index()
    want = mixing.targets(size(before).tolist())
    got = size(after).reindex(size(before).index).fillna(0)
    assert all(-0.03 * w - 30 <= g - w <= 1e-6 for g, w in zip(got, want, strict=True))


def test_everything_mixed_is_packed(kept):
    assert set(kept["packed"].doc_id) == set(kept["mixture"].doc_id)
    whole = kept["packed"][kept["packed"].start == 0]
    assert len(whole) == len(kept["mixture"])
    assert kept["packed"].length.sum() == whole.doc_tokens.sum()
