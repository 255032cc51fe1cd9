"""Toxicity by a factorization machine over hashed terms.

Terms are a word and its stems (the word's first 4 to 8 letters), lower-cased and stripped of
everything but letters, hashed into buckets. A text is the vector of x = log2(1 + count) of its
terms; the machine adds to the linear weights an interaction <v_i, v_j> x_i x_j for every pair of
terms, so that two terms can mean together what neither means alone. Buckets that the bounded
sample shows in too few texts have no weight, nor have those without regard to the label, by
themselves or together with another bucket. How steeply the machine's sums turn into scores is
fitted on texts that it has not learnt from, fold by fold.

Whole texts are scored; null and empty texts get the score of no term. Repeated rows are scored
alike; without usable labels of both classes the score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import (SAMPLE_PER_CLASS, fit_in_task, fresh, held_out, labelled_sample, logistic,
                                 scored)

BUCKET_BITS = 20
STEMS = range(4, 9)
#: Terms with weights, at most, and the texts of the sample that must hold one.
ACTIVE, LEAST_TEXTS = 2048, 4
RANK, STEPS, RATE = 8, 200, 0.05
LINEAR_DECAY, PAIR_DECAY = 2e-5, 3e-4
THRESHOLD = 0.5
#: Buckets whose pairs are tried, and pairs whose buckets get weights: those that say this much
#: more (standard deviations) than either bucket alone.
TRIED, PAIRS, PAIR_GAIN = 2048, 256, 6.0
#: Folds of the learnt texts for the curve.
FITS = 2
#: Words remembered by a task before it forgets all and starts anew.
REMEMBERED = 250_000


def terms(token: str) -> list[int]:
    """Buckets of a white-space token: its word and stems; none without a letter."""
    word = "".join(c for c in token.lower() if c.isalpha())
    if not word:
        return []
    found = [word + "$", *(word[:n] for n in STEMS if n <= len(word))]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (32 - BUCKET_BITS) for t in found]


class Bags:
    """Term counts of texts over the active buckets; remembers words."""

    def __init__(self, active: np.ndarray | None = None):
        self.row = None if active is None else {int(b): i for i, b in enumerate(active)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def _of(self, token: str) -> tuple[int, ...]:
        t = tuple(terms(token))
        if self.row is not None:
            t = tuple(self.row[b] for b in t if b in self.row)
        self.seen[token] = t
        return t

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen, of, ids = self.seen, self._of, []
        for token in (text or "").split():
            t = seen.get(token)
            if t is None:
                t = of(token)
            if t:
                ids.extend(t)
        return np.unique(np.array(ids, dtype=np.int64), return_counts=True)


def _logit(x, w, v, b):
    xv = x @ v
    return b + x @ w + 0.5 * ((xv ** 2).sum(1) - (x ** 2) @ (v ** 2).sum(1)), xv


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Weights by full-batch Adam on the logistic loss, with decay towards 0."""
    rng = np.random.default_rng(5)
    n = x.shape[1]
    p = [np.zeros(n, np.float32), rng.normal(0, 0.02, (n, RANK)).astype(np.float32), np.float32(-1)]
    m, s = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    square = x ** 2
    for step in range(1, STEPS + 1):
        w, v, b = p
        z, xv = _logit(x, w, v, b)
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(np.float32)
        grads = [x.T @ g + LINEAR_DECAY * np.sign(w),
                 x.T @ (g[:, None] * xv) - v * (square.T @ g)[:, None] + PAIR_DECAY * v, g.sum()]
        rate = RATE * (1 - (step - 1) / STEPS)
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.99 ** step)) + 1e-8)
    return p[0], p[1], float(p[2])


def _alone(df: np.ndarray, pos: np.ndarray, n: int, share: float) -> np.ndarray:
    """How far the texts with a bucket (or pair) leave the usual share of label 1."""
    expected = df * share
    return (pos - expected) / np.sqrt(expected * (1 - df / n) + 1e-9)


def _together(on: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Columns of the pairs that say most beyond what their columns say alone."""
    both, pos = on.T @ on, (on * y[:, None]).T @ on
    gain = np.abs(_alone(both, pos, len(y), y.mean())) - np.maximum.outer(np.abs(z), np.abs(z))
    gain[both < LEAST_TEXTS] = 0
    gain = np.triu(gain, 1)
    best = np.argsort(-gain, axis=None, kind="stable")[:PAIRS]
    i, j = np.unravel_index(best[gain.ravel()[best] > PAIR_GAIN], gain.shape)
    return np.unique(np.concatenate([i, j]))


def _chosen(owner: np.ndarray, col: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """Columns with weights: by themselves, then by pairs of the most telling frequent ones."""
    n = len(y)
    df = np.bincount(col, minlength=buckets)
    z = _alone(df, np.bincount(col, weights=y[owner], minlength=buckets), n, y.mean())
    z[df < LEAST_TEXTS] = 0
    tried = np.argsort(-df * (n - df) * (df >= LEAST_TEXTS), kind="stable")[:TRIED]
    tried = np.sort(tried[df[tried] >= LEAST_TEXTS])
    at = np.full(buckets, -1)
    at[tried] = np.arange(len(tried))
    on = np.zeros((n, len(tried)), np.float32)
    seen = at[col] >= 0
    on[owner[seen], at[col][seen]] = 1
    paired = tried[_together(on, y, z[tried])] if len(tried) > 1 else tried[:0]
    best = np.argsort(-np.abs(z), kind="stable")[:ACTIVE - len(paired)]
    return np.union1d(best[np.abs(z[best]) > 1], paired)


def _fit(share: float | None):
    def fit(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        y = rows["y"].to_numpy(dtype=np.float32) if len(rows) else np.zeros(0, np.float32)
        if (y == 1).sum() < 2 or (y == 0).sum() < 2:
            return {"prior": float(share or 0.0)}
        bags = Bags()
        # The features take single precision; what lies beside them is kept as narrow and no longer.
        found, values = [], []
        for ids, count in map(bags.counts, rows["text"]):
            found.append(ids)
            values.append(np.log2(1 + count).astype(np.float32))
        del bags
        owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
        bucket, col = np.unique(np.concatenate(found), return_inverse=True)
        col, value = col.astype(np.int32), np.concatenate(values)
        del found, values
        # Weights give the classes the shares that they have among all labels.
        wanted = share if share is not None and 0 < share < 1 else y.mean()

        def features(use: np.ndarray, keep: np.ndarray) -> np.ndarray:
            """The kept columns of some of the texts: the largest arrays, so no more rows than needed."""
            place = np.full(len(bucket), -1, np.int32)
            place[keep] = np.arange(len(keep))
            x = np.zeros((int(use.sum()), len(keep)), np.float32)
            on = np.flatnonzero((place[col] >= 0) & use[owner])
            x[(np.cumsum(use) - 1)[owner[on]], place[col[on]]] = value[on]
            return x

        def learnt(use: np.ndarray) -> tuple:
            """(columns, weights) from some of the texts."""
            part = np.cumsum(use) - 1
            own = use[owner]
            keep = _chosen(part[owner[own]], col[own], y[use], len(bucket))
            seen = y[use].mean()
            weight = np.where(y[use] == 1, wanted / seen, (1 - wanted) / (1 - seen)) / use.sum()
            return keep, _machine(features(use, keep), y[use], weight.astype(np.float32))

        keep, (w, v, b) = learnt(np.ones(len(y), bool))
        fold = rows.groupby("y").cumcount().to_numpy() % FITS
        z = np.zeros(len(y))
        for k in range(FITS):
            rest = fold != k
            if len(np.unique(y[rest])) < 2 or (fold == k).sum() == 0:
                z[~rest] = _logit(features(~rest, keep), w, v, b)[0]
                continue
            kept, machine = learnt(rest)
            z[~rest] = _logit(features(~rest, kept).astype(float), *machine)[0]
        scale = float(np.median(np.abs(z))) or 1.0
        # The machine, fitted to the classes' shares, decides at 0; the curve only says how surely.
        slope, _ = logistic(np.arcsinh(z / scale), y)
        return {"active": bucket[keep], "w": w, "v": v, "b": b, "scale": scale, "slope": max(slope, 1e-3)}
    return fit


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          per_class: int = SAMPLE_PER_CLASS) -> dict:
    """The machine, from at most ``per_class`` learnable texts of each class."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & ~held_out())
    share = usable.agg(F.avg("y")).first()[0]
    return fit_in_task(labelled_sample(docs, labels, label, per_class), _fit(share))


def _scorer(model: dict):
    if "w" not in model:
        return lambda s: pd.Series(np.full(len(s), model["prior"])).to_frame("score")
    bags = Bags(model["active"])
    w, v, b = model["w"].astype(float), model["v"].astype(float), model["b"]
    def score(s: pd.Series) -> pd.DataFrame:
        z = np.empty(len(s))
        for i, t in enumerate(s):
            ids, n = bags.counts(t)
            x = np.log2(1.0 + n)
            z[i] = _logit(x[None, :], w[ids], v[ids], b)[0][0]
        z = model["slope"] * np.arcsinh(z / model["scale"])
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})
    return score


def score(docs: DataFrame, model: dict, text: str = "text", as_name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct (score) under ``as_name``, or a longer free name."""
    return scored(docs, model, _scorer, "score double", fresh(as_name, docs.columns), text)
