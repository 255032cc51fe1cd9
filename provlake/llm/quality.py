"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad.
A text is compressed piece by piece under both; the difference of the compressed sizes, divided
by the text's own size, says which class it resembles (text that repeats itself gains nothing
from either dictionary and stays near 0, below ordinary good text). A text of few bytes carries
little evidence, so the ratio is shrunk towards the usual one of learnt texts. A logistic curve
fitted on labelled texts that no dictionary has seen turns it into the probability of label 1.

Every byte of a text is compressed (pieces keep the dictionary relevant through long texts).
Empty and null texts get the curve's value at the usual ratio. Repeated rows are
scored alike; without usable labels of both classes the score is the share of label 1 (0.5
without any label).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import (SAMPLE_PER_CLASS, fit_in_task, fresh, held_out, labelled_sample, logistic,
                                 scored)

DICTIONARY_BYTES = 65536
PIECE_BYTES = 2048
LEVEL = 3
#: Text that a dictionary is trained on, as a multiple of its size.
TRAIN_FACTOR = 100
#: A text's evidence is weighed against the usual ratio as if that had been seen on so many bytes.
PRIOR_BYTES = 48
#: Folds of the learnt texts for the curve.
FITS = 3
THRESHOLD = 0.3


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


class Compressors:
    """The two trained dictionaries, ready to compress."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self._ready(d) for d in (good, bad))

    @staticmethod
    def _ready(data: bytes) -> zstd.ZstdCompressor:
        d = zstd.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                   write_checksum=False, write_dict_id=False)

    def difference(self, text: str | None) -> tuple[int, int]:
        """Compressed bytes that the good dictionary saves over the bad one; bytes of the text."""
        saved = size = 0
        for x in pieces(text):
            saved += len(self.bad.compress(x)) - len(self.good.compress(x))
            size += len(x)
        return saved, size


def _ratio(found: list[tuple[int, int]] | np.ndarray, usual: float) -> np.ndarray:
    saved, size = np.array(found, dtype=float).reshape(-1, 2).T
    return (saved + PRIOR_BYTES * usual) / (size + PRIOR_BYTES)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; fewer or shorter texts than training needs are used as they are."""
    order = np.random.default_rng(7)
    samples = [x for t in texts for x in pieces(t) if len(x) >= 16]
    samples = [samples[i] for i in order.permutation(len(samples))]
    total = np.cumsum([len(x) for x in samples])
    samples = samples[:int(np.searchsorted(total, TRAIN_FACTOR * DICTIONARY_BYTES)) + 1]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        # zstandard takes content without a dictionary header as a raw dictionary.
        return b"\n" + b"".join(samples)[-DICTIONARY_BYTES:] + b"\n" * 8


def _squash(x: np.ndarray, scale: float) -> np.ndarray:
    """Differences far from 0 say no more than moderate ones; they must not set the slope."""
    return np.tanh(x / scale)


def _fit(share: float | None):
    def fit(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        y = rows["y"].to_numpy(dtype=int) if len(rows) else np.zeros(0, int)
        base = 0.5 if share is None else share
        if (y == 1).sum() < 2 or (y == 0).sum() < 2:
            return {"good": None, "bad": None, "slope": 0.0, "prior": float(base)}
        texts = np.array(rows["text"].tolist(), dtype=object)
        # Texts are compared under dictionaries that have not seen them, fold by fold.
        fold = rows.groupby("y").cumcount().to_numpy() % FITS
        made = lambda use: [_dictionary(texts[use & (y == c)].tolist()) for c in (1, 0)]
        found = np.zeros((len(texts), 2))
        for k in np.unique(fold):
            c = Compressors(*made(fold != k))
            found[fold == k] = [c.difference(t) for t in texts[fold == k]]
        some = found[found[:, 1] > 0]
        usual = float(np.median(some[:, 0] / some[:, 1])) if len(some) else 0.0
        x = _ratio(found, usual)
        scale = float(np.median(np.abs(x))) or 1.0
        slope, cut = logistic(_squash(x, scale), y)
        # The sample holds other shares of the classes than the labels do.
        if share is not None and 0 < share < 1:
            seen = y.mean()
            cut += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
        good, bad = made(np.ones(len(y), bool))
        return {"good": good, "bad": bad, "usual": usual, "scale": scale, "slope": slope,
                "cut": float(cut)}
    return fit


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Dictionaries and curve, from at most ``per_class`` learnable texts of each class."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & ~held_out())
    share = usable.agg(F.avg("y")).first()[0]
    return fit_in_task(labelled_sample(docs, labels, label, per_class), _fit(share))


def _scorer(model: dict):
    if model["good"] is None:
        return lambda s: pd.DataFrame({"score": np.full(len(s), model["prior"]),
                                       "difference": np.zeros(len(s))})
    c = Compressors(model["good"], model["bad"])

    def score(s: pd.Series) -> pd.DataFrame:
        x = _ratio([c.difference(t) for t in s], model["usual"])
        z = np.clip(model["slope"] * _squash(x, model["scale"]) + model["cut"], -30, 30)
        return pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "difference": x})
    return score


def score(docs: DataFrame, model: dict, text: str = "text", as_name: str = "quality") -> DataFrame:
    """``docs`` with a struct (score, difference) under ``as_name``, or a longer free name."""
    return scored(docs, model, _scorer, "score double, difference double",
                  fresh(as_name, docs.columns), text)
