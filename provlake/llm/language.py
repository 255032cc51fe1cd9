"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled: affix, character n-gram and lexicon features give each word a
score per language, learned transitions tie neighbours together, and forward-backward over the
whole text gives each word's probabilities. A text's language is the one with the largest expected
number of words, and its score that number's share; the labels of single words show code-switching.

Training draws runs of words from a bounded sample of labelled documents and strings runs of
different languages together, so that switches occur and transitions can be learned.

A null text and one without a letter are ``und`` with score 0. Words are split at white space;
words without a letter carry no evidence and no vote. Words longer than 64 characters are looked
at in pieces of 64. Without labelled documents every text is ``und``. Repeated rows are labelled
alike.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provlake.llm.common import WordIndex, fit_in_task, fresh, held_out, scored

#: Documents per language to learn from, at most.
SAMPLE_PER_LANG = 500
#: Up to so many languages the numbers of chains and words below hold as they are. With more, chains
#: grow and the words that are worked on or remembered at once shrink; no language is left out.
LANGS = 64
#: Chains and words in each, as drawn for training; mean words before a switch.
CHAINS, CHAIN_WORDS, RUN_WORDS = 2500, 64, 24
#: Feature buckets, words of the lexicon, least occurrences of a lexicon word.
BUCKETS, LEXICON, LEAST = 1 << 16, 1 << 14, 4
STEPS, RATE, DECAY = 40, 0.08, 1e-6
LONGEST_WORD = 64
SEGMENT = 256
#: Words remembered by a task before it forgets all and starts anew.
REMEMBERED = 250_000
UNKNOWN = "und"


def cores(tokens: list[str]) -> list[str]:
    """The letters of each token, lower-cased."""
    return [t if t.isalpha() else "".join(c for c in t if c.isalpha())
            for t in (x.lower() for x in tokens)]


def words(text: str | None) -> list[str]:
    found = (text or "").split()
    if max(map(len, found), default=0) > LONGEST_WORD:
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def features(core: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, owners, word hashes) of words.

    Words are written with a mark at each end; features are all byte 2- and 3-grams, the 4-grams
    that touch a mark (affixes), and the whole word where the lexicon holds it.
    """
    data = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in core]
    size = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(core)), size)
    ids, owners = [], []
    code = raw.copy()
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(257) + raw[n - 1:]
        inside = owner[:len(code)] == owner[n - 1:]
        if n == 4:
            inside &= (raw[:len(code)] == 2) | (raw[n - 1:] == 3)
        ids.append((_mixed(code[inside] + np.uint64(n << 40)) >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:len(code)][inside])
    with np.errstate(over="ignore"):
        at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        part = _mixed((raw + np.uint64(1)) * _mixed(at.astype(np.uint64) + np.uint64(7)))
    start = np.cumsum(size) - size
    whole = np.add.reduceat(part, start) if len(core) else np.zeros(0, np.uint64)
    if len(lexicon):
        k = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        hit = lexicon[k] == whole
        ids.append(BUCKETS + k[hit])
        owners.append(np.flatnonzero(hit))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order], whole


def emissions(ids: np.ndarray, owners: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(owners, weights=weights[ids, k], minlength=n)
                     for k in range(weights.shape[1])], 1)


def _segments(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of the segments of consecutive chains, and each segment's chain."""
    count = -(-length // SEGMENT)
    of = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(length) - length, count) + nth * SEGMENT
    return start, np.minimum(SEGMENT, np.repeat(length, count) - nth * SEGMENT), of


def forward_backward(e: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probabilities of every word's labels, and the summed ones of neighbouring pairs.

    ``e`` holds exp(emission) of all chains one after another, ``t`` exp(transition). Chains are cut
    into segments; the matrix product over a segment carries the messages across it, so all
    segments of a batch advance together and the result is that of the whole chain.
    """
    k = e.shape[1]
    start, size, of = _segments(length)
    order = np.argsort(-size, kind="stable")
    start, size, of = start[order], size[order], of[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    several = np.bincount(of, minlength=len(length))[of] > 1
    # Messages that enter each segment: uniform at a chain's ends.
    into = np.full((len(start), k), 1.0 / k)
    back = np.full((len(start), k), 1.0 / k)
    if several.any():
        prod = np.broadcast_to(np.eye(k), (len(start), k, k)).copy()
        for s, n in enumerate(active):
            m = (prod[:n].reshape(n * k, k) @ t).reshape(n, k, k) * e[start[:n] + s][:, None, :]
            prod[:n] = m / m.sum((1, 2), keepdims=True)
        rows: dict[int, list[int]] = {}
        for i in np.flatnonzero(several)[np.argsort(start[several], kind="stable")]:
            rows.setdefault(int(of[i]), []).append(int(i))
        for parts in rows.values():
            for a, b in zip(parts, parts[1:], strict=False):
                v = into[a] @ prod[a]
                into[b] = v / v.sum()
            for a, b in zip(parts[::-1], parts[-2::-1], strict=False):
                v = prod[a] @ back[a]
                back[b] = v / v.sum()
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    f = into
    for s, n in enumerate(active):
        f = (f[:n] @ t) * e[start[:n] + s]
        f /= f.sum(1, keepdims=True)
        fwd[start[:n] + s] = f
    b = back.copy()
    for s in range(len(active) - 1, -1, -1):
        n = active[s]
        at = start[:n] + s
        bwd[at] = b[:n]
        v = (e[at] * b[:n]) @ t.T
        b[:n] = v / v.sum(1, keepdims=True)
    p = fwd * bwd
    p /= p.sum(1, keepdims=True)
    first = np.zeros(len(e), bool)
    first[(np.cumsum(length) - length)[length > 0]] = True
    to = np.flatnonzero(~first)
    x = e[to] * bwd[to]
    z = ((fwd[to - 1] @ t) * x).sum(1, keepdims=True)
    pairs = t * (fwd[to - 1].T @ (x / z))
    return p, pairs


def _chains(rows: pd.DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Tokens and labels of chains, as runs from random places of the sampled texts.

    There are CHAINS chains, and with more than LANGS languages as many for each as with LANGS.
    """
    rng = np.random.default_rng(11)
    chains = max(CHAINS, -(-CHAINS * len(langs) // LANGS))
    by = [[w for w in map(words, rows.loc[rows["lang"] == g, "text"]) if w] for g in langs]
    have = [k for k, d in enumerate(by) if d]
    tokens, labels = [], []
    for _ in range(chains if have else 0):
        left = CHAIN_WORDS
        while left:
            k = have[rng.integers(len(have))]
            doc = by[k][rng.integers(len(by[k]))]
            n = min(left, len(doc), int(rng.geometric(1 / RUN_WORDS)))
            at = rng.integers(len(doc) - n + 1)
            tokens += doc[at:at + n]
            labels += [k] * n
            left -= n
    return tokens, np.array(labels, np.int64)


def _share(words: int, langs: int) -> int:
    """``words``, or fewer with more than LANGS languages: memory goes with words times languages."""
    return words * LANGS // max(LANGS, langs)


def _fit(rows: pd.DataFrame) -> dict | None:
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    langs = sorted(set(rows["lang"]))
    if not langs:
        return None
    k = len(langs)
    tokens, label = _chains(rows, langs)
    names, word = np.unique(np.array(tokens, dtype=object).astype(str), return_inverse=True)
    core = cores(names.tolist())
    seen = np.bincount(word, minlength=len(names))
    hashes = features(core, np.zeros(0, np.uint64))[2]
    uniq, back = np.unique(hashes, return_inverse=True)
    often = np.bincount(back, weights=seen, minlength=len(uniq))
    top = np.argsort(-often, kind="stable")[:LEXICON]
    lexicon = np.sort(uniq[top][often[top] >= LEAST])
    ids, owners, _ = features(core, lexicon)
    letters = np.array([bool(c) for c in core])
    keep = letters[owners]
    ids, owners = ids[keep], owners[keep]
    length = np.full(len(label) // CHAIN_WORDS, CHAIN_WORDS)
    n = len(label)
    wt = np.zeros((BUCKETS + len(lexicon), k))
    tr = np.zeros((k, k))
    some = max(1, _share(CHAINS, k))  # chains that are worked on at once
    same = np.arange(n) % CHAIN_WORDS != 0
    to = np.flatnonzero(same)
    observed = np.zeros((k, k))
    np.add.at(observed, (label[to - 1], label[to]), 1)
    mom = [np.zeros_like(wt), np.zeros_like(tr)]
    var = [np.zeros_like(wt), np.zeros_like(tr)]
    for step in range(1, STEPS + 1):
        em = emissions(ids, owners, len(names), wt)
        em -= em.max(1, keepdims=True)
        em, g, pairs = np.exp(np.maximum(em, -60)), np.zeros((len(names), k)), np.zeros((k, k))
        for at in range(0, len(length), some):
            w = word[at * CHAIN_WORDS:(at + some) * CHAIN_WORDS]
            d, between = forward_backward(em[w], length[at:at + some], np.exp(tr))
            d[np.arange(len(w)), label[at * CHAIN_WORDS:(at + some) * CHAIN_WORDS]] -= 1
            g += np.stack([np.bincount(w, weights=d[:, j], minlength=len(names)) for j in range(k)], 1)
            pairs += between
        dw = np.stack([np.bincount(ids, weights=g[owners, j], minlength=len(wt))
                       for j in range(k)], 1) / n + DECAY * wt
        dt = (pairs - observed) / n
        for i, (par, grad) in enumerate(((wt, dw), (tr, dt))):
            mom[i] = 0.9 * mom[i] + 0.1 * grad
            var[i] = 0.99 * var[i] + 0.01 * grad ** 2
            par -= RATE * (mom[i] / (1 - 0.9 ** step)) / (np.sqrt(var[i] / (1 - 0.99 ** step)) + 1e-9)
    return {"langs": langs, "weights": wt.astype(np.float32), "transitions": tr, "lexicon": lexicon}


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict | None:
    """The field, from at most ``per_lang`` learnable documents of every language."""
    ok = docs.select("doc_id", "lang", "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
        & ~held_out())
    counts = ok.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    grain = 1 << 30
    hashed = ok.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    near = (hashed.join(F.broadcast(counts), "lang")
            .filter(F.pmod("h", F.lit(grain)) * F.col("n") < F.lit(2.0 * per_lang * grain))
            .distinct())
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = near.withColumn("r", first).filter(F.col("r") <= per_lang).select("doc_id", "lang")
    # Of several texts with one id the one of the smallest digest is learnt from.
    sample = (ok.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang")
              .agg(F.min_by("text", F.struct(F.sha2("text", 256), "text")).alias("text")))
    return fit_in_task(sample, _fit)


class Labeller:
    """Word probabilities of whole texts; remembers words."""

    def __init__(self, model: dict):
        self.model = model
        self.transitions = np.exp(model["transitions"])
        self._forget()

    def _forget(self) -> None:
        k = len(self.model["langs"])
        self.index = WordIndex()
        self.table = np.zeros((0, k))
        self.letters = np.zeros(0, bool)

    def _learn(self) -> None:
        if not self.index.waiting:
            return
        core = cores(self.index.waiting)
        ids, owners, _ = features(core, self.model["lexicon"])
        e = emissions(ids, owners, len(core), self.model["weights"])
        letters = np.array([bool(c) for c in core])
        e[~letters] = 0
        e = np.exp(np.maximum(e - e.max(1, keepdims=True), -60))
        self.table = np.concatenate([self.table, e])
        self.letters = np.concatenate([self.letters, letters])
        self.index.waiting.clear()

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, has letters) per word of all texts, and the texts' numbers of words."""
        if len(self.index) > _share(REMEMBERED, len(self.model["langs"])):
            self._forget()
        found = [words(t) for t in texts]
        length = [len(f) for f in found]
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64,
                           sum(length))
        self._learn()
        p, _ = forward_backward(self.table[rows], np.array(length, np.int64), self.transitions)
        return p, self.letters[rows], np.array(length, np.int64)


#: Words that are labelled together; a longer text is labelled by itself.
BATCH_WORDS = 100_000


def _batches(texts: list, langs: int):
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "") // 6 + 1
        if size >= _share(BATCH_WORDS, langs):
            yield now
            now, size = [], 0
    if now:
        yield now


def _scorer(model: dict | None):
    if model is None:
        return lambda s: pd.DataFrame({"lang": [UNKNOWN] * len(s), "score": np.zeros(len(s))})
    label = Labeller(model)
    langs = np.array(model["langs"], dtype=object)

    def score(s: pd.Series) -> pd.DataFrame:
        best, share = [], []
        for part in _batches([t if isinstance(t, str) else None for t in s], len(langs)):
            p, letters, length = label(part)
            owner = np.repeat(np.arange(len(part)), length)[letters]
            total = np.stack([np.bincount(owner, weights=p[letters, k], minlength=len(part))
                              for k in range(len(langs))], 1)
            n = total.sum(1)
            top = total.argmax(1)
            best.append(np.where(n > 0, langs[top], UNKNOWN))
            share.append(np.where(n > 0, np.minimum(1.0, total[np.arange(len(part)), top]
                                                    / np.maximum(n, 1e-12)), 0.0))
        return pd.DataFrame({"lang": np.concatenate(best) if best else [],
                             "score": np.concatenate(share) if share else []})
    return score


def score(docs: DataFrame, model: dict | None, text: str = "text",
          as_name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score) under ``as_name``, or a longer free name."""
    return scored(docs, model, _scorer, "lang string, score double",
                  fresh(as_name, docs.columns), text)


def _runs(model: dict | None):
    if model is None:
        return lambda s: pd.DataFrame({"runs": [[] for _ in range(len(s))]})
    label = Labeller(model)

    def runs(s: pd.Series) -> pd.DataFrame:
        out = []
        for part in _batches([t if isinstance(t, str) else None for t in s], len(model["langs"])):
            p, _, length = label(part)
            best = p.argmax(1)
            at = 0
            for n in length:
                b = best[at:at + n]
                edge = np.flatnonzero(np.diff(b, prepend=-1)) if n else np.zeros(0, int)
                ends = np.append(edge[1:], n)
                out.append([{"first_word": int(i), "words": int(j - i), "lang": model["langs"][b[i]]}
                            for i, j in zip(edge, ends, strict=True)])
                at += n
        return pd.DataFrame({"runs": out})
    return runs


def switches(docs: DataFrame, model: dict | None, text: str = "text",
             as_name: str = "labelled") -> DataFrame:
    """``docs`` with a struct (runs): the runs of equally labelled words of each whole text."""
    return scored(docs, model, _runs,
                  "runs array<struct<first_word:bigint,words:bigint,lang:string>>",
                  fresh(as_name, docs.columns), text)
