"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words (runs of characters other than white space), each weighted by
its count. For every sample and word, gamma-distributed r and c and a uniform beta come from a hash
of the word; the word with the smallest a = c / (y e^r), y = e^(r (t - beta)), t = floor(ln w / r +
beta) is drawn, together with t. Two texts draw the same with probability equal to the generalised
Jaccard similarity of their weights, so the share of equal samples estimates it.

A fingerprint is SAMPLES 16-bit hashes of draws in hex, never 0000. Null and empty texts (and texts
of white space only) draw nothing: their fingerprint is all zeros, their likeness to each other 1
and to any other text 0. Equal texts have equal fingerprints, whatever the row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import lean

SAMPLES = 128
#: Words and (word, count) pairs remembered by a task before it forgets all and starts anew.
REMEMBERED = 200_000
#: Words whose samples are worked out at once: arrays that stay in a core's cache.
BLOCK = 96
#: Rows that are sampled at once, and their characters (a longer text is sampled by itself).
ROWS, CHARS = 64, 1_000_000
#: Buckets that documents are dealt to in the order of their ids, at most.
BUCKETS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = x >> np.uint64(30)
    h ^= x
    h *= np.uint64(0xBF58476D1CE4E5B9)
    part = h >> np.uint64(27)
    h ^= part
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=part)
    h ^= part
    return h


def _uniform(bits: np.ndarray, at: int) -> np.ndarray:
    """21 of the bits, from ``at`` on, to a number inside (0, 1)."""
    part = (bits >> np.uint64(at) if at else bits).astype(np.int32)
    part &= np.int32(0x1FFFFF)
    x = part.astype(np.float32)
    x += np.float32(0.5)
    x *= np.float32(2.0 ** -21)
    return x


def _base(word_hash: np.ndarray, sample: np.ndarray) -> np.ndarray:
    return word_hash + np.uint64(0x9E3779B97F4A7C15) * (sample + np.uint64(1))


def _r_beta(one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return -np.log(_uniform(one, 0) * _uniform(one, 21)), _uniform(one, 42)


def _t(weight: np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.floor(np.log(weight).astype(np.float32) / r + beta)


def samples(word_hash: np.ndarray, weight: np.ndarray | None, n: int = SAMPLES) -> np.ndarray:
    """ln a for each word and sample; no weights: all are 1, for which t is 0."""
    base = _base(word_hash[:, None], np.arange(n, dtype=np.uint64)[None, :])
    r, beta = _r_beta(_mix(base))
    two = _mix(base ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    c = -np.log(_uniform(two, 0) * _uniform(two, 21))
    if weight is None:
        return np.log(c) + r * beta - r
    return np.log(c) - r * (_t(weight[:, None], r, beta) - beta) - r


def drawn(word_hash: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """16-bit hashes of draws (word, t), never 0; a column is a sample."""
    t = np.zeros(weight.shape, np.int16)
    at = np.nonzero(weight > 1)
    r, beta = _r_beta(_mix(_base(word_hash[at], at[1].astype(np.uint64))))
    t[at] = _t(weight[at].astype(float), r, beta).astype(np.int16)
    h = _mix(word_hash ^ _mix(t.astype(np.int64).astype(np.uint64) + np.uint64(1)))
    return np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def _hashes(words: list[str]) -> np.ndarray:
    try:
        data = [*map(str.encode, words)]
    except UnicodeEncodeError:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
    crc, size = (np.fromiter(map(f, data), np.uint64, len(data)) for f in (zlib.crc32, len))
    return crc | size << np.uint64(32)


def _numbers() -> defaultdict:
    """Key -> its number; a new key gets the next one."""
    return defaultdict(count().__next__)


class Sampler:
    """Fingerprints of texts; remembers ln a of words that came once in a text, by the word, and
    of (word, count) pairs."""

    def __init__(self, n: int = SAMPLES):
        self.n = n
        # Memory is only taken by rows that are filled.
        self.hash = np.empty(REMEMBERED, np.uint64)
        self.once, self.often = (np.empty((REMEMBERED, n), np.float32) for _ in range(2))
        self.now = np.empty((1024, n), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.words, self.pairs = _numbers(), _numbers()
        self.filled = np.zeros(len(self.hash), bool)
        self.heard = self.counted = 0

    def _room(self, name: str, size: int) -> np.ndarray:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros((max(size, len(old) + len(old) // 4), *old.shape[1:]), old.dtype)
            new[:len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _fill(self, table: np.ndarray, rows: np.ndarray, word: np.ndarray,
              weight: np.ndarray | None) -> None:
        for i in range(0, len(rows), BLOCK):
            part = slice(i, i + BLOCK)
            table[rows[part]] = samples(self.hash[word[part]],
                                        None if weight is None else weight[part], self.n)

    def _learn(self, word: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Rows, in ``once`` for words that come once and else in ``often``."""
        new = len(self.words) - self.heard
        if new:
            for name in ("hash", "filled", "once"):
                self._room(name, len(self.words))
            late = [*islice(reversed(self.words), new)]
            self.hash[self.heard:len(self.words)] = _hashes(late)[::-1]
            self.heard = len(self.words)
        alone = word[times == 1]
        alone = np.unique(alone[~self.filled[alone]])
        self._fill(self.once, alone, alone, None)
        self.filled[alone] = True
        many = times > 1
        key = word[many] << 32 | times[many]
        row = word.copy()
        row[many] = np.fromiter(map(self.pairs.__getitem__, key.tolist()), np.int64, len(key))
        if len(self.pairs) > self.counted:
            self._room("often", len(self.pairs))
            _, first = np.unique(row[many], return_index=True)
            first = first[row[many][first] >= self.counted]
            self._fill(self.often, row[many][first], word[many][first], times[many][first].astype(float))
            self.counted = len(self.pairs)
        return row

    def _least(self, row: np.ndarray, many: np.ndarray, word: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Place of the smallest ln a of each sample; of equal ones that of the word that comes first."""
        alone, rest = np.flatnonzero(~many), np.flatnonzero(many)
        ln_a = self._room("now", len(row))[:len(row)]
        np.take(self.once, row[alone], axis=0, out=ln_a[:len(alone)], mode="clip")
        np.take(self.often, row[rest], axis=0, out=ln_a[len(alone):], mode="clip")
        # Few cells are smallest: whole bytes of none are passed over at once.
        bits = np.packbits(ln_a == ln_a.min(0))
        some = np.flatnonzero(bits)
        at, bit = np.nonzero(np.unpackbits(bits[some, None], axis=1))
        place, sample = np.divmod(some[at] * 8 + bit, self.n)
        place = np.concatenate([alone, rest])[place]
        best = np.empty(self.n, np.int64)
        if len(place) > self.n:
            order = np.argsort([-(ids == word[p]).argmax() for p in place], kind="stable")
            place, sample = place[order], sample[order]
        best[sample] = place
        return best

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; they hold until ``make_room`` forgets."""
        split = [t.split() for t in texts]
        ends = np.cumsum([len(w) for w in split])
        ids = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, ends[-1])
        return np.split(ids, ends[:-1])

    def joined(self, a: str, of_a: np.ndarray, b: str, of_b: np.ndarray) -> np.ndarray:
        """``ids`` of a + b, where a begins a text of the words ``of_a``, and b one of ``of_b``:
        only the words at the cuts can be others than theirs."""
        left, right = a.split(), b.split()
        middle = left[-1:] + right[:1]
        if len(middle) == 2 and not a[-1].isspace() and not b[0].isspace():
            middle = ["".join(middle)]
        cut = [self.words[w] for w in middle + right[1:][-1:]]
        return np.concatenate([of_a[:max(len(left) - 1, 0)], np.array(cut[:len(middle)], np.int64),
                               of_b[1:max(len(right) - 1, 1)], np.array(cut[len(middle):], np.int64)])

    def make_room(self) -> None:
        if len(self.words) + len(self.pairs) > REMEMBERED:
            self._forget()

    def of_ids(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row of samples for each text, given by its words' numbers."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        key = np.sort(np.repeat(np.arange(len(texts)) << 32, size) | np.concatenate(texts))
        start = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(start, append=len(key))
        word = key[start] & 0xFFFFFFFF
        row, more = self._learn(word, times), times > 1
        to = np.searchsorted(key[start] >> 32, np.arange(len(texts) + 1))
        full = np.flatnonzero(size)
        best = np.empty((len(full), self.n), np.int64)
        for i, k in enumerate(full):
            at = slice(to[k], to[k + 1])
            best[i] = to[k] + self._least(row[at], more[at], word[at], texts[k])
        out = np.zeros((len(texts), self.n), np.uint16)
        out[full] = drawn(self.hash[word[best]], times[best])
        return out

    def __call__(self, text: str) -> np.ndarray:
        self.make_room()
        return self.of_ids(self.ids([text]))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, of one pair or row by row."""
    return (a == b).mean(-1)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _bucket, _guest, _at): partitions hold buckets of neighbouring ids in order,
    each followed by a guest, the first row of the next bucket (after the last, of the first).

    Bucket bounds are quantiles of the ids and one first id per bucket goes to the driver: as many
    numbers as buckets, at most BUCKETS. Texts are shuffled once. Null ids come first; rows with
    equal ids stand in the order of their texts.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_at"))
    n = min(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("_at")
    bounds = sorted({int(q) for q in ids.approxQuantile("_at", [i / n for i in range(1, n)], 0.1 / n)})
    bucket = F.lit(0) if not bounds else F.size(F.filter(
        F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("_at")))
    first = sorted((r[0], r[1]) for r in
                   ids.groupBy(bucket.alias("b")).agg(F.min("_at")).collect())
    guests = spark.createDataFrame(
        [(at, first[i - 1][0]) for i, (_, at) in enumerate(first)], "_at long, _before int")
    dealt = rows.withColumn("_own", bucket).join(F.broadcast(guests), "_at", "left")
    home = F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("guest"))
    to = F.when(F.col("_before").isNull(), F.array(home)).otherwise(F.array(home, there))
    return (dealt.withColumn("_to", F.explode(to))
            .select("doc_id", "text", "_at", F.col("_to.bucket").alias("_bucket"),
                    F.col("_to.guest").alias("_guest"))
            .repartition("_bucket").sortWithinPartitions("_bucket", "_guest", "_at", "text"))


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each row waits for the one after it, which gives the edited text's second half; nothing but
    a batch, the row before it and the remembered words is held.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()),
                        ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64())])

    def parts(b: pa.RecordBatch) -> Iterator[list[tuple]]:
        part, chars = [], 0
        for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if part and (len(part) == ROWS or chars + len(row[1]) > CHARS):
                yield part
                part, chars = [], 0
            part.append(row)
            chars += len(row[1])
        if part:
            yield part

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, last = Sampler(n), []
        for part in (p for b in batches for p in parts(b)):
            rows = last + part
            last = rows[-1:]
            sample.make_room()
            ids = sample.ids([r[1] for r in rows])
            # A guest ends its bucket: it is the next document of the row before it, no more.
            first = [i for i, (a, b) in enumerate(pairwise(rows)) if a[2] == b[2] and not a[3]]
            if not first:
                continue
            edited, cut = [], []
            for i in first:
                text, after = rows[i][1], rows[i + 1][1]
                half = len(text) // 2
                head, tail = text[:len(text) - half], after[:half]
                edited.append(head + tail)
                cut.append(sample.joined(head, ids[i], tail, ids[i + 1]))
            made = sample.of_ids(ids + cut)
            at = np.array(first)
            own, e, after = made[at], made[len(rows):], made[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                [rows[i][0] for i in first], [len(rows[i][1]) for i in first],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                list(map(written, own)), list(map(written, e)), likeness(own, e), likeness(own, after)),
                schema, strict=True)], schema=schema)

    return in_order(docs).select("doc_id", "text", "_bucket", "_guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
