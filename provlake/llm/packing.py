"""Packing by power-of-two decomposition.

Each document's tokens (with an end token) are cut into pieces of 2048 and, for the rest, the
binary digits of its length, largest first. Pieces of equal length form a bucket; every piece is a
sequence of its own, so no sequence crosses documents and none needs padding.

A null text is empty, and an empty text is one piece that holds the end token. Repeated rows are
documents of their own. Only the columns named are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import WordIndex, gapless, lean, release
from provlake.session import cut_lineage

LONGEST = 2048
END_ID = 1
#: Words remembered by a task, and their characters, before it forgets all and starts anew. More
#: would take more memory in every worker and, as they leave a core's cache, more time.
REMEMBERED = 100_000
REMEMBERED_CHARS = 16_000_000
#: White space before and after a space (or a space that ends the text after white space): there
#: the tokenizer's own split may not fall on the space, so such a text is encoded as a whole.
_UNSAFE = re.compile(r"\s (?:\s|\Z)|\x85 | \x85")


#: Fixed value: how byte-level tokenizers split text before they merge.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is
    visible Latin-1, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _fast(path: str):
    """tiktoken over the file's own vocabulary, or None where its merges do not follow its ids.

    It gives the ids that ``tokenizers`` gives, in a tenth of the time for single words.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special = {t["content"] for t in whole["added_tokens"]}
    byte = _letters()
    ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in special}
    return tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), special


class WordCache:
    """Token ids of texts, encoding each distinct word once.

    The tokenizer splits text before it merges, and a space before a visible character always
    begins a part of its own. So a text is cut at such spaces and the parts' ids are joined.
    Texts with a special token, or with spaces where a cut would not be safe, are encoded as they
    are by the tokenizer itself, which is loaded once one comes.
    """

    def __init__(self, path: str):
        self.path = path
        self.fast, self.special = _fast(path) or (None, ())
        # What was read of the file is given back before texts come.
        release()
        self._forget()

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.words = {"": WordIndex(), " ": WordIndex()}
        self.tokens = {k: (array("q", [0]), array("I")) for k in self.words}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, lead: str) -> tuple[np.ndarray, np.ndarray]:
        index, (ends, flat) = self.words[lead], self.tokens[lead]
        waiting = [lead + w for w in index.waiting]
        for ids in map(self.fast.encode_ordinary, waiting) if self.fast else self._encode(waiting):
            flat.extend(ids)
            ends.append(len(flat))
        index.waiting.clear()
        return np.frombuffer(ends, np.int64), np.frombuffer(flat, np.uint32)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        if sum(map(len, self.words.values())) > REMEMBERED or (
                sum(w.chars for w in self.words.values()) > REMEMBERED_CHARS):
            self._forget()
        first, later = self.words[""], self.words[" "]
        rows: list = []
        for t in texts:
            if _UNSAFE.search(t) or any(x in t for x in self.special):
                rows.append(None)
            else:
                head, *rest = t.split(" ")
                rows.append((first[head], np.fromiter(map(later.__getitem__, rest), np.int64,
                                                      len(rest))))
        (e0, f0), (e1, f1) = self._learn(""), self._learn(" ")
        for t, r in zip(texts, rows, strict=True):
            if r is None:
                yield np.array(self._encode([t])[0], np.uint32)
                continue
            start = e1[r[1]]
            length = e1[r[1] + 1] - start
            step = np.repeat(start - np.cumsum(length) + length, length)
            yield np.concatenate([f0[e0[r[0]]:e0[r[0] + 1]],
                                  f1[step + np.arange(len(step))]])


def cuts(length: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces: whole pieces first, then the binary digits of the rest."""
    whole, rest = divmod(length, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): one row per piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([END_ID], np.uint32)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, made = [], [array("q") for _ in range(4)]
                for ids in cache.ids(texts):
                    data = np.concatenate([ids, end]).astype("<u4").tobytes()
                    n, start = len(ids) + 1, 0
                    lengths = cuts(n)
                    for k in lengths:
                        for a, v in zip(made, (start, k, zlib.crc32(data[4 * start:4 * (start + k)]),
                                               n), strict=True):
                            a.append(v)
                        start += k
                    counts.append(len(lengths))
                which = np.repeat(np.arange(part.num_rows), counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)),
                     *(pa.array(np.frombuffer(a, np.int64)) for a in made)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces with their sequence, numbered bucket by bucket; offsets are 0, as pieces stand alone."""
    made = cut_lineage(pieces(docs, tokenizer))
    return (gapless(made, ["length"], ["doc_id", "start", "ids_crc32"], "sequence_id", across=True)
            .withColumn("offset", F.lit(0).cast("long")))
