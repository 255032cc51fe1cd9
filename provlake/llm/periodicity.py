"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a longest stretch of words with smallest period q, at least ``least`` words long and
``exponent`` times q. Candidates are Lyndon roots: at every word the longest Lyndon word that
begins there, under the order of the words and under its reverse; each run has such a root. A
candidate is extended to both sides by longest common extensions: the word depth of the lowest
common ancestor of two leaves in a suffix tree (Ukkonen's construction) of the words, and of the
reversed words for extensions to the left. The trees' tours are kept as the leaves in order with
the depth at which the tour turned between neighbours; a range minimum over these, from a sparse
table, is the ancestor's depth in constant time.

Trees cover all words that can lie in a run. In a run every sequence of ``1 + least * (exponent -
2) / exponent`` words occurs twice, a period apart. So a document is first cut at the
places whose sequence occurs once between the cuts, until no such place is left; no run crosses one.
What is left, most often a few lines, gets its trees.

A null text has no words; it and an empty text have no run and collapse to an empty text. Whole
texts are read, whatever their length. Rows are independent of each other, so repeated rows give
repeated results; all other columns are kept, and a clashing name is made longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import WORD_PATTERN, fresh, lean

LEAST, EXPONENT = 24, 3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """The suffix tree of ``words`` (numbers from 1) and an end mark 0, built from left to right."""

    def __init__(self, words: list[int]):
        self.words = [*words, 0]
        self.base = max(words, default=0) + 1
        self._build()
        self._children()
        self.leaves, self.turns = self._tour(ends_first=False)

    def _build(self) -> None:
        s, base, far = self.words, self.base, len(self.words)
        begin, end, link, suffix, to = [0], [0], [0], [-1], {}
        node = edge = along = rest = 0
        for i, c in enumerate(s):
            rest += 1
            waits = 0
            while rest:
                if not along:
                    edge = i
                key = node * base + s[edge]
                below = to.get(key)
                if below is None:
                    to[key] = len(begin)
                    begin.append(i), end.append(far), link.append(0), suffix.append(i - rest + 1)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    b = begin[below]
                    size = end[below] - b
                    if along >= size and end[below] <= i:
                        node, edge, along = below, edge + size, along - size
                        continue
                    if s[b + along] == c:
                        along += 1
                        if waits:
                            link[waits] = node
                        break
                    middle = len(begin)
                    to[key] = middle
                    begin.append(b), end.append(b + along), link.append(0), suffix.append(-1)
                    begin[below] = b + along
                    to[middle * base + s[b + along]] = below
                    to[middle * base + c] = len(begin)
                    begin.append(i), end.append(far), link.append(0), suffix.append(i - rest + 1)
                    if waits:
                        link[waits] = middle
                    waits = middle
                rest -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - rest + 1
        self.begin, self.end, self.suffix, self.to = begin, end, suffix, to

    def _children(self) -> None:
        """Children of all nodes in one list, in the order of parents and first words."""
        keys = np.fromiter(self.to.keys(), np.int64, len(self.to))
        nodes = np.fromiter(self.to.values(), np.int64, len(self.to))
        order = np.argsort(keys)
        self.child = nodes[order].tolist()
        self.offset = np.searchsorted(keys[order] // self.base, np.arange(len(self.begin) + 1)).tolist()
        self.ended = (keys[order] % self.base == 0).tolist()
        del self.to

    def _tour(self, ends_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of a tour, and the depth of the turn before each.

        ``ends_first``: children in the reverse order of words, the end mark still first.
        """
        begin, end, suffix, child, offset = self.begin, self.end, self.suffix, self.child, self.offset
        leaves, turns, todo = [], [], [(0, 0, 0)]
        while todo:
            node, above, turn = todo.pop()
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                turns.append(turn)
                continue
            depth = above + end[node] - begin[node] if node else 0
            a, b = offset[node], offset[node + 1]
            below = child[a:b]
            if ends_first:
                head = 1 if b > a and self.ended[a] else 0
                below[head:] = below[:head - 1 if head else None:-1]
            todo += [(x, depth, depth) for x in below[:0:-1]]
            if below:
                todo.append((below[0], depth, turn))
        return np.array(leaves, np.int64), np.array(turns, np.int32)

    def ranks(self, backwards: bool = False) -> np.ndarray:
        """Each suffix's place in the order of words, or in the reverse order."""
        leaves = self._tour(ends_first=True)[0] if backwards else self.leaves
        out = np.empty(len(leaves), np.int64)
        out[leaves] = np.arange(len(leaves))
        return out

    def prepare(self) -> None:
        """The sparse table of minima over the turns."""
        self.rank = self.ranks()
        self.table = [self.turns]
        while 2 << len(self.table) - 1 <= len(self.turns):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, i <> j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] - (1 << int(k)) + 1])
        return out


def lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every word: up to the next smaller suffix."""
    r = rank.tolist()
    out, open_ = [0] * (len(r) - 1), [len(r) - 1]
    for i in range(len(r) - 2, -1, -1):
        while r[open_[-1]] > r[i]:
            open_.pop()
        out[i] = open_[-1] - i
        open_.append(i)
    return np.array(out, np.int64)


def tree_runs(words: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of word numbers."""
    n = len(words)
    numbers = np.unique(words, return_inverse=True)[1] + 1
    ahead, back = SuffixTree(numbers.tolist()), SuffixTree(numbers[::-1].tolist())
    ahead.prepare(), back.prepare()
    found = []
    for rank in (ahead.rank, ahead.ranks(backwards=True)):
        period = lyndon(rank)
        i = np.arange(n)
        j = i + period
        left, right = back.common(n - i, n - j), ahead.common(i, j)
        length = left + period + right
        keep = length >= np.maximum(least, exponent * period)
        found.append(np.stack([i - left, length, period], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def stretches(words: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches of words that can hold runs; no run leaves its stretch."""
    k = 1 + least * (exponent - 2) // exponent
    if len(words) < least:
        return
    rolled = np.zeros(len(words) - k + 1, np.uint64)
    w = words.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        rolled = (rolled ^ w[i:i + len(rolled)]) * _FACTOR
        rolled ^= rolled >> np.uint64(29)
    todo = [(0, len(rolled))]
    while todo:
        a, b = todo.pop()
        order = np.argsort(rolled[a:b], kind="stable")
        same = np.diff(rolled[a:b][order]) == 0
        again = np.zeros(b - a, bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        if again.all():
            yield a, b + k - 1
            continue
        edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
        todo += [(a + x, a + y) for x, y in edge.reshape(-1, 2).tolist() if y - x + k - 1 >= least]


def word_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Runs (start, length, period) of a document's word numbers, by start, then period."""
    parts = [tree_runs(words[a:b], least, exponent) + np.array([a, 0, 0])
             for a, b in stretches(words, least, exponent)]
    out = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """True for each of ``n`` words that no run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT,
         as_name: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``as_name``: ``runs`` by start and period, and ``collapsed``, the
    words joined by one space without those that only repeat the first period of a run."""
    if exponent < 2 or least < 2:
        raise ValueError("a run repeats its period once at least")
    words_of = re.compile(WORD_PATTERN).findall

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends, rows, collapsed = [0], [np.zeros((0, 3), np.int64)], []
            for t in texts:
                words = words_of(t.as_py() or "")
                index: dict[str, int] = {}
                numbers = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                found = word_runs(numbers, least, exponent)
                if len(found):
                    words = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
                rows.append(found)
                ends.append(ends[-1] + len(found))
                collapsed.append(" ".join(words))
            flat = np.concatenate(rows)
            spans = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(collapsed, pa.string())],
                ["runs", "collapsed"])

    @F.arrow_udf(_SHAPE)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return docs.withColumn(fresh(as_name, docs.columns), udf(F.col(text)))
