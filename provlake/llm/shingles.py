"""Sets of hashed word shingles, computed with whole-array operations."""

from __future__ import annotations

import numpy as np

#: Characters of text that are hashed together.
PART = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(1234).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PART + 1)
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        for name, f in (("up", _FACTOR), ("down", inverse)):
            steps = np.full(size, f, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of ``data``, A to Z taken as a to z."""
    raw = np.frombuffer(data, np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    visible = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(visible.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[:len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start, word = _words(b"\n".join(texts) + b"\n")
    begin = np.cumsum(size) - size
    first = np.searchsorted(start, begin)
    count = np.append(first[1:], len(start)) - first
    spans = max(0, len(word) - width + 1)
    rolled = np.zeros(spans, np.uint64)
    for i in range(width):
        rolled = rolled * _FACTOR + word[i:i + spans]
    rolled = mix(rolled)
    out = []
    for at, n in zip(first, count, strict=True):
        if n >= width:
            out.append(np.unique(rolled[at:at + n - width + 1]))
        elif n:
            h = np.uint64(n)
            for w in word[at:at + n]:
                h = h * _FACTOR + w
            out.append(mix(np.array([h ^ np.uint64(0x5BD1E995)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: ``width`` words each, the whole sequence
    where there are fewer, nothing without words."""
    out: list[np.ndarray] = []
    part, size = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            part.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(part[-1]) + 1
            if size >= PART:
                out += _sets(part, width)
                part, size = [], 0
        return out + (_sets(part, width) if part else [])
