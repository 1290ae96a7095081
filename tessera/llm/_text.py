"""Byte-level word splitting and hashing shared by the text operators."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
#: ASCII white space: 0x20 and 0x09 to 0x0D, which is also what bytes.split() splits on.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of contract words (digits, a-z, all non-ASCII); A-Z lower-cased, the rest blanked.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 15)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the white-space separated words of ``data``, in order."""
    return stem_hashes(data, ())[0]


def stem_hashes(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the words in order; then for each length, of the leading bytes of the words that are longer.

    A hash depends on the word's bytes alone, so long texts are hashed in
    pieces cut at white space.
    """
    if len(data) <= _CHUNK:
        return _hashes(data, lengths)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        parts.append(_hashes(data[at:end], lengths))
        at = end
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _hashes(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~SPACE[a]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.empty(0, np.uint64)] * (1 + len(lengths))
    up, down = _upto(len(a) + 1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[a] * up[: len(a)], out=total[1:])
    out = [mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))]
    for k in lengths:
        at = start[end - start > k]
        out.append(mix((total[at + k] - total[at]) * down[at] + np.uint64(k << 32)))
    return out


_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mix(np.sum(words * _long(n)[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - width + 1, np.uint64)
    for k, w in enumerate(_long(width)):
        total += words[k : n - width + 1 + k] * w
    return np.unique(mix(total))


def _long(n: int) -> np.ndarray:
    return _WEIGHTS[:n] if n <= len(_WEIGHTS) else np.resize(_WEIGHTS, n) * (2 * np.arange(n, dtype=np.uint64) + np.uint64(1))
