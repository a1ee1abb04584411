"""Hashed word shingles of whole texts, in numpy (runs on the executors' Python workers)."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_32, _29 = np.uint64(32), np.uint64(29)
#: Words that one worker remembers with their hash: the first it meets, so the frequent ones. About 20 MB.
REMEMBERED = 120_000


class _Words(dict):
    """64-bit hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) < REMEMBERED:
            self[word] = out
        return out


_words = _Words()


def mix(x: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    x = (x ^ (x >> _32)) * by
    x = (x ^ (x >> _29)) * _M3
    return x ^ (x >> _32)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of UTF-8 ``text``.

    A-Z lower-cased, words cut at space and \\t to \\r. Fewer than k words: the whole sequence is one shingle. No words or
    null: empty.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    w = min(k, n)
    acc = h[: n - w + 1] + np.uint64(w)
    for j in range(1, w):
        acc = mix(acc) + h[j : n - w + 1 + j]
    return np.unique(mix(acc))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over differently mixed tokens: equal for equal sets, whatever their order."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens, _M2).sum(dtype=np.uint64), mix(tokens + _M2, _M1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
