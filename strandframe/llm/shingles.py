"""Words and sets of word shingles of texts, as numpy arrays of hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import held

#: Distinct words whose hashes a worker keeps; beyond, it starts afresh.
KEPT_WORDS = 150_000
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held("shingles", _Hashes).__getitem__, found), np.uint64, len(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MULTIPLY[0]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct hashes of a text's n-word shingles; of all its words if they are fewer; of no words none."""
    h = word_hashes(words(text))
    if not len(h):
        return h
    many = max(len(h) - n + 1, 1)
    with np.errstate(over="ignore"):
        out = np.full(many, min(len(h), n), np.uint64)
        for k in range(min(len(h), n)):
            out = _mixed(out * MULTIPLY[1] + h[k : k + many])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
