"""Words and runs: the units all operators on near-copies count in.

Words are maximal stretches of letters, combining marks and digits, lower-cased. A run is five consecutive words.
Runs are compared by 64-bit hashes of their words' hashes; at 10^10 distinct runs the chance that two given ones clash is below 10^-9.
"""

from __future__ import annotations

import re

import numpy as np
import regex
import xxhash

RUN = 5
#: Lower-cases ASCII letters, keeps digits and makes all else a space.
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Characters outside these ranges may be combining marks or numbers that are no digits; texts with them take the exact pattern.
_RARE = re.compile("[^\x00-\u02af\u0400-\u0482\u048a-\u052f\u2010-\u2027\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff\uff01\uff0c\uff1a\uff1b\uff1f]")
_COMMON = re.compile(r"[^\W_\xb2\xb3\xb9\xbc-\xbe]+")
_EXACT = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_CACHED_WORDS = 1_000_000
_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(RUN)], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word, kept for the next time it comes."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for NULL."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    low = text.lower()
    return (_EXACT if _RARE.search(low) else _COMMON).findall(low)


def hashed(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """The same values with all bits depending on all bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def runs_of(h: np.ndarray) -> np.ndarray:
    """The hash of every run of the hashed words ``h``, in order, with repeats; none for under five words."""
    n = len(h) - RUN + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = h[:n] * _FACTORS[0]
    for i in range(1, RUN):
        total += h[i : i + n] * _FACTORS[i]
    return mixed(total)


def run_set(text: str | None) -> np.ndarray:
    """The distinct runs of ``text``, ascending."""
    return np.unique(runs_of(hashed(words(text))))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())
