"""Words and their hashes for near-duplicate work: lower-cased runs of anything but white space."""

from __future__ import annotations

import numpy as np
import xxhash

from tesserae.llm.common import CACHES

#: 64-bit hashes of words met before, per worker process; emptied when it holds so many.
_WORDS: dict[str, int] = {}
_MOST = 300_000
CACHES["words"] = _WORDS.clear


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hash of every word; null has none."""
    words = (text or "").lower().split()
    if len(_WORDS) > _MOST:
        _WORDS.clear()
    own = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        own.append(h)
    return np.array(own, np.uint64)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
    return out


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1, or further, of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


#: A random 64-bit number for every byte.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def word_codes(text: str | None) -> np.ndarray:
    """Like `word_hashes`, other hashes: all words of a text at once from running sums over its bytes, without a table of words."""
    words = (text or "").lower().split()
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(words), 4096):
        raw = np.frombuffer(" ".join(words[lo : lo + 4096]).encode("utf-8", "surrogatepass"), np.uint8)
        powers, inverse = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers[: len(raw)], out=total[1:])
        ends = np.append(np.flatnonzero(raw == 32), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        h = (total[ends] - total[starts]) * inverse[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
    return np.concatenate(out)


def long_run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k word hashes, for a large k: differences of one running sum of powers, whatever k is."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=total[1:])
    out = (total[k:] - total[:-k]) * inverse[: len(h) - k + 1]
    return out ^ (out >> np.uint64(29))
