"""Hashes of word shingles, whole texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One random 64-bit value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The set of a text's shingles as sorted distinct 64-bit hashes.

    A-Z become lower case, words are runs of other bytes than space and 0x09 to 0x0D. With
    fewer words the whole sequence is the one shingle; without words the set is empty. All
    shingles are slices of one byte string, so prefix sums of a polynomial hash give them.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b" ")
    joined = b" ".join([p for p in parts if p])
    if not joined:
        return np.empty(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    cuts = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], cuts + 1))
    ends = np.concatenate((cuts, [n]))
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * power(MULTIPLIER, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * power(INVERSE, n)[starts]
    return np.unique(mix(h + (ends - starts).astype(np.uint64)))


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())
