"""Vectorised hashing of words and word shingles: no Python object per word."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_chunk(data: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers_of(_BASE, len(data))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order; long texts go in pieces cut between words."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        return _hash_chunk(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + CHUNK, len(data))
        out.append(_hash_chunk(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: bytes | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle; without words: none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    if len(words) < width:
        h = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            h = mix(h * _STEPS[0] + words[k : k + 1])
        return h
    h = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        h = mix(h * _STEPS[k % 3]) + words[k : len(words) - width + 1 + k]
    return np.unique(mix(h))
