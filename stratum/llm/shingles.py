"""Hashes of words and word shingles, over whole texts, a chunk of bytes at a time.

A word is a maximal run of bytes other than ASCII white space; A-Z count as a-z.  Word hashes are 64-bit
polynomial hashes read off one running sum per chunk, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; different seeds give independent hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        step = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(step)
    return _powers[key][:n]


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, starts.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * _power(_BASE, len(raw)), out=sums[1:])
        return starts, mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts])


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and for each text the index at which its words end."""
    encoded = [(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts]
    limits = np.cumsum([len(e) + 1 for e in encoded])
    raw = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    at, starts, hashes = 0, [], []
    while at < len(raw):
        end = min(len(raw), at + CHUNK_BYTES)
        while end < len(raw) and not _SPACE[raw[end - 1]]:  # a chunk ends after white space
            end += 1
        s, h = _hash_chunk(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), limits, "left")


def batches_of(texts: list[str | None], limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each."""
    out, first, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            out.append((first, k + 1))
            first, size = k + 1, 0
    if first < len(texts):
        out.append((first, len(texts)))
    return out


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n], j)
    return acc


def shingle_runs(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's shingle hashes in order, repeats included; a text of fewer words is one shingle as a whole."""
    words, ends = hash_words(texts)
    runs, out, first = fold(words, k), [], 0
    for end in ends.tolist():
        n = end - first
        if n >= k:
            out.append(runs[first : end - k + 1])
        elif n:
            out.append(mix(fold(words[first:end], n), 1000 + n))
        else:
            out.append(runs[:0])
        first = end
    return out
