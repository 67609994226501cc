"""Numpy helpers on words of one text."""

from __future__ import annotations

import numpy as np

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Bytes hashed at once.
SLICE = 1 << 20
_BASE = 0x9E6C63D0876A9A47  # odd, so that it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2**64 for i < n or more; longer tables than for a slice are not kept."""
    if n > 2 * SLICE:
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64) for base in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))))
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            old = _powers[k]
            _powers[k] = np.concatenate([old, old * np.uint64(pow(base, len(old), 2**64))])
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, end byte) of each word of a text, without a Python object per word.

    The hash is a polynomial of the word's bytes, read off running sums, then mixed. Long texts go in slices
    that end between words, so that memory beyond the result is bounded by a slice or the longest word.
    """
    raw = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(raw):
        to = at + SLICE
        while to < len(raw) and not _BLANK[raw[to : to + SLICE]].any():
            to += SLICE
        if to < len(raw):
            to += int(_BLANK[raw[to : to + SLICE]].argmax())
        hashes, starts, ends = _slice_hashes(raw[at:to])
        parts.append((hashes, starts + at, ends + at))
        at = to
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _slice_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts, ends


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, by its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, width):
        out *= FACTOR
        out += words[j : j + n]
    return mixed(out)
