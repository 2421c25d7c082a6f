"""Distinct word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""
from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SEED = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, A-Z taken as a-z: the sum of a scrambled number for each byte at its
    place. As it is no polynomial of the bytes, texts built from a few letters by some rule don't agree more often than others."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BLANK[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    sizes = end - first
    at = np.flatnonzero(inside[1:-1])
    places = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    worth = mixed((places.astype(np.uint64) << np.uint64(8)) + _LOWER[data[at]].astype(np.uint64) + np.uint64(_SEED))
    return mixed(np.add.reduceat(worth, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)), first


def shingles(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text in ascending order. With fewer words than `size` the whole sequence is one; without words none."""
    held = [t or b"" for t in texts]
    words, first = word_hashes(np.frombuffer(b"\n".join(held) + b"\n", np.uint8))
    ends = np.cumsum(np.array([len(t) + 1 for t in held]))
    cuts = np.searchsorted(first, ends).tolist()
    odd = [np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(size)]
    salted = [mixed(words + o) for o in odd]
    runs = len(words) - size + 1
    windows = mixed(sum((salted[k][k : k + runs] * odd[k] for k in range(1, size)), salted[0][:runs].copy())) if runs > 0 else words[:0]
    out, at = [], 0
    for to in cuts:
        n = to - at
        if n >= size:
            out.append(np.unique(windows[at : to - size + 1]))
        elif n:
            whole = n
            for k in range(n):
                whole = (whole * int(odd[-1]) + int(salted[k][at + k])) & (1 << 64) - 1
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(words[:0])
        at = to
    return out
