"""Rolling hashes and winnowing, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers for polynomial hashes modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no trace of order or low entropy (public SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_hashes(symbols: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which the hash of any window comes in constant time; one longer than ``symbols``."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(0x9E37)) * powers(BASES[which], len(symbols)), out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, k: int, at: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hashes of the windows of ``k`` symbols at all positions or those in ``at``."""
    n = len(prefix) - k
    inverse = powers(INVERSES[which], max(n, 1))
    if at is None:
        return mix((prefix[k:] - prefix[:n]) * inverse[:n])
    return mix((prefix[at + k] - prefix[at]) * inverse[at])


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """The extreme of every window of ``w`` values, by doubling."""
    p = 1
    while 2 * p <= w:
        x = pick(x[:-p], x[p:])
        p *= 2
    return pick(x[: len(x) - (w - p)], x[w - p :]) if w > p else x


def winnow(hashes: np.ndarray, w: int, inside: np.ndarray | None = None) -> np.ndarray:
    """Positions whose hash is the least of some window of ``w`` consecutive hashes.

    Two sequences that share ``w`` consecutive hashes share a chosen one, whatever stands around them. Fewer than ``w``
    hashes give no position. ``inside`` tells for each window whether it counts, so that several sequences can be
    winnowed at once without windows across their borders.
    """
    if len(hashes) < w:
        return np.empty(0, np.int64)
    least = _sliding(hashes, w, np.minimum)
    if inside is not None:
        least = np.where(inside, least, np.uint64(0))
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, w, np.maximum) == hashes)
