"""Texts as arrays of code points, and hashes of their q-grams."""

from __future__ import annotations

import numpy as np

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def folded(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each of the len(a) - q + 1 windows of q symbols."""
    if len(a) < q:
        return np.zeros(0, np.uint64)
    power = a.astype(np.uint64) * np.uint64(_BASE)
    power ^= power >> np.uint64(29)
    factor, width, out, have = _BASE, 1, None, 0
    while True:
        if q & 1:
            if out is None:
                out, have = power, width
            else:
                n = len(power) - have
                out = out[:n] * np.uint64(factor) + power[have : have + n]
                have += width
        q >>= 1
        if not q:
            break
        n = len(power) - width
        power = power[:n] * np.uint64(factor) + power[width : width + n]
        factor = factor * factor & _MASK
        width *= 2
    return out


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash's best bits as an index below 2**bits."""
    return ((h ^ (h >> np.uint64(31))) * np.uint64(_MIX)) >> np.uint64(64 - bits)


def slices(a: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches a[at[i] : at[i] + size[i]], end to end; none is empty."""
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(step):
        step[0] = at[0]
        step[ends[:-1]] = at[1:] - at[:-1] - size[:-1] + 1
    return a[np.cumsum(step)]
