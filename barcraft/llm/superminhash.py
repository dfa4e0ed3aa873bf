"""SuperMinHash signatures, vectorised over all elements of many sets.

Each element draws, from a generator seeded by its hash, a random permutation of the m
slots together with a random fraction per step; at step j it offers ``j + fraction`` to
slot ``permutation[j]`` and a slot keeps its least offer.  The permutation makes an
element's ranks distinct (correlated), which lowers the variance of the estimate.  Steps
run for all elements at once; a set leaves as soon as every slot holds a value below the
step (early stopping): later steps could not lower any slot.
"""

from __future__ import annotations

import numpy as np

from barcraft.llm.text import mix

_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 56) - 1)


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) uint64 slots: step in the top 8 bits, fraction below.  ``elements``
    are 64-bit hashes, ``owner`` the set of each, ascending.  m is at most 255.  An
    empty set keeps the greatest value in every slot."""
    if m > 255:
        raise ValueError("at most 255 slots")
    out = np.full((n_sets, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    live, who = elements, owner
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(live):
            break
        draw = mix(live + np.uint64((2 * j + 1) * _STEP % (1 << 64)))
        rank = (mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & _LOW) | np.uint64(j << 56)
        other = (j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot = other.copy()
        for t in range(j - 1, -1, -1):  # undo the earlier swaps: who stands at `other` now
            slot[slot == swaps[t]] = t
        np.minimum.at(flat, who * m + slot, rank)
        swaps.append(other)
        if j + 1 < m:
            # a set goes on while some slot holds nothing below step j + 1
            more = out.max(axis=1) >= np.uint64((j + 1) << 56)
            stay = more[who]
            if not stay.all():
                live, who = live[stay], who[stay]
                swaps = [s[stay] for s in swaps]
    return out
