"""Token ids of many short strings, by the strings' hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of all ranges [start, start + count), one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class IdCache:
    """Remembers the ids of strings, in a place that a string's 64-bit hash gives it.

    A string that finds its place taken drives the other out, so memory is fixed and
    nothing is ever cleared; strings of over ``WIDE`` ids are not kept.
    """

    WIDE, BITS = 8, 19

    def __init__(self):
        size = 1 << self.BITS
        self.hash = np.zeros(size, np.uint64)
        self.count = np.zeros(size, np.uint8)
        self.ids = np.zeros(size * self.WIDE, np.int32)

    def sequence(self, h: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings with these hashes, in order, and how many each of them has.

        ``encode`` gets places in ``h``, one for each unknown string, and returns how many
        ids each of these has, and the ids.
        """
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        new = np.nonzero((self.hash[slot] != h) | (h == 0))[0]
        counts = self.count[slot].astype(np.int64)
        if not len(new):
            return self.ids[ranges(slot * self.WIDE, counts)], counts
        own, first, of = np.unique(h[new], return_index=True, return_inverse=True)
        new_counts, new_ids = encode(new[first])
        new_starts = np.cumsum(new_counts) - new_counts
        counts[new] = new_counts[of]
        out = np.empty(counts.sum(), np.int32)
        starts = np.cumsum(counts) - counts
        old = np.ones(len(h), np.bool_)
        old[new] = False
        out[ranges(starts[old], counts[old])] = self.ids[ranges(slot[old] * self.WIDE, counts[old])]
        out[ranges(starts[new], counts[new])] = new_ids[ranges(new_starts[of], counts[new])]
        keep = np.nonzero(new_counts <= self.WIDE)[0]
        places = slot[new[first[keep]]]
        _, last = np.unique(places[::-1], return_index=True)  # of those that meet in a place, one
        keep, places = keep[len(keep) - 1 - last], places[len(keep) - 1 - last]
        self.hash[places], self.count[places] = own[keep], new_counts[keep]
        n = new_counts[keep]
        self.ids[ranges(places * self.WIDE, n)] = new_ids[ranges(new_starts[keep], n)]
        return out, counts
