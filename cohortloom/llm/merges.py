"""Byte-pair merges of many short runs of ids at once."""

from __future__ import annotations

import heapq

import numpy as np

from .idcache import ranges


class Merger:
    """Merges by rank: ``pairs`` are the pairs of ids that merge, in order of rank, and
    ``made`` what each of them becomes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}
        self.made_list, self.made = made, np.array(made, np.int64)
        # Ranks by hashed pairs, in tables of which the second holds what finds its place
        # in the first taken, and so on.
        self.shift, left, self.tables = np.uint64(64 - 18), self.rank, []
        numbers = np.random.default_rng(3)
        while left:
            factor = np.uint64(int(numbers.integers(1 << 62)) | 1)
            keys, ranks = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int32)
            every = np.array(list(left), np.int64)
            at = every.view(np.uint64) * factor >> self.shift
            keys[at], ranks[at] = every, list(left.values())
            self.tables.append((factor, keys, ranks))
            left = {k: left[k] for k in every[keys[at] != every].tolist()}

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one run: always the pair of lowest rank, leftmost first."""
        n, found = len(ids), lambda a, b: self.rank.get(a << 32 | b)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := found(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if j >= n or ids[i] < 0 or found(ids[i], ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j], right[i] = self.made_list[r], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := found(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [i for i in ids if i >= 0]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or the number of merges where it has none."""
        key = a.astype(np.int64) << 32 | b
        out = np.full(key.shape, len(self.made), np.int32)
        for factor, keys, ranks in self.tables:
            at = key.view(np.uint64) * factor >> self.shift
            found = keys[at] == key
            out = np.where(found, ranks[at], out)
        return out

    def _merged(self, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges runs of at most ``most`` ids, all of them at once: in each step every run
        has its pair of lowest rank merged. Returns which run has been finished when, its
        number of ids, and the ids."""
        rows, cols = np.arange(len(starts)), np.arange(most)
        inside = cols < sizes[:, None]
        ids = np.where(inside, first[np.minimum(starts[:, None] + cols, len(first) - 1)], -1).astype(np.int64)
        none = len(self.made)
        rank = np.where(inside[:, 1:], self._rank_of(ids[:, :-1], ids[:, 1:]), none)
        done, counts, flat = [], [], []
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, at]
            live = best < none
            if not live.all():
                over = ids[~live]
                done.append(rows[~live])
                counts.append((over >= 0).sum(1))
                flat.append(over[over >= 0])
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                line = line[: len(rows)]
            if not len(rows):
                break
            ids[line, at] = self.made[best]
            after = cols[:-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            after = cols[:-2] >= at[:, None]
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = none
            for k, near in ((np.maximum(at - 1, 0), at > 0), (np.minimum(at, most - 2), at < most - 1)):
                x, y = ids[line, k], ids[line, k + 1]
                fresh = np.where(y >= 0, self._rank_of(x, np.maximum(y, 0)), none)
                rank[line, k] = np.where(near, fresh, rank[line, k])
        return np.concatenate(done), np.concatenate(counts), np.concatenate(flat)

    def merge_all(self, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the runs of ``first`` that begin at ``starts``. Returns how many ids each
        run has, and the ids, run by run."""
        sizes = np.diff(np.append(starts, len(first)))
        counts, order, found, at = np.zeros(len(starts), np.int64), [], [], 0
        for low, high in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
            here = np.nonzero((sizes > low) & (sizes <= high))[0]
            for k in range(0, len(here), 20_000):
                part = here[k : k + 20_000]
                done, n, ids = self._merged(first, starts[part], sizes[part], high)
                counts[part[done]] = n
                order.append(part[done])
                found.append(ids)
        for i in np.nonzero(sizes > 64)[0].tolist():
            ids = self.merge(first[starts[i] : starts[i] + sizes[i]].tolist())
            counts[i] = len(ids)
            order.append(np.array([i]))
            found.append(np.array(ids, np.int64))
        if not order:
            return counts, np.zeros(0, np.int32)
        order, ids = np.concatenate(order), np.concatenate(found).astype(np.int32)
        out = np.empty_like(ids)
        out[ranges((np.cumsum(counts) - counts)[order], counts[order])] = ids
        return counts, out


def merger_of(model: dict) -> Merger:
    """The merges of a BPE model in the tokenizers library's format."""
    vocab, split = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    return Merger([(vocab[a], vocab[b]) for a, b in split], [vocab[a + b] for a, b in split])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out
