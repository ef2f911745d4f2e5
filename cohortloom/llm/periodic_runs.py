"""Periodic runs of words, found in a grammar of the texts.

The words of a batch of texts become numbers, and the sequence is compressed by Re-Pair:
in rounds, the pairs of neighbours that occur more than once are replaced by new symbols,
a pair before all that overlap it and are rarer. What is left of a text, where no pair
occurs twice, is paired up as a balanced tree, so every text has one root. Copies within
a batch share their symbols.

A run that a text has lies in the smallest symbol that holds all of it and crosses the
border between that symbol's two halves. So each symbol, of however many places, is
looked at once: a period q is tried where the words at the border and those q further on
are equal, and equal stretches are followed word by word as far as the symbol reaches.
The runs of a symbol are then carried to all places of the derivation; of runs with the
same period those inside others are dropped, which leaves the maximal ones.

Null and empty texts have no words and no runs. Repeated rows get equal results. A text of
any length is one sequence in one task, worked on in n log n steps; periods are tried in
blocks. Ties cannot arise, as all runs are returned, by start and period. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idcache import ranges
from .words import PlainWords, slices

#: Candidate periods that are tried at once.
BLOCK = 1 << 19


class Grammar:
    """Symbols of two parts each. Symbol number k >= ``words`` has its parts in ``left`` and
    ``right`` at k - ``words``, stands in the sequence at ``at`` first, and has ``size`` words."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray):
        self.words = int(ids.max()) + 1 if len(ids) else 0
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._next = self.words
        self._size = [np.ones(self.words, np.int64)]
        ends = np.zeros(len(ids), np.bool_)
        used = np.diff(starts) > 0
        ends[starts[1:][used] - 1] = True
        self.roots = np.full(len(starts) - 1, -1, np.int64)
        symbols, places, ends = self._pairs(ids.astype(np.int64), np.arange(len(ids)), ends)
        self.roots[used] = self._balanced(symbols, places, ends)
        columns = [np.concatenate(c) for c in zip(*self._parts)] if self._parts else [np.zeros(0, np.int64)] * 3
        self.left, self.right, self.at = columns
        self.size = np.concatenate(self._size)

    def _new(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.concatenate(self._size) if len(self._size) > 1 else self._size[0]
        self._size = [size, size[left] + size[right]]
        self._parts.append((left, right, at))
        self._next += len(left)
        return np.arange(self._next - len(left), self._next)

    def _pairs(self, s: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounds of replacement, until no pair of neighbours in a text occurs twice."""
        live = ~end  # a pair that may occur twice starts here
        while True:
            here = np.nonzero(live)[0]
            if not len(here):
                return s, at, end
            key = s[here] << 32 | s[here + 1]
            order = np.argsort(key)
            ordered = key[order]
            first = np.ones(len(key), np.bool_)
            np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
            group = np.cumsum(first) - 1
            count = np.bincount(group)
            kind, often = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            kind[order], often[order] = group, count[group]
            twice = often > 1
            live[here[~twice]] = False
            here, kind, often = here[twice], kind[twice], often[twice]
            if not len(here):
                return s, at, end
            # Rarer pairs give way; of equally frequent ones a mixed number decides.
            weight = often << 24 | (kind * 0x9E3779B1 & 0xFFFFFF)
            beside = np.diff(here) == 1
            same = beside & (kind[1:] == kind[:-1])
            behind = np.append(False, beside & ~same & ((weight[:-1] > weight[1:]) | ((weight[:-1] == weight[1:]) & (kind[:-1] > kind[1:]))))
            before = np.append(beside & ~same & ((weight[1:] > weight[:-1]) | ((weight[1:] == weight[:-1]) & (kind[1:] > kind[:-1]))), False)
            # Of a pair of equal words that overlaps itself, every other place is taken.
            opens = np.append(True, ~same)
            number = np.arange(len(here))
            odd = (number - np.maximum.accumulate(np.where(opens, number, 0))) & 1
            chosen = ~behind & ~before & (odd == 0)
            where, kinds = here[chosen], kind[chosen]
            new_kind, lead, of = np.unique(kinds, return_index=True, return_inverse=True)
            a = where[lead]
            made = self._new(s[a], s[a + 1], at[a])
            s[where] = made[of]
            end[where] = end[where + 1]
            live[where] = True
            live[where[where > 0] - 1] = True
            keep = np.ones(len(s), np.bool_)
            keep[where + 1] = False
            s, at, end, live = s[keep], at[keep], end[keep], live[keep]
            live &= ~end

    def _balanced(self, s: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One symbol for each text: neighbours are paired until it is alone."""
        while not end.all():
            number = np.arange(len(s))
            start = np.append(True, end[:-1])
            odd = (number - np.maximum.accumulate(np.where(start, number, 0))) & 1
            where = np.nonzero((odd == 0) & ~end)[0]
            s[where] = self._new(s[where], s[where + 1], at[where])
            end[where] = end[where + 1]
            keep = np.ones(len(s), np.bool_)
            keep[where + 1] = False
            s, at, end = s[keep], at[keep], end[keep]
        return s


def _equal_ahead(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and from b on, going by ``step``, are equal, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    rows, wide = np.nonzero(most > 0)[0], 8
    while len(rows):
        wide = max(8, min(wide, (1 << 20) // len(rows)))
        cols = np.arange(wide)
        inside = cols < (most[rows] - out[rows])[:, None]
        p, q = (a[rows] + step * out[rows])[:, None], (b[rows] + step * out[rows])[:, None]
        cols = step * cols
        differ = ~inside | (x[np.where(inside, p + cols, 0)] != x[np.where(inside, q + cols, 0)])
        equal = np.where(differ.any(1), differ.argmax(1), wide)
        out[rows] += equal
        rows = rows[equal == wide]
        wide *= 2
    return out


def _crossing(x: np.ndarray, low: np.ndarray, border: np.ndarray, high: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """(stretch, start, stop, period) of the runs of x[low:high] that cross ``border``: of
    ``times`` periods and ``least`` words at the least. ``times`` is 4 or more."""
    found: list[tuple[np.ndarray, ...]] = []
    left, right = border - low, high - border
    for side in (0, 1):  # two periods lie on one side of the border
        most = np.minimum((left, right)[side] // 2, (high - low) // times)
        most[high - low < least] = 0
        total = np.cumsum(most)
        cut = 0
        while cut < len(most):
            base = total[cut - 1] if cut else 0
            stop = max(cut + 1, int(np.searchsorted(total, base + BLOCK, "right")))
            n = most[cut:stop]
            cut, first = stop, cut
            node = np.repeat(np.arange(first, stop), n)
            q = ranges(np.ones(len(n), np.int64), n)
            b = border[node]
            ok = x[b - 1] == (x[b - 1 - q] if side == 0 else x[b - 1 + q])
            node, q, b = node[ok], q[ok], b[ok]
            ok = x[b] == (x[b - q] if side == 0 else x[b + q])
            node, q, b = node[ok], q[ok], b[ok]
            few = np.minimum(q, 16)
            ok = _equal_ahead(x, b - 1, b - 1 - q, few, -1) == few if side == 0 else _equal_ahead(x, b, b + q, few, 1) == few
            node, q = node[ok], q[ok]
            # Ascending periods: the smallest of each stretch is followed; multiples of it
            # that its run covers twice can't be smallest periods.
            while len(node):
                lead = np.append(True, node[1:] != node[:-1])
                k, p = node[lead], q[lead]
                b = border[k]
                ahead = _equal_ahead(x, b - p, b, high[k] - b, 1)
                back = _equal_ahead(x, b - 1, b - 1 - p, np.maximum(b - p - low[k], 0), -1) if side == 0 else None
                if side == 0:
                    s, e = b - p - back, b + ahead
                else:
                    back = _equal_ahead(x, b - 1, b - 1 + p, b - low[k], -1)
                    ahead = _equal_ahead(x, b, b + p, np.maximum(high[k] - b - p, 0), 1)
                    s, e = b - back, b + p + ahead
                good = (s < b) & (e > b) & (e - s >= np.maximum(least, times * p))
                found.append((k[good], s[good], e[good], p[good]))
                of = np.cumsum(lead) - 1
                reach = (b - s if side == 0 else e - b)[of]
                rest = ~lead & ~((q % p[of] == 0) & (2 * q <= reach))
                node, q = node[rest], q[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    k, s, e, p = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((p, e, s, k))
    k, s, e, p = k[order], s[order], e[order], p[order]
    fresh = np.ones(len(k), np.bool_)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return k[fresh], s[fresh], e[fresh], p[fresh]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, stop, period) of every maximal run of the texts whose words' numbers
    are ``ids``, each from its place in ``starts`` on; by text, start and period. Starts
    and stops count from the text's first word."""
    g = Grammar(ids, starts)
    inner = np.arange(len(g.left))
    low = g.at
    k, s, e, p = _crossing(ids, low, low + g.size[g.left], low + g.size[g.words + inner], least, times)
    none = (np.zeros(0, np.int64),) * 4
    if not len(k):
        return none
    s, e = s - low[k], e - low[k]
    # Which symbols have runs anywhere inside; parts are older than what they make.
    has = np.zeros(g.words + len(inner), np.bool_)
    has[g.words + k] = True
    up, changed = inner, True
    while changed:
        more = up[(has[g.left[up]] | has[g.right[up]]) & ~has[g.words + up]]
        changed = len(more) > 0
        has[g.words + more] = True
    # From the roots to all places of symbols with runs.
    first = np.searchsorted(k, inner, "left")
    many = np.searchsorted(k, inner, "right") - first
    text = np.nonzero(g.roots >= g.words)[0]
    text = text[has[g.roots[text]]]
    node, place = g.roots[text] - g.words, np.zeros(len(text), np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    while len(node):
        n = many[node]
        r = ranges(first[node], n)
        shift = np.repeat(place, n)
        out.append((np.repeat(text, n), s[r] + shift, e[r] + shift, p[r]))
        a, b = g.left[node], g.right[node]
        text = np.concatenate([text, text])
        place = np.concatenate([place, place + g.size[a]])
        node = np.concatenate([a, b])
        go = (node >= g.words) & has[node]
        text, place, node = text[go], place[go], node[go] - g.words
    t, s, e, p = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((-e, s, p, t))
    t, s, e, p = t[order], s[order], e[order], p[order]
    # A run inside one of the same text and period that starts before it is a part of it.
    block = np.cumsum(np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))) - 1
    wide = int(e.max()) + 1
    reach = np.maximum.accumulate(e + block * wide)
    outer = np.append(True, e[1:] + block[1:] * wide > np.maximum(reach[:-1], block[1:] * wide))
    t, s, e, p = t[outer], s[outer], e[outer], p[outer]
    order = np.lexsort((p, s, t))
    return t[order], s[order], e[order], p[order]


Rewrite = Callable[[pa.Array, np.ndarray], np.ndarray]


def planted(ids: pa.Array, counts: np.ndarray) -> np.ndarray:
    """A rewriting that makes texts periodic: for each word of all texts, which word of its
    text stands there. With h the crc32 of the decimal id and g = h // 10, texts whose h is
    divisible by 10 repeat, from word a = g % n on, their next 1 + (n - a) // (3 + g % 8)
    words; a null id counts as empty text."""
    import zlib

    place = ranges(np.zeros(len(counts), np.int64), counts)
    for i, (name, n, end) in enumerate(zip(ids.to_pylist(), counts.tolist(), np.cumsum(counts).tolist())):
        h = zlib.crc32(b"" if name is None else str(name).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            tail = place[end - n + a : end]
            tail[:] = a + (tail - a) % (1 + (n - a) // (3 + g % 8))
    return place


def periodic_runs(
    docs: DataFrame, least: int = 6, times: int = 4, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id column, ``n_words``, ``runs`` (an array of start, length and period in words, by
    start and period) and ``collapsed``: the words, joined by one space, that are in no run
    or among its first period.

    A run is a stretch of at least ``least`` words and ``times`` (4 or more) periods that no
    neighbour extends. ``rewrite`` may tell, for the ids and word counts of some texts, which
    of its text's words each word is to be replaced with first (see ``planted``).
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may lie with less than two on either side of a border")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PlainWords(11)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = words.of(part.column(1))
                ids, starts = found.numbers, found.first
                if rewrite is not None:
                    source = rewrite(part.column(0), np.diff(starts)) + np.repeat(starts[:-1], np.diff(starts))
                    ids = ids[source]
                else:
                    source = np.arange(len(ids))
                t, s, e, p = runs_of(ids, starts, least, times)
                # Words behind a run's first period go.
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, starts[t] + s + p, 1)
                np.add.at(gone, starts[t] + e, -1)
                kept = np.cumsum(gone[:-1]) == 0
                total = np.append(0, np.cumsum(kept))[starts]
                collapsed = found.joined(source[kept], total)
                offsets = np.searchsorted(t, np.arange(len(starts)))
                runs = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(s), pa.array(e - s), pa.array(p)], fields=list(run_type)),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), runs, collapsed], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        find, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each row of ``periodic_runs`` its number of runs, the longest one (ties: the first
    in start, then in period) and digests of all runs and of what is kept."""
    order = lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(
        a["start"] != b["start"], a["start"] - b["start"]
    ).otherwise(a["period"] - b["period"])
    longest = F.reduce(
        "runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda best, r: F.when(best.isNull() | (order(best, r) > 0), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", longest).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
