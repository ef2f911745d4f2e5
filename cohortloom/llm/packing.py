"""Packing documents into sequences with a configuration linear program.

All pieces of one length are alike, so the problem is the histogram of lengths: at most
``capacity`` numbers, however many documents there are. A configuration is a multiset of
lengths that fits one sequence. The linear program covers every length's count with the
least total of configurations. Multiplicative weights solve it: a length weighs less the
more of its count is covered, a knapsack by dynamic programming finds configurations that
are best at the current weights, and their shares add up to a fractional solution. Any
weights also bound the number of sequences from below, by what all pieces are worth against
the best configuration. The shares are rounded down and the
program of what is left is solved again; what no share fills is priced whole.
Every piece finds its sequence by its rank among the pieces of its length.

Null texts count as empty: a document of the end id alone. Repeated rows are packed like
any others, and told apart by a hash of their text where ids agree; rows alike in both
are alike in every respect. Texts of any length are cut into full pieces and a rest. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, save, spread
from .idcache import IdCache, ranges
from .merges import byte_letters, merger_of
from .words import RangeHasher, byte_numbers, slices, text_bytes


#: Words that no normalisation but lower case changes, without apostrophes.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, word by word.

    White space ends every word before any merge, so a word is encoded once and its ids are
    looked up afterwards. New words of plain letters, digits and signs are merged side by
    side; the library encodes all others, many in one call with a special token between
    them. Breaks are blank, newline and tab; other white space stays in its word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark, self.mark_id = "<|startoftext|>", self.tokenizer.token_to_id("<|startoftext|>")
        self.hasher, self.cache = RangeHasher(byte_numbers(6)), IdCache()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.first = np.array([[model["vocab"][c + e] for c in letters] for e in ("", end)])
        self.merger = merger_of(model)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word of plain letters, digits and signs has, and the ids: runs
        of letters or signs and single digits are merged on their own."""
        data = np.frombuffer("".join(words).lower().encode(), np.uint8)
        sizes = np.array([len(w) if w.isascii() else len(w.encode()) for w in words])
        begin = np.cumsum(sizes) - sizes
        digit = (data >= 48) & (data <= 57)
        kind = ((data >= 97) & (data <= 122)) | (data >= 128)
        edge = digit.copy()
        edge[1:] |= digit[:-1] | (kind[1:] != kind[:-1])
        edge[begin] = True
        starts, ends = np.nonzero(edge)[0], np.append(edge[1:], True).astype(np.int8)
        counts, ids = self.merger.merge_all(self.first[ends, data], starts)
        of = np.searchsorted(begin, starts, "right") - 1
        return np.bincount(of, counts, len(words)).astype(np.int64), ids

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids."""
        if self.mark_id is None or any(self.mark in w for w in words):
            each = [self._ids(w) for w in words]
            return np.array([len(x) for x in each]), np.concatenate(each)
        ids = self._ids(self.mark.join(words))
        ends = np.append(np.nonzero(ids == self.mark_id)[0], len(ids))
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.mark_id]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([bool(PLAIN.fullmatch(w)) and "<|" not in w for w in words])
        counts, parts = np.zeros(len(words), np.int64), []
        for which, how in ((plain, self._plain), (~plain, self._encode_words)):
            here = np.nonzero(which)[0]
            if len(here):
                counts[here], ids = how([words[i] for i in here.tolist()])
                parts.append((here, ids))
        out, begin = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for here, ids in parts:
            out[ranges(begin[here], counts[here])] = ids
        return counts, out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and where each text's begin; one
        more number stands at the end."""
        data, offsets = text_bytes(texts)
        inside = (data != 32) & (data != 10) & (data != 9)
        before = np.zeros(len(data) + 1, np.bool_)
        before[1:] = inside
        before[offsets] = False
        starts = np.nonzero(inside & ~before[:-1])[0]
        after = np.zeros(len(data) + 1, np.bool_)
        after[:-1] = inside
        after[offsets] = False
        ends = np.nonzero(inside & ~after[1:])[0] + 1
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        hashes = self.hasher.hashes(data, starts, ends)
        ids, counts = self.cache.sequence(
            hashes, lambda at: self._new([data[starts[i] : ends[i]].tobytes().decode() for i in at.tolist()])
        )
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, with their lengths and the checksum of their ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                ids_of, bounds = encoder.encode(part.column(1))
                data, offsets = text_bytes(part.column(1))
                ids_of, bounds, offsets = ids_of.astype("<u4"), bounds.tolist(), offsets.tolist()
                out: list[tuple] = []
                for k in range(part.num_rows):
                    ids = ids_of[bounds[k] : bounds[k + 1]].tobytes() + end
                    hashed = zlib.crc32(data[offsets[k] : offsets[k + 1]])
                    for p, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        out.append((k, p, start // 4, len(piece) // 4, zlib.crc32(piece), hashed))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(columns[0], pa.int32())),
                        pa.array(columns[1], pa.int32()),
                        *[pa.array(c, pa.int64()) for c in columns[2:]],
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "text_hash"],
                )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, text_hash long"
    )


def best_configuration(value: np.ndarray, limit: np.ndarray, capacity: int, enough: float = np.inf) -> dict[int, int]:
    """The knapsack that prices configurations: lengths worth most that fit a sequence.

    ``value[l]`` is what a piece of length l is worth, ``limit[l]`` how many there are.
    Lengths enter the dynamic program as bundles of 1, 2, 4, ... pieces, those worth most
    a token first; it ends early once a full sequence is worth ``enough``.
    """
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    present = np.nonzero(value > 0)[0]
    for length in present[np.argsort(-value[present] / present, kind="stable")].tolist():
        left, bundle = min(int(limit[length]), capacity // length), 1
        while left > 0:
            k = min(bundle, left)
            weight = length * k
            moved = best[: capacity + 1 - weight] + value[length] * k
            better = moved > best[weight:] + 1e-12
            if better.any():
                taken.append((length, k, better))
                best[weight:] = np.where(better, moved, best[weight:])
            left, bundle = left - k, bundle * 2
        if best[capacity] >= enough:
            break
    out: dict[int, int] = {}
    room = capacity
    for length, k, used in reversed(taken):
        if room >= length * k and used[room - length * k]:
            out[length] = out.get(length, 0) + k
            room -= length * k
    return out


class Configurations:
    """The configurations priced so far: rows of lengths and how often each occurs."""

    def __init__(self) -> None:
        self.known: set[tuple[tuple[int, int], ...]] = set()
        self.lengths = self.times = np.zeros((0, 1), np.int64)

    def __len__(self) -> int:
        return len(self.lengths)

    def add(self, pattern: dict[int, int]) -> bool:
        key = tuple(sorted(pattern.items()))
        if key in self.known:
            return False
        self.known.add(key)
        wide = max(self.lengths.shape[1], len(key))
        for name, row in (("lengths", [n for n, _ in key]), ("times", [k for _, k in key])):
            old = getattr(self, name)
            rows = np.zeros((len(old) + 1, wide), np.int64)
            rows[:-1, : old.shape[1]], rows[-1, : len(row)] = old, row
            setattr(self, name, rows)
        return True

    def pattern(self, i: int) -> dict[int, int]:
        return {int(n): int(k) for n, k in zip(self.lengths[i], self.times[i]) if k}


def fractional(
    left: np.ndarray,
    capacity: int,
    pool: Configurations,
    rounds: int,
    step: float = 0.1,
    every: int = 1,
    gap: float = 0.005,
    longer: float = 0.01,
) -> tuple[np.ndarray, float]:
    """The share of each of the pool's configurations, which together cover the pieces of
    ``left`` on average once, and a lower bound on the number of configurations.

    In every round all configurations within a quarter of ``step`` of the best at the
    current weights get an equal share, so much that no length's cover grows by more than
    ``step``; its weight falls with the exponential of its cover. Every ``every`` rounds the
    knapsack prices a new one, to within ``gap`` of the best. What all pieces are worth over
    what the best configuration is worth bounds any packing; the weights of a round are
    tried, and now and then their mean so far.
    """
    present, size = np.nonzero(left)[0], capacity + 1
    count = left[present].astype(float)
    each, cover, mean = np.zeros(size), np.zeros(size), np.zeros(len(present))
    each[present] = 1 / count
    x, bound = np.zeros(len(pool)), 0.0
    fits = (pool.times <= left[pool.lengths]).all(1)

    def price(value: np.ndarray) -> dict[int, int]:
        nonlocal x, fits, bound
        full = (value[present] / present).max() * capacity
        pattern = best_configuration(value, left, capacity, (1 - gap) * full)
        worth = sum(value[n] * k for n, k in pattern.items())
        bound = max(bound, float(count @ value[present]) / (full if worth >= (1 - gap) * full else worth))
        if pool.add(pattern):
            x, fits = np.append(x, 0.0), np.append(fits, True)
        return pattern

    for r in range(rounds):
        # At the start a length is worth its tokens, long ones a little more, so that short ones last.
        value = np.zeros(size)
        value[present] = present * (1 + longer * present / capacity) * np.exp(cover[present].min() - cover[present])
        mean += value[present] / (count @ value[present])
        if r % every == 0:
            price(value)
        if r % 500 == 499:
            tried = np.zeros(size)
            tried[present] = mean
            price(tried)
        worth = (value[pool.lengths] * pool.times).sum(1) * fits
        near = np.nonzero(worth >= (1 - step / 4) * worth.max())[0]
        rate = np.bincount(pool.lengths[near].ravel(), pool.times[near].ravel(), size) * each
        share = step / rate.max()
        x[near] += share
        cover += share * rate
    return x / np.average(cover[present], weights=count * present), bound


def bounded_plan(
    histogram: np.ndarray, capacity: int, rounds: int = 1000, last: int = 100, gaps: tuple[float, ...] = (0.002, 0.0005)
) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations and how often to use each, and a number of sequences that no packing
    can go below.

    The program is solved and its shares are rounded down; then the rest is solved anew,
    with the same pool and a quarter of the rounds, until ``last`` sequences would do or no
    share reaches one. What is left is priced whole (``solve``), and again to a closer gap
    where the plan stays above the bound.
    """
    left, lengths = histogram.astype(np.int64).copy(), np.arange(len(histogram))
    out: list[tuple[dict[int, int], int]] = []
    whole = int(left[capacity])
    if whole:
        out.append(({capacity: 1}, whole))
        left[capacity] = 0
    bound, pool, first = -(-int(left @ lengths) // capacity), Configurations(), True
    while int(left @ lengths) > last * capacity:
        x, least = fractional(left, capacity, pool, rounds if first else rounds // 4)
        if first:
            bound, first = max(bound, int(np.ceil(least - 1e-6))), False
        settled = False
        for i in np.nonzero(x >= 1)[0][np.argsort(-x[x >= 1], kind="stable")].tolist():
            pattern = pool.pattern(i)
            times = min([int(x[i])] + [int(left[n]) // k for n, k in pattern.items()])
            if times:
                out.append((pattern, times))
                settled = True
                for n, k in pattern.items():
                    left[n] -= k * times
        if not settled:
            break
    rest: list[tuple[dict[int, int], int]] | None = None
    for gap in gaps:
        priced = solve(left, capacity, gap=gap)
        if rest is None or sum(n for _, n in priced) < sum(n for _, n in rest):
            rest = priced
        if sum(n for _, n in out + rest) == bound + whole:
            break
    return out + rest, bound + whole


def solve(
    histogram: np.ndarray, capacity: int, step: float = 0.2, longer: float = 0.01, gap: float = 0.005
) -> list[tuple[dict[int, int], int]]:
    """Whole configurations one after another, for what rounding leaves over.

    ``histogram[l]`` counts the pieces of length l. In every round a configuration that is
    best at the current weights, or within ``gap`` of a bound on the best, is used as often
    as its scarcest length allows, and the weights of its lengths fall with the part of
    them that is covered. A round uses up one length at least, so there are no more of
    them than lengths, however many pieces there are.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    need = np.maximum(histogram, 1)
    while left.any():
        present = np.nonzero(left)[0]
        # A token weighs more the further its length lags behind the others; ties go to long pieces.
        lag = 1 - left[present] / need[present]
        price = np.exp(-step * (lag - lag.min())) * (1 + longer * present / capacity)
        value = np.zeros(capacity + 1)
        value[present] = price * present
        pattern = best_configuration(value, left, capacity, (1 - gap) * capacity * price.max())
        times = min(int(left[l]) // k for l, k in pattern.items())
        out.append((pattern, times))
        for l, k in pattern.items():
            left[l] -= k * times
    return out


def best_plan(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan of ``bounded_plan``."""
    return bounded_plan(histogram, capacity)[0]


def _places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, which of its ranks go where: first rank, one past the last,
    first sequence, how many lie in each sequence, offset of the first of them."""
    next_rank: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rank = next_rank.get(length, 0)
            out.append((length, rank, rank + k * times, sequence, k, offset))
            next_rank[length] = rank + k * times
            offset += k * length
        sequence += times
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Put every document's ids, followed by ``end_id``, into sequences of ``capacity``.

    Only the histogram of lengths, ``capacity`` numbers, reaches the driver, and the
    table of places that it makes from them goes back as a join side: a few rows for
    each configuration, whatever the input's size.
    """
    spark = docs.sparkSession
    slim = save(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counted = slim.groupBy("length").count().collect()  # one row a length at most
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row[0]] = row[1]
    total = int(histogram.sum())
    plan = best_plan(histogram, capacity)
    places = spark.createDataFrame(
        _places(plan), "_length long, _from long, _to long, _sequence long, _each long, _offset long"
    )
    wide = max(1, total // 5_000)
    ranked = numbered(
        slim,
        ["length"],
        [F.col(id_col), "text_hash", "start"],
        spread(wide, F.col(id_col), "piece"),
        "_rank",
    )
    on = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_to"))
    )
    nth = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(places), on).select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
