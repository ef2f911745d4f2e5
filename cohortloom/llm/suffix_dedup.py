"""Repeated byte strings removed by two-stage suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else.
Only suffixes that can share that many bytes need to be sorted together. Every window of
``length`` bytes names an anchor, the smallest hash among its short grams; equal windows
name the same gram at the same place, so the windows of one anchor, a segment of text
around it, are compared with those of equal anchors only. Equal segments are one, with a
count. The segments of an anchor are sorted as suffixes in two stages: those smaller than
their successors directly, the rest induced by scanning the buckets of first bytes in
order. Neighbours in that order that share ``length`` bytes are repeats.

An anchor with very many different segments is divided: the places that it can have in a
window are halved three times, and a part's segments are dealt again by the bytes that all
windows of that part have in common, until groups are small. At the last halving a group is
one window. No task ever sorts more than ``group`` segments, and nothing is left out.

Null texts count as empty. Repeated rows are copies of each other, so all that is long
enough in them goes; of copies none is kept before the others, so there are no ties. Texts
of any length are read whole; matches never cross rows. An empty table gives an empty
result. Extra columns stay as they are.

Passages of a number of words, which may have fewer bytes, are found in the same way and by
the same jobs, with 64-bit hashes of words as letters. Texts that are the same as a whole
are one text there. Segments are told apart by 127 bits, 63 of their anchor and 64 of all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, has_rows, release, save
from .words import PlainWords

PRIME = np.uint64(0x9E3779B97F4A7C15)


def plain_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text starts and the last one ends."""
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@cache
def _plain_words() -> PlainWords:
    return PlainWords()


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as a 64-bit hash each, and where each text starts and the last one ends."""
    found = _plain_words().of(pa.array(texts, pa.string()))
    return found.hashes, found.first


#: Characters of texts that are taken at once, and letters; only a single longer text takes
#: more. Arrays of so many letters stay in a core's cache.
AT_ONCE, LETTERS_AT_ONCE = 1 << 19, 1 << 16


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most``, or one that is larger."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if sizes:
        yield begin, len(sizes)


class Letters(NamedTuple):
    """What stands for texts: ``code`` gives letters of ``size`` bytes, ``gram`` of them, a
    power of two, name an anchor. With ``once``, texts that are the same as a whole are one."""

    code: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]
    size: int
    gram: int
    once: bool


#: The lowest bit of a key tells which letters it is of.
BYTES, WORDS = KINDS = Letters(plain_bytes, 1, 32, False), Letters(word_codes, 8, 8, True)


def least_ahead(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` values in a row."""
    step = 1
    while 2 * step <= wide:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: step - wide], values[wide - step :]) if step < wide else values


def _segments(data: np.ndarray, ends: list[int], length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    if len(data) < length:
        return None
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) + np.uint64(1)
        step, factor = 1, PRIME
        while step < gram:
            h = h[:-step] * factor + h[step:]
            factor = factor * factor
            step *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least = least_ahead(key, length - gram + 1)
    fits = np.ones(len(data), bool)  # windows within one text
    for e in ends:
        fits[max(e - length + 1, 0) : e] = False
    windows = np.flatnonzero(fits[: len(least)])
    if not len(windows):
        return None
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turns = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate([[0], turns + 1])
    places = at[first]
    return h[places].view(np.int64), places, windows[first], windows[np.concatenate([turns, [len(at) - 1]])]


def segments(data: np.ndarray, edges: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Gram hashes, anchors, first and last windows of each run of windows of a text that
    name the same anchor. Text i is ``data[edges[i]:edges[i + 1]]``."""
    found = [(np.zeros(0, np.int64),) * 4]
    for i, j in portions(np.diff(edges).tolist(), LETTERS_AT_ONCE):
        base = edges[i]
        here = _segments(data[base : edges[j]], (edges[i + 1 : j + 1] - base).tolist(), length, gram)
        if here:
            found.append((here[0], *(x + base for x in here[1:])))
    return tuple(map(np.concatenate, zip(*found)))


def smaller_than_next(text: bytes | str) -> bytearray:
    """1 for each suffix that is smaller than its successor; the empty suffix is smallest."""
    out, n = bytearray(len(text)), len(text)
    for i in range(n - 2, -1, -1):
        a, b = text[i], text[i + 1]
        out[i] = a < b or (a == b and out[i + 1])
    return out


def two_stage_sort(texts: list[bytes] | list[str], counts: list[int]) -> list[tuple[int, int]]:
    """The suffixes (text, start) with start < counts[text], in order.

    Each text's suffixes are taken as far as the first directly sorted one at or after its
    last start, or its end, so that every other one has a successor to be induced from.
    """
    kinds = [smaller_than_next(t) for t in texts]
    direct: list[tuple[bytes | str, int, int]] = []
    ends: list[tuple[int, int]] = []
    for j, (text, count, kind) in enumerate(zip(texts, counts, kinds)):
        stop = kind.find(1, count - 1)
        if stop < 0:
            ends.append((j, len(text)))
            stop = len(text) - 1
        p = kind.find(1, 0, stop + 1)
        while p >= 0:
            direct.append((text[p:], j, p))
            p = kind.find(1, p + 1, stop + 1)
    direct.sort()
    buckets: dict[int | str, list[tuple[int, int]]] = {c: [] for c in sorted(set().union(*texts))}
    for j, n in ends:
        buckets[texts[j][n - 1]].append((j, n - 1))
    sorted_first: dict[int | str, list[tuple[int, int]]] = {c: [] for c in buckets}
    for _, j, p in direct:
        sorted_first[texts[j][p]].append((j, p))
    out = []
    for c in buckets:
        for group in (buckets[c], sorted_first[c]):  # the first grows while it is read
            for j, p in group:
                if p < counts[j]:
                    out.append((j, p))
                if p and not kinds[j][p - 1]:
                    buckets[texts[j][p - 1]].append((j, p - 1))
    return out


def repeated_windows(texts: list[bytes] | list[str], counts: list[int], length: int) -> list[bytearray]:
    """For each text and start below its count, 1 if a neighbour in suffix order shares
    ``length`` bytes."""
    marks = [bytearray(c) for c in counts]
    before = None
    for j, p in two_stage_sort(texts, counts):
        window = texts[j][p : p + length]
        if before is not None and before[0] == window:
            marks[j][p] = marks[before[1]][before[2]] = 1
        before = (window, j, p)
    return marks


def runs(marks: bytearray, length: int) -> list[tuple[int, int]]:
    out, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        out.append((at, end - 1 + length))
        at = marks.find(1, end)
    return out


def as_letters(bodies: list[bytes], size: int) -> list[bytes] | list[str]:
    """Texts with one letter for ``size`` bytes: bytes as they are, wider ones as characters
    in the order of their values."""
    if size == 1:
        return bodies
    _, ranks = np.unique(np.frombuffer(b"".join(bodies), f"u{size}"), return_inverse=True)
    text = ranks.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum([len(b) // size for b in bodies]).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


UNIT = "key long, seg long, n long, lo int, hi int, dlo int, dhi int, t binary, s0 int, body binary"
UNIT_COLUMNS = [x.split()[0] for x in UNIT.split(", ")]
SPAN = "t binary, start int, stop int, of_words boolean"


def halved(
    lo: int, hi: int, dlo: int, dhi: int, body: bytes, length: int, size: int
) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """For each half of a block of places that a body has windows in: the half, the body's
    first and last place there, what all windows of the half share, and their part of the body."""
    middle = (lo + hi) // 2
    for a, b in ((lo, middle), (middle + 1, hi)):
        x, y = max(a, dlo), min(b, dhi)
        if x <= y:
            # A window whose anchor lies at place d starts dhi - d letters into the body. Every
            # body reaches as far as what all windows of the half's places share.
            shared = body[(dhi - a) * size : (dhi - b + length) * size]
            yield a, b, x, y, shared, body[(dhi - y) * size : (dhi - x + length) * size]


#: How often a group's places are halved before it is sorted; many bodies are alone by then.
HALVINGS = 3

Row = tuple[int, int, int, bytes, int, bytes]


def spans_within(rows: list[Row], lo: int, hi: int, length: int, size: int, times: int = HALVINGS) -> Iterator[tuple[bytes, int, int]]:
    """Spans of the rows (n, first place, last place, text, start, body) that occur once, n = 1.
    Their windows are dealt by what those of half the places share; parts that are equal go
    whole and are one from there on, and what is left together is sorted."""
    if len(rows) < 2 or all(r[0] > 1 for r in rows):
        return
    if not times or lo == hi:
        marks = repeated_windows(as_letters([r[5] for r in rows], size), [r[2] - r[1] + 1 for r in rows], length)
        yield from ((r[3], r[4] + a, r[4] + b) for r, m in zip(rows, marks) if r[0] == 1 for a, b in runs(m, length))
        return
    found: dict[tuple[int, int, bytes], dict[tuple[int, int, bytes], list[tuple[int, bytes, int]]]] = defaultdict(dict)
    for n, dlo, dhi, t, s0, body in rows:
        for a, b, x, y, shared, part in halved(lo, hi, dlo, dhi, body, length, size):
            found[a, b, shared].setdefault((x, y, part), []).append((n, t, s0 + dhi - y))
    for (a, b, _), parts in found.items():
        some = []
        for (x, y, part), owners in parts.items():
            if len(owners) > 1:
                yield from ((t, at, at + y - x + length) for n, t, at in owners if n == 1)
            n, t, at = owners[0]
            some.append((n if len(owners) == 1 else 2, x, y, t, at, part))
        yield from spans_within(some, a, b, length, size, times - 1)


def _sorted_groups(units: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Spans of the units that occur once, from suffix sorting within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, places, group = 0, (0, 0), {}

        def done() -> list[tuple[bytes, int, int, bool]]:
            kind = key & 1
            return [(*x, kind == 1) for x in spans_within(list(group.values()), *places, lengths[kind], KINDS[kind].size)]

        def batch_of(found: list[tuple[bytes, int, int, bool]]) -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 4
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["t", "start", "stop", "of_words"])

        for batch in batches:
            found = []
            for k, seg, n, lo, hi, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    found += done()
                    key, places, group = k, (lo, hi), {}
                group[seg] = (n, *rest)
            yield batch_of(found)
        yield batch_of(done())

    return units.select(*UNIT_COLUMNS).repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


#: How often a block of places is halved when its segments are dealt again.
HALVINGS_DEALT = 3


def _parts(units: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Each unit's windows by parts of its block of places, keyed by what the windows of
    a part have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                for key, _, n, lo, hi, dlo, dhi, t, s0, body in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)):
                    kind = key & 1
                    length, size = lengths[kind], KINDS[kind].size
                    now = [(lo, hi, dlo, dhi, b"", body)]
                    for _ in range(HALVINGS_DEALT):
                        now = [x for a, b, x, y, _, part in now for x in halved(a, b, x, y, part, length, size)]
                    for a, b, x, y, shared, part in now:
                        new = xxhash.xxh3_64_intdigest(shared, key & 0xFFFFFFFF ^ a << 1) - (1 << 63) & ~1 | kind
                        seg = xxhash.xxh3_64_intdigest(part, x) - (1 << 63)
                        out.append((new, seg, n, a, b, x, y, t, s0 + dhi - y, part))
                columns = zip(*out) if out else [()] * 10
                kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=UNIT_COLUMNS)

    return units.select(*UNIT_COLUMNS).mapInArrow(run, UNIT)


def _of_words() -> Column:
    return F.col("key").bitwiseAND(F.lit(1)) == 1


def _with_sizes(rows: DataFrame, occurrences: Column) -> DataFrame:
    """Segments (key, seg, t, s0, ...) of keys that occur more than once, with the occurrences
    of each (``n``), the number of different ones with its key (``k``), whether any of those
    occurs once (``single``), and whether a row is the one that stands for its like (``mine``).
    All is summed up in parts, saved and joined; Spark can split such a join, unlike a window
    or a join that sums up in the same stage.
    ``occurrences`` may use ``first`` and ``last``, hashes of places, the same for one place."""
    place = F.xxhash64("t", "s0")
    first, last = F.min(place).alias("first"), F.max(place).alias("last")
    each = rows.groupBy("key", "seg").agg(F.sum("n").alias("sum"), F.max("n").alias("most"), first, last)
    each = save(each.select("key", "seg", occurrences.alias("n"), "first"), "each")
    keys = each.groupBy("key").agg(F.count("*").alias("k"), (F.min("n") == 1).alias("single"))
    keys = save(keys.where("k > 1 OR NOT single"), "keys")
    sized = rows.drop("n").join(each.join(keys, "key"), ["key", "seg"]).withColumn("mine", place == F.col("first")).drop("first")
    out = save(sized, "dealt")
    discard(each, keys)
    return out


def _whole(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Spans of whole segments."""
    length = F.when(_of_words(), lengths[-1]).otherwise(lengths[0])
    stop = (F.col("s0") + F.col("dhi") - F.col("dlo") + length).cast("int")
    return rows.select("t", F.col("s0").alias("start"), stop.alias("stop"), _of_words().alias("of_words"))


def repeated_spans(docs: DataFrame, length: int = 400, group: int = 300, words: int | None = None) -> DataFrame:
    """(t, start, stop, of_words): the ranges that go, by md5 of the text; they may overlap.

    Ranges are of bytes that lie in a string of ``length`` bytes that also starts elsewhere,
    and with ``words`` also of words, by their numbers, that lie in so many words in a row
    that stand elsewhere. Both go through the same jobs. ``docs`` has ``t`` (md5, binary)
    and ``text``. ``group`` is how many segments are sorted at once.
    """
    lengths = (length,) if words is None else (length, words)

    def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["key", "seg", "n", "dlo", "dhi", "t", "s0"]
        for batch in batches:
            hashes = batch.column(0).to_pylist()
            here = Counter(hashes)
            first = dict(zip(hashes, batch.column(1).to_pylist()))
            for i, j in portions([len(t or "") for t in first.values()], AT_ONCE):
                ts, texts = list(first)[i:j], list(first.values())[i:j]
                copies, names_of = np.array([here[t] for t in ts]), pa.array(ts, pa.binary())
                for kind, wide in enumerate(lengths):
                    letters = KINDS[kind]
                    data, edges = letters.code(texts)
                    gram, place, a, b = segments(data, edges, wide, letters.gram)
                    doc = np.searchsorted(edges, a, "right") - 1
                    raw, size = data.tobytes(), letters.size
                    ends = ((b + wide) * size).tolist()
                    seg = [xxhash.xxh3_64_intdigest(raw[x:y], d) for x, y, d in zip((a * size).tolist(), ends, (place - a).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram & ~1 | kind), pa.array(np.array(seg, np.uint64).view(np.int64)),
                            pa.array(np.ones(len(doc), np.int64) if letters.once else copies[doc]),
                            pa.array((place - b).astype(np.int32)), pa.array((place - a).astype(np.int32)),
                            names_of.take(pa.array(doc)), pa.array((a - edges[doc]).astype(np.int32)),
                        ],
                        names=names,
                    )

    found = save(
        docs.select("t", "text").mapInArrow(cut_segments, "key long, seg long, n long, dlo int, dhi int, t binary, s0 int"), "segments"
    )
    # Keys of one place alone go no further; where all segments of a key are the same, they go whole.
    place = F.xxhash64("t", "s0")
    keys = found.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    keys = keys.where(F.when(_of_words(), F.col("first") != F.col("last")).otherwise(F.col("n") > 1))
    keys = save(keys.select("key", (F.col("a") == F.col("b")).alias("same")), "keys")
    shared = save(found.join(keys, "key"), "shared")
    discard(found, keys)
    # All rows of one text and place are one occurrence of words.
    once = F.when(F.col("first") == F.col("last"), 1).otherwise(2).cast("long")
    dealt = _with_sizes(shared.where("NOT same").drop("same"), F.when(_of_words(), once).otherwise(F.col("sum")))
    spans = [_whole(shared.where("same"), lengths), _whole(dealt.where("n > 1"), lengths)]

    chosen = F.struct("key", "seg", "n", "k", "s0", "dlo", "dhi")
    wanted = dealt.where("single AND mine").groupBy("t").agg(F.collect_list(chosen).alias("parts"))

    def one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for t in batch.column(0).to_pylist():
                new.append(t not in seen)
                seen.add(t)
            yield batch.filter(pa.array(new))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                hashes, texts, listed = batch.slice(at, 50).columns
                rows = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
                all_parts = listed.flatten()
                keys = all_parts.field("key").to_numpy()
                for kind, wide in enumerate(lengths):
                    of_kind = np.flatnonzero(keys & 1 == kind)
                    if not len(of_kind):
                        continue
                    docs_here, doc = np.unique(rows[of_kind], return_inverse=True)
                    data, edges = KINDS[kind].code(texts.take(pa.array(docs_here)).to_pylist())
                    p = all_parts.take(pa.array(of_kind))
                    s0, dlo, dhi = (p.field(c).to_numpy().astype(np.int64) for c in ("s0", "dlo", "dhi"))
                    raw, size, starts = data.tobytes(), KINDS[kind].size, edges[doc] + s0
                    ends = starts + dhi - dlo + wide
                    body = [raw[x:y] for x, y in zip((starts * size).tolist(), (ends * size).tolist())]
                    lo, hi = np.zeros(len(doc), np.int32), np.full(len(doc), wide - KINDS[kind].gram, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(p.field(c) for c in ("key", "seg", "n")), pa.array(lo), pa.array(hi), p.field("dlo"), p.field("dhi"),
                            hashes.take(pa.array(rows[of_kind])), p.field("s0"), pa.array(body, pa.binary()), p.field("k"),
                        ],
                        names=[*UNIT_COLUMNS, "k"],
                    )

    texts = docs.select("t", "text").mapInArrow(one_of_each, "t binary, text string").join(wanted, "t")
    units = save(texts.select("t", "text", "parts").mapInArrow(bodies, UNIT + ", k long"), "units")
    few, used = [units.where(F.col("k") <= group)], [shared, dealt, units]
    hot = units.where(F.col("k") > group)
    while has_rows(hot):
        parts = save(_parts(hot, lengths), "parts")
        # A unit of words is there as often as its text; one place is one occurrence.
        dealt = _with_sizes(parts, F.when(F.col("first") == F.col("last"), F.col("most")).otherwise(2))
        discard(parts)
        # Parts found twice or more go whole, wherever they occur once as units.
        spans.append(_whole(dealt.where("n > 1"), lengths))
        open_ = dealt.where("single AND mine AND k > 1")
        few.append(open_.where(F.col("k") <= group).select(*UNIT_COLUMNS, "k"))
        hot = open_.where(F.col("k") > group)
        used.append(dealt)
    spans.append(_sorted_groups(reduce(DataFrame.unionByName, few), lengths))
    out = save(reduce(DataFrame.unionByName, spans), "spans")
    discard(*used)  # all spans are saved
    release(docs.sparkSession)
    return out


LETTER = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])


def byte_ranges(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first byte of the first word to the last one of the last, for ranges of words."""
    if not ranges:
        return []
    edges = np.flatnonzero(np.diff(LETTER[np.frombuffer(data, np.uint8)], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    first, last = np.array(ranges).T
    return list(zip(starts[first].tolist(), ends[last - 1].tolist()))


def joined_up(starts: np.ndarray, stops: np.ndarray, touching: bool = True) -> list[tuple[int, int]]:
    """The union of ranges, in order; those that only touch are one where ``touching``."""
    if not len(starts):
        return []
    order = np.argsort(starts)
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(starts[1:] >= reach[:-1] + touching) + 1
    return list(zip(starts[[0, *new]].tolist(), reach[[*(new - 1), -1]].tolist()))


#: A passage of over 50 words is long enough to count, also where it has fewer than 400 bytes.
PASSAGE_WORDS = 51

COUNTS = ("kept", "n_bytes", "n_removed", "n_spans")
#: Bytes and number of stretches that lie in repeated passages of a number of words.
PASSAGES = ("n_passage_bytes", "n_passages")


def remove_repeats(
    docs: DataFrame, length: int = 400, text_col: str = "text", as_text: bool = False, out: tuple[str, ...] = COUNTS,
    words: int | None = None, cut_words: bool = True,
) -> DataFrame:
    """All columns of ``docs``, and what is kept of the text, its bytes, those removed and
    the removed spans, in columns named ``out``, which ``docs`` must not have.

    What is kept is binary, or with ``as_text`` a string without characters cut in two.
    With ``words``, so many words in a row that also stand elsewhere go too, however few
    bytes they have; both are judged on the input. Without ``cut_words`` these stay, and
    two more names in ``out`` are for their bytes and how many stretches they make up.
    """
    if words is not None and not cut_words and len(out) == len(COUNTS):
        out += PASSAGES
    hash_col, spans_col = free_name(docs, "_t"), free_name(docs, "_spans")
    hashed = docs.withColumn(hash_col, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    texts = hashed.select(F.col(hash_col).alias("t"), F.col(text_col).alias("text"))
    spans = repeated_spans(texts, length) if words is None else repeated_spans(texts, length, words=words)
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.shiftleft(F.col("stop").cast("long"), 1) + F.col("of_words").cast("long")
    listed = spans.groupBy(F.col("t").alias(hash_col)).agg(F.collect_set(packed).alias(spans_col))
    joined = hashed.join(listed, hash_col, "left")
    schema = docs.schema
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    where = schema.names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], batch.column(len(schema))
            packed = found.flatten().to_numpy()
            starts, stops, kinds = packed >> 32, packed >> 1 & 0x7FFFFFFF, packed & 1
            edges = np.cumsum([0, *found.value_lengths().fill_null(0).to_pylist()]).tolist()
            for text, x, y in zip(batch.column(where).to_pylist(), edges, edges[1:]):
                data = (text or "").encode()
                merged, passages = [], []
                if y > x:
                    a, b, of_words = starts[x:y], stops[x:y], kinds[x:y] == 1
                    merged = joined_up(a[~of_words], b[~of_words])
                    passages = byte_ranges(data, joined_up(a[of_words], b[of_words], not cut_words))
                    if cut_words and passages:
                        merged = joined_up(*np.array(merged + passages).T)
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                counts = (len(data), len(data) - len(rest), len(merged))
                if len(out) > len(COUNTS):
                    counts += (sum(b - a for a, b in passages), len(passages))
                rows.append((rest.decode(errors="ignore") if as_text else rest, *counts))
            kept_column, *more = zip(*rows) if rows else [()] * len(out)
            new = [pa.array(kept_column, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in more)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(schema)], *new], names=[*schema.names, *out])

    kinds = ("string" if as_text else "binary", *["long"] * (len(out) - 1))
    added = [f"`{c}` {k}" for c, k in zip(out, kinds)]
    return joined.select(*schema.names, spans_col).mapInArrow(cut, ", ".join(names + added))
