"""Words of whole batches of texts, found and hashed with a few array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; only a single longer word takes more.
PIECE = 1 << 17
MULTIPLIER = 0xD1342543DE82EF95
MASK = (1 << 64) - 1


def byte_numbers(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(1, MASK, 256, np.uint64, endpoint=True)


def _letters(seed: int) -> np.ndarray:
    """The same with A-Z as a-z, and 0 for separators."""
    out = byte_numbers(seed)
    out[65:91] = out[97:123]
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


def _powers(factor: int, size: int = PIECE) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0], have = 1, 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * np.uint64(pow(factor, have, 1 << 64))
        have += more
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class RangeHasher:
    """64-bit hashes of stretches of bytes, by differences of running sums."""

    def __init__(self, letter: np.ndarray):
        self.letter, self.size = letter, 0

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > self.size:
            self.size = max(PIECE, 1 << (len(data) - 1).bit_length())
            self.power, self.inverse = _powers(MULTIPLIER, self.size), _powers(pow(MULTIPLIER, -1, 1 << 64), self.size)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(np.take(self.letter, data, mode="clip") * self.power[: len(data)], out=sums[1:])
            return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


class WordHasher:
    """64-bit hashes of the words of many texts; a word is a run of bytes other than
    white space, in lower case as far as A-Z go.

    A word's hash is the sum of its bytes' random numbers times powers of an odd number,
    taken as a difference of running sums, so no word is handled on its own. Words of over
    ``LONG`` bytes, where powers repeat too much, are hashed one by one.
    """

    LONG = 256

    def __init__(self, seed: int = 7):
        self.letter = _letters(seed)
        self.power, self.inverse = _powers(MULTIPLIER), _powers(pow(MULTIPLIER, -1, 1 << 64))
        self.lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def _piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a piece's words, where they start, and their last three bytes as a
        number; ``cuts`` are starts of texts."""
        import xxhash

        value = np.take(self.letter, data, mode="clip")
        word = value != 0
        edge = word.copy()
        edge[1:] ^= word[:-1]
        # Where a text starts inside a run of letters, a word ends and another starts.
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        inner = np.unique(inner[word[inner] & word[inner - 1]])
        at = np.nonzero(edge)[0]
        if len(at) % 2:
            at = np.append(at, len(data))
        starts, ends = at[::2], at[1::2]
        if len(inner):
            starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
        if not len(starts):
            return np.zeros(0, np.uint64), starts, starts
        sums = np.zeros(len(data) + 1, np.uint64)
        wide = ends - starts
        with np.errstate(over="ignore"):
            if len(data) <= PIECE:
                np.cumsum(value * self.power[: len(data)], out=sums[1:])
                hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
            else:  # it holds a word of more than a piece
                hashes = np.array([(value[a:b] * self.power[: b - a]).sum() if b - a <= self.LONG else 0 for a, b in zip(starts, ends)], np.uint64)
            hashes = mixed(hashes + wide.astype(np.uint64))
        for i in np.nonzero(wide > self.LONG)[0]:
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().translate(self.lower))
        small = np.frombuffer(self.lower, np.uint8)
        tails = small[data[ends - 1]].astype(np.int64)
        for k in (2, 3):
            tails += np.where(wide >= k, small[data[np.maximum(ends - k, 0)]].astype(np.int64) << 8 * (k - 1), 0)
        return hashes, starts, tails

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, text by text, and each text's first word in them; one
        more number stands at the end. Null texts have no words."""
        return self.with_tails(texts)[:2]

    def with_tails(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and every word's last three bytes as a number."""
        data, offsets = text_bytes(texts)
        found, places, tails = [], [], []
        for a, b in _pieces(data, offsets, self.letter):
            first, last = np.searchsorted(offsets, [a, b])
            h, s, t = self._piece(data[a:b], offsets[first:last] - a)
            found.append(h)
            places.append(s + a)
            tails.append(t)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets), np.concatenate(tails)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each of them starts and the last one ends."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, starts, raw = texts.buffers()
    offsets = np.frombuffer(starts, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that cut no word."""
    at, end = 0, len(data)
    while at < end:
        stop = min(end, at + PIECE)
        if stop < end:
            text = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if text > at:
                stop = text
            else:  # inside one long text
                blank = np.nonzero(letter[data[at:stop]] == 0)[0]
                while not len(blank) and stop < end:
                    more = min(end, stop + PIECE)
                    blank = np.nonzero(letter[data[stop:more]] == 0)[0] + (stop - at)
                    stop = more
                if len(blank):
                    stop = at + int(blank[-1]) + 1
        yield at, stop
        at = stop


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts, in column ``text``, have about ``most`` bytes."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def first_of_runs(x: np.ndarray) -> np.ndarray:
    """True where a sorted array has a value that is not the one before."""
    out = np.ones(len(x), np.bool_)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Shingles:
    """Sets of hashed word n-grams of many texts; a text of fewer words is one n-gram."""

    ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

    def __init__(self, n: int):
        self.n, self.words = n, WordHasher()

    def _grams(self, h: np.ndarray, n: int) -> np.ndarray:
        count = max(0, len(h) - n + 1)
        out = np.full(count, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = (out + h[i : count + i]) * self.ODD[i % 5]
                out ^= out >> np.uint64(31)
        return out

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its distinct n-grams in order, as unsigned 64-bit hashes."""
        h, starts = self.words.hashes(texts)
        grams, out = self._grams(h, self.n), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= self.n:
                s = np.sort(grams[a : b - self.n + 1])
                out.append(s[first_of_runs(s)])
            else:
                out.append(self._grams(h[a:b], b - a) if b > a else h[:0])
        return out


class Found:
    """The words of some texts: number ``numbers`` (equal words, equal numbers), hash, and
    bytes ``starts`` to ``ends`` of ``data``; ``first`` is each text's first word, and a last
    number their count."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray):
        self.data, self.starts, self.ends, self.first, self.hashes = data, starts, ends, first, hashes

    @property
    def numbers(self) -> np.ndarray:
        order = np.argsort(self.hashes)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(first_of_runs(self.hashes[order])) - 1
        return out

    def joined(self, words: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of these words with one space between: text k has words bounds[k] to
        bounds[k + 1]."""
        sizes = self.ends[words] - self.starts[words]
        last = np.zeros(len(words), np.bool_)
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        wide = sizes + ~last
        ends = np.cumsum(wide)
        # Each word with the byte behind it, which becomes the space.
        step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
        if len(words):
            step[0] = self.starts[words[0]]
            step[ends[:-1]] = self.starts[words[1:]] - (self.starts[words[:-1]] + wide[:-1] - 1)
        out = self.data.take(np.cumsum(step), mode="clip")
        out[(ends - 1)[~last]] = 32
        offsets = np.append(0, ends)[bounds].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


class PlainWords:
    """Words of many texts, unchanged: runs of bytes other than white space, hashed in 64 bits."""

    LONG = 256

    def __init__(self, seed: int = 11):
        self.hasher = RangeHasher(byte_numbers(seed))

    def of(self, texts: pa.Array) -> Found:
        import xxhash

        data, offsets = text_bytes(texts)
        word = (data != 32) & ((data < 9) | (data > 13))
        edge = word.copy()
        edge[1:] ^= word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        inner = np.unique(inner[word[inner] & word[inner - 1]])
        at = np.nonzero(edge)[0]
        if len(at) % 2:
            at = np.append(at, len(data))
        starts, ends = at[::2], at[1::2]
        if len(inner):
            starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
        hashes = self.hasher.hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        for i in np.nonzero(ends - starts > self.LONG)[0].tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), len(self.hasher.letter))
        return Found(data, starts, ends, np.searchsorted(starts, offsets), hashes)
