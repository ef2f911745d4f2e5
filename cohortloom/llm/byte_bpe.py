"""Byte-level BPE, split at boundaries that no token can cross.

A token of the vocabulary is a run of bytes. Two neighbouring bytes that stand together
inside no token can never be merged, so a cut between them is certain: what lies on
either side is encoded on its own and the ids are put one after another. The cuts make
the fragments short. All fragments of a batch that a worker doesn't know yet are merged
side by side, a step of array operations at a time; ids are looked up by hashes of 64 bits.

Null texts count as empty and give no tokens. Repeated rows are encoded like any others;
extra columns are ignored. Texts of any length are taken whole: a fragment without a
certain cut is merged with a heap, in n log n steps. An empty table gives an empty result.
Ties between pairs can't arise: every pair has a rank of its own.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idcache import IdCache
from .merges import byte_letters, merger_of
from .words import RangeHasher, byte_numbers, slices, text_bytes

#: White space as Unicode has it. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"


class ByteBpe:
    """Merges and certain cuts of one vocabulary file; without ``special``, the strings of
    special tokens are plain text."""

    def __init__(self, path: str, special: bool = True):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = file["model"]["vocab"]
        self.token = {i: bytes(map(of_letter.__getitem__, t)) for t, i in vocab.items()}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.merger = merger_of(file["model"])
        self.joined = {(t[i], t[i + 1]) for t in self.token.values() for i in range(len(t) - 1)}
        self.side_by_side = np.zeros((256, 256), np.bool_)
        self.side_by_side[tuple(np.array(sorted(self.joined)).T)] = True
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        for text, i in self.added.items():
            self.token[i] = text.encode()
        if not special:
            self.added = {}
        self.words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )
        spaces = [c.encode() for c in map(chr, range(128, 1 << 16)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
        self.wide_spaces = {c: len(c) for c in spaces}
        top = max(self.token) + 1
        plain = [str(i) for i in range(top)]
        self.names = pa.array(plain + ["," + x for x in plain])
        self.raw = pa.array([self.token.get(i, b"") for i in range(top)], pa.binary())
        self.hasher, self.cache = RangeHasher(byte_numbers(5)), IdCache()

    def cuts(self, word: bytes) -> list[bytes]:
        """``word`` in fragments, cut between bytes that no token has side by side."""
        if self.joined.issuperset(zip(word, word[1:])):
            return [word]
        out, start = [], 0
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in self.joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids. A chunk is split into words, and words
        are cut between bytes that no token has side by side."""
        lengths, owner, special = [], [], []
        for k, raw in enumerate(chunks):
            text = raw.decode()
            if text in self.added:
                special.append(k)
                lengths.append(len(raw))
                owner.append(k)
            elif text.isascii() and text[text[:1] == " " :].isalpha():
                lengths.append(len(raw))
                owner.append(k)
            else:
                words = self.words.findall(text)
                lengths += [len(w.encode()) for w in words]
                owner += [k] * len(words)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        sizes = np.array(lengths, np.int64)
        begin = np.cumsum(sizes) - sizes
        edge = np.zeros(len(data), np.bool_)
        edge[1:] = ~self.side_by_side[data[:-1], data[1:]]
        for k in special:
            at = begin[owner.index(k)]
            edge[at : at + len(chunks[k])] = False
        edge[begin] = True
        starts = np.nonzero(edge)[0]
        counts, ids = self.merger.merge_all(self.first[data], starts)
        of = np.array(owner)[np.searchsorted(begin, starts, "right") - 1]
        total = np.bincount(of, counts, len(chunks)).astype(np.int64)
        if special:
            keep = np.ones(len(ids), np.bool_)
            first = np.cumsum(total) - total
            for k in special:
                ids[first[k]] = self.added[chunks[k].decode()]
                keep[first[k] + 1 : first[k] + total[k]] = False
            ids, total[special] = ids[keep], 1
        return total, ids

    def chunk_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start in texts that lie one after another from ``offsets``. Chunks
        are words with the blank before them and runs of white space; no pre-token crosses
        their borders, and added tokens are chunks of their own."""
        ascii_space = (data == 32) | ((data >= 9) & (data <= 13))
        space, text_start = ascii_space.copy(), np.zeros(len(data) + 1, np.bool_)
        text_start[offsets] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token.encode())
            while at >= 0:
                end = at + len(token.encode())
                if not text_start[at + 1 : end].any():
                    text_start[[at, end]] = True
                    at = raw.find(token.encode(), end)
                else:
                    at = raw.find(token.encode(), at + 1)
        wide = np.zeros(len(data), np.int8)
        for lead in np.nonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))[0] if (data >= 0xC2).any() else ():
            letter = self.wide_spaces.get(raw[lead : lead + 2]) or self.wide_spaces.get(raw[lead : lead + 3])
            if letter:
                space[lead : lead + letter] = True
                wide[lead + letter - 1] = letter
        mark = text_start[:-1].copy()
        before = np.zeros(len(data), np.bool_)
        before[1:] = space[:-1]
        before[text_start[:-1]] = False
        mark |= space & ~before  # a run of white space starts
        word = np.nonzero(before & ~space)[0]  # a word starts behind white space
        last = word - np.maximum(1, wide[word - 1])
        mark[last] = True
        mark[word[data[last] != 32]] = True
        return np.nonzero(mark)[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start and the last one's end."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = self.hasher.hashes(data, starts, ends)
        ids, counts = self.cache.sequence(hashes, lambda at: self.encode_chunks([data[starts[i] : ends[i]].tobytes() for i in at.tolist()]))
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, the ids as text, and the decoded text, of every text."""
        ids, bounds = self.ids(texts)
        if not len(ids):
            return np.zeros(len(texts), np.int64), pa.array([""] * len(texts)), pa.array([""] * len(texts))
        opens = np.zeros(len(ids) + 1, np.bool_)
        opens[bounds] = True
        named = self.names.take(pa.array(np.where(opens[:-1], ids, ids + len(self.names) // 2)))
        return np.diff(bounds), regrouped(named, bounds), regrouped(self.raw.take(pa.array(ids)), bounds)

    def encode(self, text: str) -> tuple[int, str, str]:
        n, ids, decoded = self.encode_texts(pa.array([text], pa.string()))
        return int(n[0]), ids[0].as_py(), decoded[0].as_py()


def regrouped(strings: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds put together; bytes that are no UTF-8 are
    replaced as Python does it."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1][bounds]
    out = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raw = out.view(pa.binary()).to_pylist()
        out = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
    return out


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the ids again.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's
    format, present on every executor. Returns the id column, ``n_tokens``, ``ids``
    (decimal, joined by commas; empty for an empty text) and ``decoded``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                n, ids, decoded = bpe.encode_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), ids, decoded], names=[id_col, "n_tokens", "ids", "decoded"])

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids string, decoded string")
