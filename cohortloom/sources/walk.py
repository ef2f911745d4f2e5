"""CIGAR and MD strings walked as one, for whole batches of alignments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Walks of pairs of strings that a task remembers; reads of one length share most of them.
KEPT = 50_000

_OPS = re.compile(r"([0-9]+)([MIDNSHP=X])")
_KINDS = pa.array(["mutation", "insertion", "deletion", "clipping"])
_LETTERS = re.compile(r"[0-9]+|[^0-9]+")


def md_events(md: str) -> list[tuple[int, str, int]]:
    """The events of an MD string: (at, letters, length), ``at`` counting letters that are
    matched, changed or deleted before it; deletions start with ^."""
    parts = _LETTERS.findall(md)
    gaps, names = ([x for x in parts if x[0].isdigit() == digits] for digits in (True, False))
    found, at = [], 0
    for gap, name in zip(gaps, names):
        wide = len(name.lstrip("^"))
        found.append((at + int(gap), name, wide))
        at += int(gap) + wide
    return found


def walked(cigar: str, md: str) -> tuple[list[tuple[int, ...]], list[tuple]]:
    """(blocks, signatures) of an alignment from place 0: (t_start, t_end, q_start, q_end) of a
    block; of a signature the number of its kind, those four, what stands before its letters,
    and where these stand in the query."""
    events, first = md_events(md), 0
    t = q = seen = 0
    blocks, found = [], []
    for number, op in _OPS.findall(cigar):
        n = int(number)
        while first < len(events) and events[first][0] < seen:
            first += 1
        if op in "M=X":
            blocks.append((t, t + n, q, q + n))
            for at, name, wide in takewhile(lambda e: e[0] < seen + n, map(events.__getitem__, range(first, len(events)))):
                if not name.startswith("^"):
                    i, j, wide = t + at - seen, q + at - seen, len(name)
                    found.append((0, i, i + wide, j, j + wide, name + ">", j, j + wide))
            t, q, seen = t + n, q + n, seen + n
        elif op == "I":
            found.append((1, t, t + 1, q, q + n, "", q, q + n))
            q += n
        elif op == "D":
            here = takewhile(lambda e: e[0] <= seen, map(events.__getitem__, range(first, len(events))))
            lost = next((name for _, name, _ in here if name.startswith("^")), "")
            found.append((2, t, t + n, q, q + 1, lost, 0, 0))
            t, seen = t + n, seen + n
        elif op == "S":
            found.append((3, t, t + 1, q, q + n, "", q, q + n))
            q += n
        elif op == "N":
            t += n
    return blocks, found


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, as many as ``counts`` says."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _letters(rows: np.ndarray, seq: pa.Array, told: list[str], which: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """For each of ``rows``, told[which] and behind it letters start to end of its sequence."""
    whole = seq.to_pylist() if seq.null_count or not seq.type == pa.string() else None
    if whole is None:
        at = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
        text = np.frombuffer(seq.buffers()[2] or b"", np.uint8)
        heads = "".join(told).encode()
        if not (text[at[0] : at[-1]] >= 128).any() and heads.isascii():
            size = (at[1:] - at[:-1])[rows]
            start, end = np.minimum(start, size), np.minimum(end, size)
            lengths = np.array([len(x) for x in told], np.int64)
            source = np.concatenate([np.frombuffer(heads, np.uint8), text])
            # Two pieces for each, one of what is told and one of the sequence.
            counts = np.stack([lengths[which], end - start], 1)
            begins = np.stack([(np.cumsum(lengths) - lengths)[which], len(heads) + at[:-1][rows] + start], 1)
            data = source[_spread(counts.ravel(), begins.ravel())].tobytes()
            ends = np.concatenate([[0], np.cumsum(counts.sum(1))]).astype(np.int32)
            return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        whole = seq.to_pylist()
    cut = ((whole[r], told[k], i, j) for r, k, i, j in zip(rows.tolist(), which.tolist(), start.tolist(), end.tolist()))
    # Without letters nothing is known of what stands there, but a deletion's letters are told.
    return pa.array([head + s[i:j] if s is not None else head if i == j else None for s, head, i, j in cut], pa.string())


class _Walks:
    """Walks of a task's pairs of strings, one below the other, each gone once."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self._known: dict[tuple[str, str], int] = {}
        self._blocks: list[tuple] = []
        self._found: list[tuple] = []
        self._told: dict[str, int] = {}
        self._sizes: list[tuple[int, int, int, int]] = []
        self._tables: tuple | None = None

    def of(self, cigar: pa.Array, md: pa.Array) -> tuple:
        """For each alignment its first and number of blocks, and of signatures; and both tables."""
        if len(self._known) > KEPT:
            self._clear()
        cigar, md = (x.fill_null("").dictionary_encode() for x in (cigar, md))
        texts = cigar.dictionary.to_pylist(), md.dictionary.to_pylist()
        both = cigar.indices.to_numpy().astype(np.int64) * len(texts[1]) + md.indices.to_numpy()
        pairs, which = np.unique(both, return_inverse=True)
        code = []
        for x in pairs.tolist():
            pair = texts[0][x // len(texts[1])], texts[1][x % len(texts[1])]
            k = self._known.get(pair)
            if k is None:
                k = self._known[pair] = len(self._known)
                blocks, found = walked(*pair)
                self._sizes.append((len(self._blocks), len(blocks), len(self._found), len(found)))
                self._blocks += blocks
                self._found += [(*x[:5], self._told.setdefault(x[5], len(self._told)), *x[6:]) for x in found]
                self._tables = None
            code.append(k)
        if self._tables is None:
            table = lambda rows, n: np.array(rows, np.int64).reshape(-1, n)
            self._tables = table(self._sizes, 4), table(self._blocks, 4), table(self._found, 8), list(self._told)
        sizes, blocks, found, told = self._tables
        return sizes[np.array(code, np.int64)[which]], blocks, found, told


def _of_batch(walks: _Walks, batch: pa.RecordBatch) -> tuple:
    sizes, blocks, found, told = walks.of(batch.column("cigar"), batch.column("md"))
    rows = np.repeat(np.arange(batch.num_rows), sizes[:, 3])
    x = found[_spread(sizes[:, 3], sizes[:, 2])]
    pos = batch.column("pos").take(pa.array(rows))
    columns = [_KINDS.take(pa.array(x[:, 0])), pc.add(pos, x[:, 1]), pc.add(pos, x[:, 2]), pa.array(x[:, 3]), pa.array(x[:, 4])]
    return sizes, blocks, rows, [*columns, _letters(rows, batch.column("seq"), told, x[:, 5], x[:, 6], x[:, 7])]


_NAMES = ["kind", "t_start", "t_end", "q_start", "q_end", "info"]


def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a signature, for ``files.sam_signatures``."""
    walks = _Walks()
    for batch in batches:
        _, _, rows, columns = _of_batch(walks, batch)
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("name").take(at), batch.column("chrom").take(at), *columns], ["name", "chrom", *_NAMES])


def nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row an alignment, for ``files.sam_lines``."""
    walks = _Walks()
    for batch in batches:
        sizes, blocks, _, columns = _of_batch(walks, batch)
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        x = blocks[_spread(sizes[:, 1], sizes[:, 0])]
        pos = batch.column("pos").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes[:, 1])))
        pairs = [pa.StructArray.from_arrays([a, b], ["start", "end"]) for a, b in ((pc.add(pos, x[:, 0]), pc.add(pos, x[:, 1])), (pa.array(x[:, 2]), pa.array(x[:, 3])))]
        lists = [pa.ListArray.from_arrays(ends(sizes[:, 1]), p) for p in pairs]
        found = pa.ListArray.from_arrays(ends(sizes[:, 3]), pa.StructArray.from_arrays(columns, _NAMES))
        own = [batch.column(c) for c in ("name", "chrom", "strand", "match")]
        yield pa.RecordBatch.from_arrays([*own, *lists, batch.column("seq"), batch.column("cigar"), found], ["name", "chrom", "strand", "match", "t_blocks", "q_blocks", "seq", "cigar", "signatures"])
