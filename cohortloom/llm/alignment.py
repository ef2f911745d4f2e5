"""Two tokenizers' tokens of the same bytes, aligned in lockstep.

A is a byte-level BPE, read with a space before the text; B a sentencepiece model, which
puts that space there itself. All texts of a batch go forward together: a vector holds each
text's place in A, another its place in B. In a step every text emits the link of its two
tokens; the one that ends first is passed, and where both end at the same byte there is a
cut and both are passed. Texts that are done leave the vectors. A long text goes as
several lanes, each opened at a byte where tokens of both end, so that the number of steps
doesn't follow the longest text.

How often two ids are linked in the whole corpus is summed up by blocks of texts: a block
knows its distinct pairs, and each link its pair's number. Pairs are counted by shuffling a
block's pairs, and the counts come back to the block, not to each link.

Null and empty texts have no tokens, nor have texts whose bytes one of the tokenizers
changes. Special tokens' strings are plain text. Repeated rows count as often as they
stand; texts of any length are taken whole; links with the highest count of their B id are
all best where several are. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, regrouped
from .common import discard, save
from .idcache import IdCache, ranges
from .words import RangeHasher, byte_numbers, slices, text_bytes

#: A tokens after which a text's next lane is opened at a cut, and bytes of text in a block.
LANE, BLOCK = 256, 1 << 19


class Pieces:
    """A sentencepiece model with byte fallback, asked word by word: no piece has a space
    behind another letter, so a space after another letter is a certain border."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("pieces with a space inside can't be found word by word")
        raw = [
            bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else x.replace("▁", " ").encode()
            for i, x in enumerate(names)
        ]
        self.raw = pa.array(raw, pa.binary())
        self.space = self.model.piece_to_id("▁")
        self.hasher, self.cache = RangeHasher(byte_numbers(6)), IdCache()

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
        found = [x or [self.space] for x in found]
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that each start with the added space, and each text's first."""
        start = data == 32
        start[1:] &= data[:-1] != 32
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.nonzero(start)[0]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = self.hasher.hashes(data, starts, ends)
        ids, counts = self.cache.sequence(hashes, lambda at: self._encode([data[starts[i] : ends[i]].tobytes() for i in at.tolist()]))
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (A token, B token) in order, and cuts, as the last A and the last B token before
    each. Tokens of all texts are numbered through and end at rising bytes; texts start at
    ``a_first`` and ``b_first``, with a last number behind the last token."""
    in_b = np.zeros(int(max(a_ends[-1], b_ends[-1])) + 1 if len(a_ends) else 1, np.bool_)
    in_b[b_ends] = True
    both = np.nonzero(in_b[a_ends])[0]
    opens = both[np.append(True, both[1:] // LANE != both[:-1] // LANE)] + 1 if len(both) else both
    lanes = np.unique(np.append(a_first, opens))
    lanes = lanes[lanes < len(a_ends)]
    i, j = lanes.copy(), np.searchsorted(b_ends, np.where(lanes > 0, a_ends[lanes - 1], -1), "right")
    stop, b_stop = np.append(i[1:], len(a_ends)), np.append(j[1:], len(b_ends))
    room = (stop - i) + (b_stop - j)
    at = np.cumsum(room) - room
    link_a, link_b = np.full(int(room.sum()), -1, np.int64), np.empty(int(room.sum()), np.int64)
    cuts_a, cuts_b = [], []
    while len(i):
        link_a[at], link_b[at] = i, j
        x, y = a_ends[i], b_ends[j]
        cut = x == y
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        i, j, at = i + (x <= y), j + (y <= x), at + 1
        live = i < stop
        if not live.all():
            i, j, at, stop = i[live], j[live], at[live], stop[live]
    used = link_a >= 0
    none = np.zeros(0, np.int64)
    return link_a[used], link_b[used], np.sort(np.concatenate(cuts_a or [none])), np.sort(np.concatenate(cuts_b or [none]))


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path, special=False), Pieces(b_path)
        self.a_size, self.b_size = pc.binary_length(self.a.raw).to_numpy(), pc.binary_length(self.b.raw).to_numpy()
        self.top = max(len(self.a.raw), len(self.b.raw))
        plain = [str(i) for i in range(self.top)]
        self.names = pa.array(plain + [mark + x for mark in ";,|" for x in plain])

    def align(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids of A and B, each text's first token of both, links, cuts as ``lockstep`` has them."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.fill_null(""), "")
        spaced = pc.if_else(pc.greater(pc.binary_length(spaced), 1), spaced, pa.scalar(""))
        data, offsets = text_bytes(spaced)
        (a, a_first), (b, b_first) = self.a.ids(spaced), self.b.ids(data, offsets)
        # Texts whose bytes come out changed lose their tokens.
        changed = np.zeros(len(texts), np.bool_)
        for ids, first, sizes, raw in ((a, a_first, self.a_size, self.a.raw), (b, b_first, self.b_size, self.b.raw)):
            total = np.append(0, np.cumsum(sizes[ids]))[first]
            out = np.frombuffer(raw.take(pa.array(ids)).buffers()[2] or b"", np.uint8)[: total[-1]]
            changed |= np.diff(total) != np.diff(offsets)
            if np.array_equal(total, offsets):
                wrong = np.nonzero(out != data)[0]
                changed[np.searchsorted(offsets, wrong, "right") - 1] = True
            else:
                for k in np.nonzero(~changed)[0].tolist():
                    changed[k] = not np.array_equal(out[total[k] : total[k + 1]], data[offsets[k] : offsets[k + 1]])
        if changed.any():
            a, a_first = _without(a, a_first, changed)
            b, b_first = _without(b, b_first, changed)
        return a, b, a_first, b_first, *lockstep(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_first, b_first)

    def groups(self, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.Array:
        """Each text's groups between cuts: A ids, a bar, B ids; groups with semicolons between."""
        i, j = np.arange(len(a)), np.arange(len(b))
        of_a, of_b = np.searchsorted(cut_a, i), np.searchsorted(cut_b, j)
        a_opens, b_opens = np.append(0, cut_a + 1), np.append(0, cut_b + 1)
        order = np.empty(len(a) + len(b), np.int64)
        kind = np.where(a_opens[of_a] == i, 1, 2)
        kind[a_first[:-1][np.diff(a_first) > 0]] = 0
        order[i + b_opens[of_a]] = a + self.top * kind
        order[j + a_opens[of_b + 1]] = b + self.top * np.where(b_opens[of_b] == j, 3, 2)
        return regrouped(self.names.take(pa.array(order)), a_first + b_first)


def _without(ids: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    left = np.where(gone, 0, counts)
    return ids[ranges(first[:-1], left)], np.append(0, np.cumsum(left))


@functools.lru_cache(maxsize=1)
def _loaded(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block of texts: ``block``, ``docs`` (id, n_a, n_b, n_groups, n_links and
    ``groups``, the ids as in ``a1,a2|b1;a3|b2,b3``), the block's distinct linked ``pairs``
    (A id times 2^32 plus B id), their ``freq``, and for every link of all its texts the
    place of its pair in ``links``. Both files must be present on every executor."""
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, aligner = TaskContext.get().partitionId() << 32, _loaded(a_path, b_path)
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                a, b, a_first, b_first, link_a, link_b, cut_a, cut_b = aligner.align(part.column(1))
                pairs, of, freq = np.unique(a[link_a].astype(np.int64) << 32 | b[link_b], return_inverse=True, return_counts=True)
                n_groups, n_links = (np.diff(np.searchsorted(x, a_first)) for x in (cut_a, link_a))
                fields = [part.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(a_first), np.diff(b_first), n_groups, n_links))]
                fields.append(aligner.groups(a, b, a_first, b_first, cut_a, cut_b))
                rows = pa.StructArray.from_arrays(fields, names=["id", *numbers, "groups"])
                lists = [rows, pa.array(pairs), pa.array(freq.astype(np.int64)), pa.array(of.astype(np.int32).ravel())]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists], names=["block", "docs", "pairs", "freq", "links"])
                block += 1

    struct = ", ".join([f"id: {kind}", *(f"{x}: long" for x in numbers), "groups: string"])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"block long, docs array<struct<{struct}>>, pairs array<long>, freq array<long>, links array<int>"
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus have the pair, and whether that is
    the most that its B id has with any A id."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "freq")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.freq").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    counts = save(counts.withColumn("b", b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_report(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The texts of saved ``blocks`` with ``n_best``, their links whose pair is best for its B
    id, and ``count_sum``, over their links."""
    pairs = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    known = pairs.groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    fields = blocks.schema["docs"].dataType.elementType
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, links, found = (c.slice(k, 1).flatten() for c in batch.columns)
                place, count, best = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                counts, bests = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
                counts[place], bests[place] = count, best
                links = links.to_numpy()
                columns = [rows.field(i) for i in range(len(names))]
                ends = np.append(0, np.cumsum(columns[names.index("n_links")].to_numpy()))
                sums = [np.diff(np.append(0, np.cumsum(x[links]))[ends]) for x in (bests, counts)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], names=[*names, "n_best", "count_sum"])

    none = F.array().cast("array<struct<place: int, count: long, best: boolean>>")
    joined = blocks.select("block", "docs", "links").join(known, "block", "left").select("docs", "links", F.coalesce("known", none).alias("known"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_best long", "count_sum long"])
    return joined.mapInArrow(run, schema)


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id") -> DataFrame:
    """For each text its numbers of tokens, groups and links, the digest of its groups (''
    without tokens), and how its links stand in the whole corpus."""
    digest = lambda d: F.when(d["groups"] == "", "").otherwise(F.sha2(d["groups"], 256))
    kept = ("id", "n_a", "n_b", "n_groups", "n_links")
    slim = F.transform("docs", lambda d: F.struct(*(d[x].alias(x) for x in kept), digest(d).alias("groups_sha256")))
    blocks = save(aligned_blocks(docs, a_path, b_path, id_col).withColumn("docs", slim), "aligned", row_group=16 << 20)
    counts = save(pair_counts(blocks), "pair-best")
    return link_report(blocks, counts).select(F.col("id").alias(id_col), *kept[1:], "n_best", "count_sum", "groups_sha256")
