"""Exact top-k search by BM25 over inverted indexes with block-max WAND pruning.

Documents are cut into shards of a bounded number of bytes where they lie, without a
shuffle. A shard's index has, for every term, its postings in document order. A query's
pivot parts its terms: those that many documents of the shard have, which rarely decide, and
the rest. For the former every block of neighbouring documents has the greatest impact of
each term, so one product of matrices bounds what a block can owe them, for all queries at
once. The postings of the rest are added up. Only documents whose sum and block bound
together pass the k-th best score so far are opened and scored in full; the rest of a block
is skipped. The k-th best score goes along from shard to shard, first from a few shards to
all others. Collection size, average length and document frequencies are those of all
documents, so the shards' scores merge exactly.

Queries go to the shards in blocks of a bounded number of terms. Scores are compared after
rounding to six decimals, ties by the smaller id. Null and empty texts match nothing and, as
queries, find nothing; repeated rows are found as often as they are there, and a repeated
query counts its words again. Texts of any length are read whole. An empty table of
documents or of queries gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save
from .idcache import ranges
from .words import WordHasher, slices

K1, B = 1.2, 0.75
#: Long queries bound a block loosely, the more so the more documents it has.
BLOCK = 2
#: A term is frequent in a shard if one in so many documents has it; at most so many terms
#: are, and so many impacts are laid out. Both change only the work.
COMMON, DENSE, CELLS = 24, 1024, 6_000_000
#: Terms of the queries that go out together, and one in how many shards is searched first.
BLOCK_TERMS, AHEAD = 1 << 20, 12
RAW = {"lengths": np.int64, "terms": np.int64, "starts": np.int64, "docs": np.int32, "times": np.int32}


def counted(h: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, ...]:
    """Distinct hashes, where each one's postings start, and the postings: owner and count."""
    terms, of = np.unique(h, return_inverse=True)
    key, times = np.unique(of * max(1, owners) + owner, return_counts=True)
    term_of = key // max(1, owners)
    starts = np.searchsorted(term_of, np.arange(len(terms) + 1))
    return terms.view(np.int64), starts, (key - term_of * max(1, owners)).astype(np.int32), times.astype(np.int32)


class Queries:
    """Queries laid out for one shard after another: distinct terms, and weights by query."""

    def __init__(self, offsets: np.ndarray, h: np.ndarray, w: np.ndarray):
        self.terms, self.of = np.unique(h.view(np.uint64), return_inverse=True)
        self.offsets, self.weight = offsets, w
        self.query = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Index:
    """Postings of one shard, with the impacts that global statistics give them."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, times: np.ndarray, mean_length: float):
        self.ids, self.terms, self.starts, self.docs, n = ids, terms.view(np.uint64), starts, docs, len(ids)
        self.impact = times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[docs] / mean_length))
        df = np.diff(starts)
        often = np.nonzero(df * COMMON >= n)[0]
        often = often[np.argsort(-df[often], kind="stable")[: min(DENSE, CELLS // max(1, n))]]
        self.column = np.full(len(terms), -1)
        self.column[often] = np.arange(len(often))
        self.blocks = -(-n // BLOCK)
        self.laid_out = np.zeros((self.blocks * BLOCK, len(often)))  # impacts of frequent terms
        at = ranges(starts[often], df[often])
        self.laid_out[docs[at], np.repeat(np.arange(len(often)), df[often])] = self.impact[at]
        self.block_max = self.laid_out.reshape(self.blocks, BLOCK, -1).max(1)
        self.scored = 0

    def search(self, asked: Queries, k: int, limits: np.ndarray) -> Iterator[tuple[int, list[tuple[float, object]]]]:
        """(query, its k best as (score, id) in order), for queries for which there is any
        that can pass its limit."""
        if not len(self.terms) or not len(asked.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, asked.terms), len(self.terms) - 1)
        here = np.where(self.terms[at] == asked.terms, at, -1)[asked.of]
        column = np.where(here >= 0, self.column[here], -1)
        rare = (here >= 0) & (column < 0)
        df, n = np.diff(self.starts), len(self.ids)
        for low in range(0, len(limits), 512):
            high = min(len(limits), low + 512)
            a, b = asked.offsets[low], asked.offsets[high]
            wide = np.nonzero(column[a:b] >= 0)[0] + a
            cells = (asked.query[wide] - low) * self.laid_out.shape[1] + column[wide]
            weight = np.bincount(cells, asked.weight[wide], (high - low) * self.laid_out.shape[1]).reshape(high - low, -1)
            bounds = weight @ self.block_max.T
            for q in range(low, high):
                a, b = asked.offsets[q], asked.offsets[q + 1]
                own = np.nonzero(rare[a:b])[0] + a
                term = here[own]
                postings = ranges(self.starts[term], df[term])
                score = np.bincount(self.docs[postings], np.repeat(asked.weight[own], df[term]) * self.impact[postings], n)
                # Sums of another order may differ in the last digits.
                most = score + np.repeat(bounds[q - low], BLOCK)[:n]
                found = self._best(np.nonzero(most > max(0.0, limits[q] - 1e-6))[0], score, most, weight[q - low], k, limits[q])
                if found:
                    yield q, found

    def _best(self, open_: np.ndarray, score: np.ndarray, most: np.ndarray, weight: np.ndarray, k: int, limit: float) -> list[tuple[float, object]]:
        """Scores the open documents, those with the highest bounds first."""
        used = np.nonzero(weight)[0]
        docs, scores, step = np.zeros(0, np.int64), np.zeros(0), 4 * k
        if len(open_) > step:
            open_ = open_[np.argsort(-most[open_], kind="stable")]
        while len(open_) and most[open_[: step]].max() > limit - 1e-6:
            part, open_, step = open_[:step], open_[step:], 2 * step
            full = np.round(score[part] + self.laid_out[part][:, used] @ weight[used], 6)
            self.scored += len(part)
            keep = full > max(0.0, limit)
            docs, scores = np.concatenate([docs, part[keep]]), np.concatenate([scores, full[keep]])
            if len(docs) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores, limit = docs[scores >= kth], scores[scores >= kth], max(limit, kth - 1e-5)
        ranked = sorted(zip(scores.tolist(), docs.tolist()), key=lambda x: (-x[0], self.ids[x[1]] is not None, self.ids[x[1]]))
        return [(s, self.ids[d]) for s, d in ranked[:k]]


def build_indexes(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """One row a shard: its ids, lengths and postings, sorted by term and document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make, number = WordHasher(), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        hashes, lengths, size = [], [], 0

        def done() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
            raw = [n, *counted(np.concatenate(hashes), owner, len(n))]
            listed = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                    *[pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(raw, RAW.values())],
                ],
                names=["shard", "ids", *RAW],
            )

        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                h, starts = make.hashes(part.column(1))
                ids.append(part.column(0))
                hashes.append(h)
                lengths.append(np.diff(starts))
                size += part.column(1).nbytes + 8 * part.num_rows
                if size >= shard_bytes:
                    yield done()
                    ids, hashes, lengths, size, number = [], [], [], 0, number + 1
        if ids:
            yield done()

    return docs.mapInArrow(run, f"shard long, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in RAW))


def _weighted(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, float]:
    """(query_id, terms) with each distinct word's hash and weight; the average length."""
    kind = queries.schema["doc_id"].dataType.simpleString()

    def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = WordHasher()
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                h, starts = make.hashes(part.column(1))
                owner = np.repeat(np.arange(part.num_rows), np.diff(starts))
                terms, at, docs, times = counted(h, owner, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(docs)), pa.array(np.repeat(terms, np.diff(at))), pa.array(times.astype(np.int64))],
                    names=["query_id", "h", "n"],
                )

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                lengths = np.frombuffer(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(np.frombuffer(terms, np.int64), [0, 0])),
                        pa.array(np.append(np.diff(np.frombuffer(starts, np.int64)), [len(lengths), lengths.sum()])),
                        pa.array(np.append(np.zeros(len(terms) // 8, np.int32), [1, 2]).astype(np.int32)),
                    ],
                    names=["h", "df", "what"],
                )

    asked = queries.mapInArrow(query_terms, f"query_id {kind}, h long, n long")
    counts = index.select("terms", "starts", "lengths").mapInArrow(term_counts, "h long, df long, what int")
    counts = save(counts.groupBy("h", "what").agg(F.sum("df").alias("df")), "df")
    whole = {r[0]: r[1] for r in counts.where("what > 0").select("what", "df").collect()}  # two numbers
    total, mean_length = whole.get(1, 0), max(1.0, whole.get(2, 0) / max(1, whole.get(1, 0)))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(counts.where("what = 0").select("h", "df"), "h").select("query_id", "h", (F.col("n") * idf).alias("w"))
    each = save(weighted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("terms")), "queries")
    discard(counts)
    return each, mean_length


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, doc_id, score): for every row of ``queries`` the k best of ``docs``.

    Both have ``doc_id`` and ``text``. Work grows with the product of both, as every query
    meets every shard; memory, broadcasts and shuffles don't.
    """
    spark = docs.sparkSession
    index = save(build_indexes(docs.select("doc_id", "text"), shard_bytes), "index")
    asked, mean_length = _weighted(index, queries.select("doc_id", "text"))
    kind, query_kind = docs.schema["doc_id"].dataType.simpleString(), queries.schema["doc_id"].dataType.simpleString()
    out = f"query long, doc_id {kind}, score double"

    def block_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms = rows.column("terms").combine_chunks()
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        return terms.offsets.to_numpy().astype(np.int64), terms.values.field("h").to_numpy(), terms.values.field("w").to_numpy()

    def found_by(shards: DataFrame, block, limits) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, limit = Queries(*block.value), limits.value.copy()
            best: list[list] = [[] for _ in limit]
            doc_type = pa.null()
            for batch in batches:
                doc_type = batch.column(0).type.value_type
                for at in range(batch.num_rows):
                    raw = [np.frombuffer(batch.column(i + 1)[at].as_py(), t) for i, t in enumerate(RAW.values())]
                    made = Index(batch.column(0)[at].as_py(), *raw, mean_length)
                    for q, got in made.search(asked, k, limit):
                        both = best[q] + got
                        both.sort(key=lambda x: (-x[0], x[1] is not None, x[1]))
                        best[q] = both[:k]
                        if len(both) >= k:
                            limit[q] = max(limit[q], best[q][-1][0] - 1e-5)
            rows = [(q, i, s) for q, found in enumerate(best) for s, i in found]
            if not rows:
                return
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, doc_type), pa.array(s, pa.float64())], names=["query", "doc_id", "score"])

        return shards.select("ids", *RAW).mapInArrow(search, out)

    terms = asked.agg(F.sum(F.size("terms"))).collect()[0][0] or 0
    blocks, results = max(1, -(-terms // BLOCK_TERMS)), []
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))
    ahead = F.pmod(F.xxhash64("shard"), F.lit(AHEAD)) == 0
    for number in range(blocks):
        part = save(dealt.where(F.col("block") == number).select(F.monotonically_increasing_id().alias("query"), "query_id", "terms"), "block")
        rows = part.select("query", "terms").toArrow()  # about BLOCK_TERMS terms
        if not rows.num_rows:
            continue
        numbers = rows.column("query").to_numpy()
        block = spark.sparkContext.broadcast(block_of(rows))
        limits = np.zeros(len(numbers))
        first = save(found_by(index.where(ahead), block, spark.sparkContext.broadcast(limits)), "ahead")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        kth = first.withColumn("nth", nth).where(F.col("nth") == k).select("query", "score").toArrow()  # one row a query of the block
        limits[kth.column("query").to_numpy()] = kth.column("score").to_numpy() - 1e-5
        rest = found_by(index.where(~ahead), block, spark.sparkContext.broadcast(limits))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, n) for i, n in enumerate(numbers.tolist())], "query long, _number long")
        named = ranked.join(names, "query").join(part.select(F.col("query").alias("_number"), "query_id"), "_number")
        results.append(save(named.select("query_id", "rank", "doc_id", "score"), "found"))
        discard(first, part)
        block.unpersist()
    if not results:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0.0).alias("score")).where("false")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every
