"""Repeated passages removed by a compacted de Bruijn graph of words.

An edge is a window of ``WINDOW`` words, from the node of its first ``WINDOW`` - 1 words to
that of its last. Neighbouring edges of a text whose least n-gram (by hash) stands at the
same place are compacted at once, where they are read: equal windows have equal least
n-grams, so they meet under it. Only pieces whose n-gram occurs twice in the corpus are
looked at further. Equal pieces are one edge with a count and its first place; where
different pieces share an n-gram, their windows are compared one by one.

The edges that occur twice or more make the graph. Two that follow one another are joined
where their common node has one way in and one way out and their first places follow one
another too; so each path is a stretch of one text, its source. The occurrences of a
path's edges that are not their first come together to spans, each with coordinates in
its source. Both stretches of text are read again and their digests compared; if ever two
stretches with equal hashes differ, all is done again with other hashes.

A word goes if it lies in a window whose words also start earlier: in a text of smaller id,
or in the same text. Null ids come before all others; texts of the same id are told apart
by a hash of the text, and repeated rows, of the same id and text, count as one: what one
keeps, the other keeps. Null texts have no words. Texts of any length are read whole. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, has_rows, release, save, shared_folder
from .idcache import ranges
from .words import PlainWords, slices

#: Words of a window, and of the n-grams by which windows meet.
WINDOW, GRAM = 20, 10


def _combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, as far as there are n."""
    out, have, double, size = None, 0, h, 1
    while size <= n:
        if n & size:
            if out is None:
                out, have = double, size
            else:
                keep = len(h) - have - size + 1
                out = _combined(out[:keep], double[have : have + keep])
                have += size
        double = _combined(double[: max(0, len(double) - size)], double[size:])
        size *= 2
    return out


def pieces(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, n-gram) of the runs of windows with the same least n-gram, and
    the hash of the node at every place; words of text k are first[k] to first[k + 1]."""
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        gram, nodes = _grams(hashes, GRAM), _grams(hashes, WINDOW - 1)
    place = np.arange(len(gram), dtype=np.uint64)
    least = gram >> np.uint64(32) << np.uint64(32) | place
    have, wide = 1, WINDOW - GRAM + 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    sizes = np.diff(first)
    windows = ranges(first[:-1], np.maximum(sizes - WINDOW + 1, 0))
    if not len(windows):
        return none, none, none, none, none
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - WINDOW + 1, 0))
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.nonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))[0]
    return text[opens], windows[opens], np.diff(np.append(opens, len(windows))), gram[at[opens]].view(np.int64), nodes.view(np.int64)


def _places(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``d``, by which texts are told apart and ordered, and the text. It is the id where ids
    are unique and none is missing, else the id and a hash of the text (True)."""
    counts = docs.groupBy(F.col(id_col).alias("id")).count()
    shared = has_rows(counts.where("count > 1 OR id IS NULL"))
    d = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t")) if shared else F.col(id_col)
    return docs.select(d.alias("d"), F.col(text_col).alias("text")), shared


def _copies(docs: DataFrame) -> DataFrame:
    """(d) of texts that are the same, byte for byte, as one that comes before."""
    hashed = docs.where("text IS NOT NULL").select("d", F.unhex(F.md5("text")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "h").where("d <> first").select("d").distinct()


def _all_grams(docs: DataFrame, seed: int) -> DataFrame:
    """(gram, d, n): the least n-grams of each text's windows, and of how many pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PlainWords(seed)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = words.of(part.column(1))
                text, _, _, gram, _ = pieces(found.hashes, found.first)
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.nonzero(np.append(True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])))[0] if len(text) else text
                n = np.diff(np.append(new, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(gram[new]), part.column(0).take(pa.array(text[new])), pa.array(n)], names=["gram", "d", "n"])

    return docs.mapInArrow(run, f"gram long, d {docs.schema['d'].dataType.simpleString()}, n long")


PIECE = "array<struct<gram: long, a: long, b: long, start: long, n: long, between: array<long>>>"


def _cut_texts(docs: DataFrame, hits: DataFrame, seed: int) -> DataFrame:
    """(d, n_words, words, copy, parts): each text's words joined by one space, and those of its
    pieces whose n-gram is among its ``hits`` (d, grams, copy), with the nodes between their
    ends. A copy has no pieces: all its windows stand in the text before it."""
    kind = pa.struct([("gram", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("between", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PlainWords(seed)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = words.of(part.column(1))
                text, start, n, gram, nodes = pieces(found.hashes, found.first)
                known = part.column(2)
                owner = np.repeat(np.arange(len(known)), np.diff(known.offsets.to_numpy()))
                wanted = known.flatten().to_numpy()
                if len(owner) and len(text):
                    # Pairs of text and n-gram are told apart by their numbers among all.
                    every, of = np.unique(np.append(wanted, gram), return_inverse=True)
                    keys = np.append(owner, text) * len(every) + of
                    hit = np.isin(keys[len(owner) :], keys[: len(owner)])
                    hit &= ~part.column(3).to_numpy(zero_copy_only=False)[text]
                else:
                    hit = np.zeros(len(text), np.bool_)
                text, start, n, gram = text[hit], start[hit], n[hit], gram[hit]
                inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - 1)), pa.int32()), pa.array(nodes[ranges(start + 1, n - 1)]))
                fields = [pa.array(gram), pa.array(nodes[start]), pa.array(nodes[start + n]), pa.array(start - found.first[text]), pa.array(n), inner]
                rows = pa.StructArray.from_arrays(fields, fields=list(kind))
                parts = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32()), rows)
                plain = found.joined(np.arange(len(found.starts)), found.first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(found.first)), plain, part.column(3), parts], names=["d", "n_words", "words", "copy", "parts"]
                )

    none = F.array().cast("array<long>")
    joined = docs.join(hits, "d", "left").select("d", "text", F.coalesce("grams", none).alias("grams"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(run, f"d {docs.schema['d'].dataType.simpleString()}, n_words long, words string, copy boolean, parts {PIECE}")


def _kept_by_place(texts: DataFrame, shared: bool) -> DataFrame:
    """``texts`` saved; where ``d`` is a plain id, in buckets of it, as the join that made them
    has dealt them, so that the join to come needn't move them again."""
    if shared:
        return save(texts, "texts")
    spark, name = texts.sparkSession, f"texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "d").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(name)
    out.saved_at = path
    return out


def _edges(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, n, sd, ss) of the edges that occur twice or more, with the text and word of their
    source, and the places (a, b, n, d, start) of single windows in pieces of which another
    has the same n-gram. ``found`` has a row for each place of a piece."""
    place = F.min(F.struct("d", "start")).alias("s")
    source = [F.col("s.d").alias("sd"), F.col("s.start").alias("ss")]
    same = found.groupBy("gram", "a", "b", "n").agg(F.count("*").alias("m"), place, F.first("between").alias("between"))
    one = save(same.select("gram", "a", "b", "n", "m", *source, "between"), "pieces")
    kinds = one.groupBy("gram").agg(F.count("*").alias("kinds"))
    counted = save(one.where("m > 1").join(kinds.where("kinds = 1").select("gram"), "gram", "left_semi").select("a", "b", "n", "sd", "ss"), "alone")
    mixed = save(one.join(kinds.where("kinds > 1").select("gram"), "gram", "left_semi").drop("gram"), "mixed")
    discard(one)
    release(found.sparkSession)
    lead = F.concat(F.array("a"), F.col("between"))
    windows = mixed.select(F.concat(lead, F.array("b")).alias("nodes"), "m", "sd", "ss", F.posexplode(lead).alias("i", "a")).select(
        "a", F.element_at("nodes", F.col("i") + 2).alias("b"), F.lit(1).cast("long").alias("n"),
        F.col("sd").alias("d"), (F.col("ss") + F.col("i")).alias("start"), "m",
    )
    single = windows.groupBy("a", "b", "n").agg(F.sum("m").alias("m"), place).where("m > 1").select("a", "b", "n", *source)
    whole = mixed.where("m > 1 AND n > 1").select("a", "b", "n", "sd", "ss")
    edges = save(counted.unionByName(single).unionByName(whole), "edges")
    discard(counted)
    release(found.sparkSession)
    windows = windows.drop("m")
    windows.saved_at = mixed.saved_at
    return edges, windows


def _paths(edges: DataFrame) -> DataFrame:
    """``edges`` with ``path``, the place where its path starts in its source."""
    ways_out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("outs"))
    ways_in = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("ins"))
    plain = ways_out.join(ways_in, "node").where("outs = 1 AND ins = 1").select(F.col("node").alias("a"), F.lit(True).alias("plain"))
    # Along each source text, an edge goes on a path if its first node is plain and the
    # edge before it in the text is the one that comes in there.
    here = edges.join(plain, "a", "left")
    along = Window.partitionBy("sd").orderBy("ss", F.desc("n"))
    goes_on = F.col("plain").isNotNull() & (F.lag("b").over(along) == F.col("a")) & (F.lag(F.col("ss") + F.col("n")).over(along) == F.col("ss"))
    opens = F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("ss"))
    return here.withColumn("path", F.last(opens, True).over(along)).drop("plain")


def _spans(places: DataFrame, paths: DataFrame) -> DataFrame:
    """(d, start, stop, sd, ss): stretches of words that also stand in the source. ``places`` are
    of edges and windows; those that are an edge's first are left out."""
    met = places.join(paths, ["a", "b", "n"]).where("sd <> d OR ss <> start").select(
        "d", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("stop"), "sd", "path", (F.col("ss") - F.col("start")).alias("shift")
    )
    same = Window.partitionBy("d").orderBy("sd", "path", "shift", "start")
    fresh = lambda c: ~F.lag(c).over(same).eqNullSafe(F.col(c))
    # A row joins the one before it on the same path, unless a window between is missing.
    apart = F.lag("stop").over(same) < F.col("start") + WINDOW - 1
    opens = fresh("sd") | fresh("path") | fresh("shift") | apart
    islands = met.withColumn("island", F.sum(opens.cast("long")).over(same))
    return islands.groupBy("d", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("sd").alias("sd"), F.min("shift").alias("shift")).select(
        "d", "start", "stop", "sd", (F.col("start") + F.col("shift")).alias("ss")
    )


MARKED = "n_removed long, kept string, checks array<struct<source: struct<d: {d}, start: long, size: long>, digest: binary>>"


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts without their spans, and digests of the words of spans and their sources."""
    source = F.struct(F.col("sd").alias("d"), F.col("ss").alias("start"), (F.col("stop") - F.col("start")).alias("size"))
    ours = spans.select("d", F.struct(F.lit(True).alias("goes"), "start", source.alias("source")).alias("x"))
    asked = spans.select(source.alias("source")).distinct().select(
        F.col("source.d").alias("d"), F.struct(F.lit(False).alias("goes"), F.col("source.start").alias("start"), "source").alias("x")
    )
    listed = ours.unionByName(asked).groupBy("d").agg(F.collect_list("x").alias("marks"))
    d = texts.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = PlainWords(1)
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                found, marks = words.of(part.column(2)), part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
                flat = marks.flatten()
                goes, start, source = (flat.field(i) for i in range(3))
                size = source.field(2).to_numpy()
                low = found.first[owner] + start.to_numpy()
                high, goes = low + size, goes.to_numpy(zero_copy_only=False)
                data = found.data
                begin, end = found.starts[low].tolist() if len(low) else [], found.ends[high - 1].tolist() if len(low) else []
                digests = pa.array([xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(begin, end)], pa.binary())
                checks = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([source, digests], names=["source", "digest"]))
                gone = np.zeros(len(found.starts) + 1, np.int64)
                np.add.at(gone, low[goes], 1)
                np.add.at(gone, high[goes], -1)
                kept = np.cumsum(gone[:-1]) == 0
                bounds = np.append(0, np.cumsum(kept))[found.first]
                removed = np.diff(found.first) - np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(removed), found.joined(np.nonzero(kept)[0], bounds), checks],
                    names=["d", "n_words", "n_removed", "kept", "checks"],
                )

    none = F.array().cast(listed.schema["marks"].dataType)
    marked = texts.join(listed, "d", "left").select("d", "n_words", "words", F.coalesce("marks", none).alias("marks"))
    return marked.mapInArrow(run, f"d {d}, n_words long, " + MARKED.format(d=d))


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 21) -> DataFrame:
    """The id column, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by
    one space. ``docs`` is read more than once and must give the same rows each time."""
    placed, shared = _places(docs, id_col, text_col)
    copies = _copies(placed).select("d", F.lit(None).cast("long").alias("gram"), F.lit(True).alias("copy"))
    for attempt in itertools.count(seed):
        grams = save(_all_grams(placed, attempt), "grams")
        twice = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
        hits = grams.join(twice, "gram", "left_semi").select("d", "gram", F.lit(False).alias("copy")).unionByName(copies)
        hits = hits.groupBy("d").agg(F.collect_list("gram").alias("grams"), F.max("copy").alias("copy"))
        texts = _kept_by_place(_cut_texts(placed, hits, attempt), shared)
        discard(grams)
        release(docs.sparkSession)
        met = texts.where(F.size("parts") > 0)
        found = met.select("d", F.explode("parts").alias("p")).select("d", "p.*")
        edges, windows = _edges(found)
        places = found.select("a", "b", "n", "d", "start").unionByName(windows)
        paths = save(_paths(edges), "paths")
        spans = save(_spans(places, paths), "spans")
        discard(edges, windows, paths)
        release(docs.sparkSession)
        done = save(_cut(met.select("d", "n_words", "words"), spans), "cut")
        checks = done.select(F.explode("checks").alias("c")).groupBy("c.source").agg((F.min("c.digest") != F.max("c.digest")).alias("differ"))
        wrong = has_rows(checks.where("differ"))
        discard(spans)
        release(docs.sparkSession)
        if not wrong:
            break
        discard(texts, done)
    goes = F.col("copy") & (F.col("n_words") >= WINDOW)
    whole = texts.where(F.size("parts") == 0).select(
        "d", "n_words", F.when(goes, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(goes, "").otherwise(F.col("words")).alias("kept")
    )
    out = whole.unionByName(done.drop("checks"))
    return out.select((F.col("d.id") if shared else F.col("d")).alias(id_col), "n_words", "n_removed", "kept")
