"""Word n-gram Jaccard join with rare-first prefixes, and its components.

Every text becomes a set of hashed word n-grams; equal sets are one class, told apart by
128 bits. A set's n-grams are put in one order for all sets, rare ones first: n-grams that
make up more than a 2**20th of all have exact enough counts over all documents, the others
come before them by their hash. Sets that are similar enough must share an n-gram of their
prefixes, so only prefixes are shuffled. A pair is looked at where its first common n-gram
can be: what follows that place bounds how much the two can share (length and positional
filter), and a row that no set of its group is short enough for is dropped before any pair
is made. The suffix filter divides the range of hashes evenly and adds up the smaller count
of either part. Pairs that pass it have their intersection counted, once.

What is asked for are components, so a pair inside one component need not be looked at. A
first round links every class to one centre per n-gram, the class with the fewest rarer
n-grams, which joins a large group of near copies in as many pairs as it has members. An
exact round then takes all pairs of different components; in each group, only classes
outside its largest component are paired with others, and not those that have their last
common n-gram before it in common too. No link between components is lost.

Null texts and texts without words have an empty set and are linked with nothing. Repeated
rows share their class. Rows with a null id are linked like others, and have the component
of the smallest id that they reach, or null if there is none. Texts of any length are read
whole. Ties cannot arise: similarity is compared in whole numbers. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, has_rows, release, save
from .components import components
from .words import Shingles, first_of_runs, slices

#: n-grams that are counted at once in a task, and how often one must be among them to count.
COUNTED, LEAST = 1 << 21, 3
#: An n-gram is frequent if it makes up more than one in so many of all.
FREQUENT = 1 << 20
#: Bits of the filter that says which sets are wanted; of fixed size.
FILTER_BITS = 23


def class_of(items: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(items.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection at which sets of these sizes are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def parts(items: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of a power of two of equal ranges, in
    numbers as wide as they need to be; the width comes first."""
    bits = min(14, max(4, len(items).bit_length() - 1))
    counts = np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    wide = 1 if counts.max() < 256 else 4
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def part_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """No more elements than this are common to two sets of these parts."""
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.minimum(x, y).sum())


def common_items(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _read_sets(docs: DataFrame, n: int) -> DataFrame:
    """Saved, of three kinds: (doc_id, n, c1, c2) for every document, its class's parts with
    the first of them in a task, and (gram, times) for n-grams that a task has often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, kept, count = Shingles(n), set(), [], 0
        names = ["doc_id", "n", "c1", "c2", "parts", "gram", "times"]

        def often(id_type: pa.DataType) -> pa.RecordBatch:
            every = np.sort(np.concatenate(kept))
            starts = np.nonzero(first_of_runs(every))[0]
            times = np.diff(np.append(starts, len(every)))
            good = times >= LEAST
            m = int(good.sum())
            empty = [pa.nulls(m, t) for t in (id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, pa.array(every[starts[good]].view(np.int64)), pa.array(times[good])], names=names)

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 1):
                rows = []
                for s in make.sets(part.column(1)):
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    c = class_of(s)
                    rows.append((len(s), *c, None if c in seen else parts(s)))
                    if c not in seen:
                        seen.add(c)
                        kept.append(s)
                        count += len(s)
                sizes, c1, c2, shape = zip(*rows)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _column(sizes, pa.int32()), _column(c1, pa.int64()), _column(c2, pa.int64()), _column(shape, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    names=names,
                )
                if count >= COUNTED:
                    yield often(id_type)
                    kept, count = [], 0
        if kept:
            yield often(id_type)

    return save(docs.mapInArrow(run, f"doc_id {kind}, n int, c1 long, c2 long, parts binary, gram long, times long"), "sets")


def _prefixes(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, c1, c2, n, pos, often): the prefix of every set, once a task."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, (grams, times) = Shingles(n), set(), known.value
        for batch in batches:
            for part in slices(batch, 0):
                made = []
                for s in make.sets(part.column(0)):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    count = np.zeros(len(s), np.int64)
                    if len(grams):
                        at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                        count = np.where(grams[at] == s, times[at], 0)
                    order = np.argsort(count, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
                    made.append((s[order], count[order] > 0, c, len(s)))
                if not made:
                    continue
                wide = [len(x[0]) for x in made]
                each = lambda values: pa.array(np.repeat(np.array(values, np.int64), wide))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x[0] for x in made]).view(np.int64)),
                        each([x[2][0] for x in made]), each([x[2][1] for x in made]),
                        each([x[3] for x in made]).cast(pa.int32()),
                        pa.array(np.concatenate([np.arange(w, dtype=np.int32) for w in wide])),
                        pa.array(np.concatenate([x[1] for x in made])),
                    ],
                    names=["gram", "c1", "c2", "n", "pos", "often"],
                )

    return docs.select("text").mapInArrow(run, "gram long, c1 long, c2 long, n int, pos int, often boolean")


def _needed(percent: int, a, b):
    return F.ceil((percent * (a + b)).cast("double") / (100 + percent))


def _met(prefixes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, pos) of the prefix n-grams that several classes have.

    Frequent n-grams pass as they are; the rest, none of which has many rows, are brought
    together. A row stays only if a set as short as its group's shortest could be similar.
    """
    group = Window.partitionBy("gram")
    shortest = F.greatest(F.col("short"), F.ceil(F.col("n") * (percent / 100.0) - 1e-9))
    rare = (
        prefixes.where("NOT often")
        .withColumn("lo", F.min("c1").over(group)).withColumn("hi", F.max("c1").over(group)).withColumn("short", F.min("n").over(group))
        .where("lo <> hi").where(F.col("n") - F.col("pos") >= _needed(percent, F.col("n"), shortest))
    )
    columns = ["gram", "c1", "c2", "n", "pos"]
    return rare.select(*columns).unionByName(prefixes.where("often").select(*columns)).join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("gram", "node", "n", "pos").distinct()


def _fits(percent: int):
    """Length and positional filter for a pair whose first common n-gram this is."""
    na, nb, pa_, pb = F.col("n"), F.col("c_n"), F.col("pos"), F.col("c_pos")
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & ((100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb))


def _paired(pairs: DataFrame, of: DataFrame, column: str, test, name: str) -> DataFrame:
    """(a, b, good) of the pairs, where ``test`` decides on what ``of`` (node, column) has
    for either node."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [test(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    one = of.select(F.col("node").alias("a"), F.col(column).alias("x"))
    two = of.select(F.col("node").alias("b"), F.col(column).alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return save(both.mapInArrow(check, "a long, b long, good boolean"), name)


def _wanted_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, items): the sets of ``wanted`` (c1, c2, node), saved.

    Texts are read once more; a filter of fixed size keeps back most sets that aren't
    wanted, a join the rest.
    """
    size = 1 << FILTER_BITS

    def row(salt: int, bits: np.ndarray) -> dict:
        return {"salt": pa.array([salt], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.zeros(size, np.bool_)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (size - 1)] = True
        yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId() % 64, np.packbits(bits)))

    def either(table: pa.Table) -> pa.Table:
        return pa.table(row(0, np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])))

    marked = wanted.select("c1").mapInArrow(mark, "salt int, bits binary")
    for _ in range(2):  # 64 rows, then one, of a fixed size
        marked = marked.groupBy("salt").applyInArrow(either, "salt int, bits binary")
    rows = marked.collect()
    bits = docs.sparkSession.sparkContext.broadcast(rows[0][1] if rows else bytes(size // 8))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingles(n), set()
        known = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(np.bool_)
        for batch in batches:
            for part in slices(batch, 0):
                out = []
                for s in make.sets(part.column(0)):
                    if len(s) and (c := class_of(s)) not in seen and known[c[0] & (size - 1)]:
                        seen.add(c)
                        out.append((*c, s.tobytes()))
                if out:
                    c1, c2, items = zip(*out)
                    yield pa.RecordBatch.from_arrays([_column(c1, pa.int64()), _column(c2, pa.int64()), _column(items, pa.binary())], names=["c1", "c2", "items"])

    found = docs.select("text").mapInArrow(sets, "c1 long, c2 long, items binary")
    return save(found.join(wanted, ["c1", "c2"]).select("node", "items").dropDuplicates(["node"]), "items")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Which of ``pairs`` (a, b) are similar enough: the suffix filter, then the sets."""

    def may(x: bytes, y: bytes) -> bool:
        x, y = part_counts(x), part_counts(y)
        return most_common(x, y) >= least_overlap(int(x.sum()), int(y.sum()), percent)

    def similar(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return common_items(x, y) >= least_overlap(len(x), len(y), percent)

    likely = _paired(pairs, classes, "parts", may, "likely")
    good = likely.where("good").select("a", "b")
    ends = good.select(F.col("a").alias("node")).unionByName(good.select(F.col("b").alias("node"))).distinct()
    items = _wanted_sets(docs, classes.join(ends, "node", "left_semi").select("c1", "c2", "node"), n)
    checked = _paired(good, items, "items", similar, "checked")
    discard(likely, items)
    return checked


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """n_shingles and component_id of every row of ``docs`` (doc_id, text).

    ``docs`` is read several times, and should be a table or files.
    """
    docs = docs.select("doc_id", "text")
    read = _read_sets(docs, n)
    members = read.where("n IS NOT NULL")
    total = members.agg(F.sum("n")).collect()[0][0] or 0
    counted = read.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times"))
    table = counted.where(F.col("times") > max(LEAST, total // FREQUENT)).toArrow()  # at most FREQUENT rows
    grams, times = (table.column(c).to_numpy() for c in ("gram", "times"))
    order = np.argsort(grams.view(np.uint64))
    frequent = grams.view(np.uint64)[order], times[order]
    found = members.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.max("parts").alias("parts"))
    classes = save(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    met = save(_met(_prefixes(docs, n, percent, frequent), classes, percent), "met")
    release(docs.sparkSession)
    before = F.lag("gram").over(Window.partitionBy("node").orderBy("pos"))
    rows = save(met.withColumn("before", before), "met")
    discard(met)

    centre = rows.groupBy("gram").agg(F.min(F.struct("pos", F.xxhash64("node").alias("h"), "node", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
    centre = centre.select("gram", *[F.col("c")[k].alias(f"c_{k}") for k in ("node", "n", "pos")])
    pair = [F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")]
    star = save(rows.join(centre, "gram").where((F.col("node") != F.col("c_node")) & _fits(percent)).select(*pair).distinct(), "pairs")
    checked = _linked(docs, classes, star, n, percent)
    roots = save(components(checked.where("good").select("a", "b")), "roots")

    # All pairs that still lie apart. In each group the classes of its largest component
    # are only ever the other end; a pair that has met at the n-gram before is left out.
    now = save(rows.join(roots, "node", "left").select("gram", "node", "n", "pos", "before", F.coalesce("root", "node").alias("root")), "rooted")
    cells = now.groupBy("gram", "root").agg(F.count("*").alias("k"))
    groups = cells.groupBy("gram").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    apart = now.join(groups.select("gram", F.col("top.root").alias("top")), "gram")
    others = apart.where("root <> top").select("gram", *[F.col(c).alias(f"c_{c}") for c in ("node", "n", "pos", "before", "root")])
    once = (F.col("root") == F.col("top")) | (F.col("node") < F.col("c_node"))
    again = F.coalesce(F.col("before") == F.col("c_before"), F.lit(False))
    last = apart.join(others, "gram").where((F.col("root") != F.col("c_root")) & once & ~again & _fits(percent)).select(*pair).distinct()
    last = save(last.join(star, ["a", "b"], "left_anti"), "pairs")
    discard(star, rows, now)
    if has_rows(last):
        more = _linked(docs, classes, last, n, percent)
        links = checked.unionByName(more).where("good").select("a", "b")
        before, roots = roots, save(components(links), "roots")
        discard(before, more)
    discard(checked, last)

    labelled = save(classes.join(roots, "node", "left").select("c1", "c2", "doc_id", F.coalesce("root", "node").alias("root")), "labelled")
    # Saved, so that Spark can split the join of a component with very many classes.
    smallest = save(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    of_class = labelled.join(smallest, "root").select("c1", "c2", "component_id")
    return members.join(of_class, ["c1", "c2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
