"""Density clustering: counts of neighbours and links of clusters, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graph import components
from .neighbours import Side, between, block_pairs, finder, in_blocks, sides, tiles


def _own() -> Column:
    return F.col("a.block") == F.col("b.block")


class _Pair:
    """Near rows of two sides; of one side with itself, each two of them once."""

    def __init__(self, a: Side, b: Side, radius: float) -> None:
        self.a, self.b, self.radius, self._find = a, b, radius, finder(a.x, b.x, radius)

    def near(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j, sure = self._find(rows, cols)
        open_ = np.flatnonzero(~sure)
        sure[open_] = between(self.a.x, self.b.x, i[open_], j[open_]) <= self.radius
        return i[sure], j[sure]

    def of(self, rows: np.ndarray, cols: np.ndarray, own: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near rows and columns of which the row is in ``own`` or the column in ``other``."""
        if self.a is self.b and rows[0] == cols[0]:
            if own[rows].any():
                i, j = self.near(rows, cols)
                yield i[i < j], j[i < j]
            return
        if len(some := rows[own[rows]]):
            yield self.near(some, cols)
        if len(rest := rows[~own[rows]]) and len(some := cols[other[cols]]):
            yield self.near(rest, some)


def _counted(blocks: DataFrame, radius: float, at: list[np.ndarray], most: int) -> DataFrame:
    """(block, counts) of the points' neighbours in other places, up to ``most``: numbers as
    bytes, one or more rows a block. First within blocks, then for points that lack some."""
    kind = np.min_scalar_type(most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sides(batch):
                told = lambda s: np.frombuffer(s.value("counts").as_py(), kind).astype(np.int64) if s.has("counts") else np.zeros(len(s.x), np.int64)
                before = [told(a), told(b)]
                n = [before[0].copy(), before[1].copy() if a is not b else None]
                n[1] = n[0] if a is b else n[1]
                pair = _Pair(a, b, radius)
                for rows, cols in tiles(a, b, radius, at):
                    for i, j in pair.of(rows, cols, n[0] < most, n[1] < most):
                        n[0] += np.bincount(i, minlength=len(n[0]))
                        n[1] += np.bincount(j, minlength=len(n[1]))
                for side, old, now in [(a, before[0], n[0]), (b, before[1], n[1])][: 1 if a is b else 2]:
                    new = np.where(old < most, now - old, 0)
                    if new.any() or a is b:
                        yield pa.RecordBatch.from_arrays([pa.array([side.block]), pa.array([np.minimum(new, most).astype(kind).tobytes()], pa.binary())], ["block", "counts"])

    schema = "block long, counts binary"
    within = stored(block_pairs(blocks, radius, _own()).mapInArrow(counted, schema), "counts")

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = [bool((np.frombuffer(c.as_buffer(), kind) < most).any()) for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(open_, pa.bool_())], ["block", "counts", "open"])

    known = blocks.join(within.mapInArrow(lacking, schema + ", open boolean"), "block")
    if not within.mapInArrow(lacking, schema + ", open boolean").where("open").take(1):
        return within
    across = block_pairs(known, radius, ~_own() & (F.col("a.open") | F.col("b.open"))).mapInArrow(counted, schema)
    return within.unionByName(across)


def _cores(blocks: DataFrame, radius: float, at: list[np.ndarray], least: int) -> DataFrame:
    """(block, core): whether each point has ``least`` points near it, itself included."""
    most = max(least - 1, 0)
    kind = np.min_scalar_type(most)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), kind).astype(np.int64) for c in table.column("counts"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "core": pa.array([(total >= most).tolist()], pa.list_(pa.bool_()))})

    return stored(_counted(blocks, radius, at, most).groupBy("block").applyInArrow(summed, "block long, core array<boolean>"), "cores")


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of those edges u - v that join different trees of ``parent``, no circle among
    them; ``parent`` then has the joined trees, each node pointing to its root."""
    chosen, rest = [], np.arange(len(u))
    while True:
        ru, rv = parent[u[rest]], parent[v[rest]]
        rest, ru, rv = rest[ru != rv], ru[ru != rv], rv[ru != rv]
        if not len(rest):
            return np.concatenate(chosen) if chosen else rest
        # Every greater root hooks on to one smaller root.
        high, first = np.unique(np.maximum(ru, rv), return_index=True)
        parent[high] = np.minimum(ru, rv)[first]
        chosen.append(rest[first])
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _links(blocks: DataFrame, radius: float, at: list[np.ndarray], kind: str, which: Column) -> DataFrame:
    """(a, b, border) of ``blocks`` with core and labels (an array): labels of cores that are
    near each other, as many as it takes to connect them; and, with ``border``, each point that
    is no core with each core near it, of which it has few."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sides(batch):
                core = [s.value("core").values.to_numpy(zero_copy_only=False) for s in (a, b)]
                labels = pa.concat_arrays([a.value("labels").values, b.value("labels").values]).dictionary_encode()
                code = labels.indices.to_numpy().astype(np.int64)
                code = [code[: len(a.x)], code[len(a.x) :]]
                parent = np.arange(len(labels.dictionary))
                pair, out = _Pair(a, b, radius), []
                for rows, cols in tiles(a, b, radius, at):
                    roots = [np.unique(parent[code[s][part][core[s][part]]]) for s, part in enumerate((rows, cols))]
                    apart = len(np.union1d(*roots)) > 1
                    # Of cores of one tree nothing is to be learned; then only others are looked at.
                    wanted = [np.ones(len(c), bool) if apart else ~c for c in core]
                    for i, j in pair.of(rows, cols, *wanted):
                        ci, cj = core[0][i], core[1][j]
                        both = ci & cj
                        u, v = code[0][i[both]], code[1][j[both]]
                        kept = _forest(parent, u, v)
                        out.append((labels.dictionary.take(pa.array(u[kept])), labels.dictionary.take(pa.array(v[kept])), False))
                        out.append((a.ids.take(pa.array(i[~ci & cj])), b.ids.take(pa.array(j[~ci & cj])), True))
                        out.append((b.ids.take(pa.array(j[ci & ~cj])), a.ids.take(pa.array(i[ci & ~cj])), True))
                for x, y, border in out:
                    if len(x):
                        yield pa.RecordBatch.from_arrays([x, y, pa.array([border] * len(x))], ["a", "b", "border"])

    return stored(block_pairs(blocks, radius, which).mapInArrow(linked, f"a {kind}, b {kind}, border boolean"), "links")


def _labelled(blocks: DataFrame, cores: DataFrame, names: DataFrame) -> DataFrame:
    """``blocks`` with core, labels (a core's name or own id), whether there are points that are
    no core (open), and the least and greatest label of cores."""
    light = blocks.join(cores, "block").select("block", F.posexplode(F.arrays_zip("ids", "core")).alias("at", "p")).select("block", "at", "p.ids", "p.core")
    named = light.join(names, F.col("ids") == F.col("id"), "left").withColumn("label", F.coalesce("name", "ids"))
    only = F.when(F.col("core"), F.col("label"))
    told = named.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "label", "core"))).alias("p"), F.min(only).alias("least"), F.max(only).alias("greatest"), F.bool_or(~F.col("core")).alias("open"))
    return blocks.join(told.select("block", F.col("p.core").alias("core"), F.col("p.label").alias("labels"), "open", "least", "greatest"), "block")


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(id, cluster) for ``points`` (id, x): a point with ``least`` others within the radius,
    itself included, is a core; cores that are neighbours share a cluster, named by its
    smallest core; others join the smallest cluster that has a core near them, or are noise
    (null).

    Near pairs are never written: a task that compares two blocks tells a point's count, no
    further than ``least``, and as many links as connect the cores it sees. Blocks are compared
    with themselves first, and the first with all; then only where points lack neighbours, are
    no cores, or clusters are still apart. That is all pairs of blocks where no cluster is
    dense, without more disk.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    kind = points.schema["id"].dataType.simpleString()
    blocks, at = in_blocks(points, radius)
    cores = _cores(blocks, radius, at, least)
    first = blocks.agg(F.min("block")).first()[0]
    near = _own() | (F.col("a.block") == F.lit(first).cast("long"))
    none = points.sparkSession.createDataFrame([], f"id {kind}, name {kind}")
    found = _links(_labelled(blocks, cores, none), radius, at, kind, near)
    edges = lambda f: f.where("NOT border").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    names = stored(components(edges(found)).select(F.col("kmer").alias("id"), F.col("component").alias("name")), "names")
    apart = F.coalesce((F.col("a.least") < F.col("b.greatest")) | (F.col("b.least") < F.col("a.greatest")), F.lit(False))
    border = (F.col("a.open") & F.col("b.least").isNotNull()) | (F.col("b.open") & F.col("a.least").isNotNull())
    labelled = stored(_labelled(blocks, cores, names).drop("x"), "labels")
    if labelled.agg(F.bool_or("open") | (F.min("least") < F.max("greatest"))).first()[0]:
        again = blocks.select("block", "x").join(labelled, "block")
        found = found.unionByName(_links(again, radius, at, kind, ~near & (border | apart)))
        names = components(edges(found)).select(F.col("kmer").alias("id"), F.col("component").alias("name"))
    inner = labelled.select(F.explode(F.arrays_zip("ids", "core")).alias("p")).where("p.core").select(F.col("p.ids").alias("core"))
    if least <= 1:  # then points that are near to nothing are cores, too
        inner = points.select(F.col("id").alias("core"))
    own = inner.join(names, F.col("core") == F.col("id"), "left").select("core", F.coalesce("name", "core").alias("cluster"))
    border = found.where("border").join(own, F.col("b") == F.col("core")).groupBy("a").agg(F.min("cluster").alias("border"))
    return points.join(own, points["id"] == own["core"], "left").join(border, points["id"] == border["a"], "left").select(
        "id", F.coalesce("cluster", "border").alias("cluster")
    )
