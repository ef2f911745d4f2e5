"""All pairs of vectors within a radius, by distances to pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .running import in_ranges, running

#: Vectors of a block; a task compares two blocks at once, tile by tile.
BLOCK, TILE = 8192, 1024
#: Partitions of blocks at most; the tasks are as many as pairs of them.
SPLITS = 128


def _packed(x: np.ndarray) -> bytes:
    """Rows of floats, in four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else np.ascontiguousarray(x, np.float64).tobytes()


def _unpacked(data: bytes | pa.Buffer, n: int, dim: int) -> np.ndarray:
    kind = np.float32 if dim and len(data) == 4 * n * dim else np.float64
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def _vectors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The matrix of a batch's rows, which were packed one by one."""
    dims = np.unique(batch.column("dim").to_numpy())
    if len(dims) != 1:
        raise ValueError("the vectors differ in length")
    x = batch.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    ends = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
    if len(np.unique(np.diff(ends))) == 1:
        return _unpacked(x.buffers()[2].slice(ends[0], ends[-1] - ends[0]), len(x), int(dims[0])) if ends[-1] else np.zeros((len(x), 0))
    return np.concatenate([_unpacked(v.as_buffer(), 1, int(dims[0])) for v in x])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows; those with a null, an infinity or no number in them are near to nothing."""
    for batch in batches:
        x = batch.column("x")
        n = pc.list_value_length(x).to_numpy()
        values = x.flatten().to_numpy(zero_copy_only=False)
        whole = np.ones(len(n), bool)
        whole[np.repeat(np.arange(len(n)), n)[~np.isfinite(values)]] = False
        if not whole.any():
            continue
        if len(dims := np.unique(n[whole])) > 1:
            raise ValueError("the vectors differ in length")
        dim, kept = int(dims[0]), batch.filter(pa.array(whole))
        data = _packed(values[np.repeat(whole, n)])
        ends = np.arange(kept.num_rows + 1, dtype=np.int32) * (len(data) // kept.num_rows)
        packed = pa.Array.from_buffers(pa.binary(), kept.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([kept.column("by"), kept.column("id"), pa.array([dim] * kept.num_rows, pa.int32()), packed], ["by", "id", "dim", "x"])


def _apart(x: np.ndarray, y: np.ndarray, mirrored: bool) -> np.ndarray:
    """Euclidean distances, row by row; ``mirrored``, to the nearer of y and -y."""
    length = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
    return np.minimum(length(x - y), length(x + y)) if mirrored else length(x - y)


def between(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, mirrored: bool = False, step: int = 2048) -> np.ndarray:
    """Distances of rows i of x to rows j of y, some rows at a time, which stay in the cache."""
    d = np.empty(len(i))
    for k in range(0, len(i), step):
        d[k : k + step] = _apart(x.take(i[k : k + step], 0), y.take(j[k : k + step], 0), mirrored)
    return d


def _away(x: np.ndarray, at: list[np.ndarray], mirrored: bool) -> np.ndarray:
    """A column for the distances to each of the pivots."""
    return np.stack([_apart(x, p[None], mirrored) for p in at], 1) if at else np.zeros((len(x), 0))


def _pivots(points: DataFrame, count: int, mirrored: bool) -> list[np.ndarray]:
    """The first vector by id, then each time the one furthest from all chosen."""
    first = points.select(F.min_by(F.struct("dim", "x"), "id")).first()[0]
    chosen = [] if first is None else [_unpacked(bytes(first["x"]), 1, first["dim"])[0]]

    def furthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _away(_vectors(batch), chosen, mirrored).min(1) if batch.num_rows else np.zeros(0)
            most = far == far.max(initial=0)
            if far.max(initial=0) > 0:
                kept = batch.filter(pa.array(most)).select(["id", "dim", "x"])
                yield pa.RecordBatch.from_arrays([pa.array(far[most]), *kept.columns], ["d", "id", "dim", "x"])

    kind = points.schema["id"].dataType.simpleString()
    while chosen and len(chosen) < count:
        found = points.mapInArrow(furthest, f"d double, id {kind}, dim int, x binary")
        far = found.select(F.max(F.struct("d", "id", "dim", "x"))).first()[0]
        if far is None:
            break
        chosen.append(_unpacked(bytes(far["x"]), 1, far["dim"])[0])
    return chosen


def in_blocks(points: DataFrame, radius: float, pivots: int = 2, mirrored: bool = False, block: int = BLOCK, by: str | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """``points`` (id, x array<double>) in stored blocks of about ``block`` vectors or fewer, and the pivots.

    Blocks are stretches in order of ``by`` and of the cells of pivot distances, a radius
    wide; within a cell the order is by hash, so any cell falls apart. A block (block, dim,
    ids, x) knows its first and last ``by``, the runs of equal ones (names, ends) and the least
    and greatest distance to each pivot (lo, hi).
    """
    group = F.struct((F.col(by) if by else F.lit(0)).alias("v")).alias("by")
    rows = points.where("x IS NOT NULL").select(group, "id", F.col("x").cast("array<double>").alias("x"))
    own, kind = (rows.schema[c].dataType.simpleString() for c in ("by", "id"))
    rows = stored(rows.mapInArrow(_rows, f"by {own}, id {kind}, dim int, x binary"), "points")
    at = _pivots(rows, pivots, mirrored)
    count = rows.count()
    size = min(block, max(512, -(-count // 16)))
    # A little wider than the radius, so that rounding can't part two cells.
    wide = radius * (1 + 1e-9)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_away(_vectors(batch), at, mirrored) / wide)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.float64()))], [*batch.schema.names, "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = np.linspace(0, table.num_rows, max(1, round(table.num_rows / size)) + 1).astype(int)
            for a, b in zip(ends[:-1], ends[1:]):
                part = table.slice(a, b - a).combine_chunks()
                x = _vectors(part)
                away = _away(x, at, mirrored)
                of = part.column("by").combine_chunks()
                # Only equal values look alike; nulls do, too.
                names = [repr(v["v"]) for v in of.to_pylist()] if by else ["0"] * len(x)
                last = [k for k in range(len(x)) if k + 1 == len(x) or names[k] != names[k + 1]]
                ids = part.column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    of.take(pa.array([0])), of.take(pa.array([len(x) - 1])), pa.array([away.min(0).tolist()], pa.list_(pa.float64())),
                    pa.array([away.max(0).tolist()], pa.list_(pa.float64())), pa.array([[names[k] for k in last]]), pa.array([[k + 1 for k in last]], pa.list_(pa.int32())),
                    pa.array([x.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([_packed(x)], pa.binary()),
                ], ["first", "last", "lo", "hi", "names", "ends", "dim", "ids", "x"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= 4 * size:
                yield from blocks()
        if held:
            yield from blocks()

    order = ["by", "cell", F.xxhash64("id")]
    dealt = rows.mapInArrow(placed, f"by {own}, id {kind}, dim int, x binary, cell array<double>")
    dealt = dealt.repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(cut, f"first {own}, last {own}, lo array<double>, hi array<double>, names array<string>, ends array<int>, dim int, ids array<{kind}>, x binary")
    blocks = stored(made.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    dropped(rows)
    return blocks, at


def block_pairs(blocks: DataFrame, radius: float, more: Column | None = None) -> DataFrame:
    """Rows of structs a and b: any two blocks that may hold near points, each with itself, too.

    A product of partitions of blocks, each read where it is needed: nothing is copied for
    the pairs. ``more`` is a further condition.
    """
    dealt = blocks.repartitionByRange(max(1, min(blocks.count(), SPLITS)), "block")
    a, b = (dealt.select(F.struct("*").alias(n)) for n in "ab")
    wide = F.lit(radius * (1 + 1e-9))
    apart = F.exists(F.arrays_zip(F.col("a.lo").alias("al"), F.col("a.hi").alias("ah"), F.col("b.lo").alias("bl"), F.col("b.hi").alias("bh")),
        lambda p: (p["al"] > p["bh"] + wide + 1e-9 * p["bh"]) | (p["bl"] > p["ah"] + wide + 1e-9 * p["ah"]))
    on = (F.col("a.block") <= F.col("b.block")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last")) & ~apart
    return a.hint("shuffle_replicate_nl").join(b, on if more is None else on & more)


class Side:
    """A block of a pair, as a task sees it."""

    def __init__(self, column: pa.StructArray, row: int) -> None:
        self._column, self._row = column, row
        self.block, dim, self.ids = self.value("block").as_py(), self.value("dim").as_py(), self.value("ids").values
        self.x = _unpacked(self.value("x").as_buffer(), len(self.ids), dim)
        ends = self.value("ends").as_py()
        self.runs = dict(zip(self.value("names").as_py(), zip([0, *ends[:-1]], ends)))

    def has(self, name: str) -> bool:
        return self._column.type.get_field_index(name) >= 0

    def value(self, name: str) -> pa.Scalar:
        return self._column.field(name)[self._row]


def sides(batch: pa.RecordBatch) -> Iterator[tuple[Side, Side]]:
    """The pairs of a batch of ``block_pairs``; of a block with itself, one side twice."""
    for row in range(batch.num_rows):
        a, b = (Side(batch.column(n), row) for n in "ab")
        if a.x.shape[1] != b.x.shape[1]:
            raise ValueError("the vectors differ in length")
        yield a, a if a.block == b.block else b


def tiles(a: Side, b: Side, radius: float, at: list[np.ndarray], mirrored: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of equal ``by`` that may be near; of one block, no two tiles twice."""

    def cut(side: Side, run: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = [np.arange(k, min(k + TILE, run[1])) for k in range(run[0], run[1], TILE)]
        return [(p, w.min(0), w.max(0)) for p in parts for w in [_away(side.x[p], at, mirrored)]]

    for name, run in a.runs.items():
        if name in b.runs:
            own, other = cut(a, run), cut(b, b.runs[name])
            for k, (rows, lo, hi) in enumerate(own):
                for cols, low, high in other[k:] if a is b else other:
                    if (lo <= high * (1 + 1e-9) + radius * (1 + 1e-9)).all() and (low <= hi * (1 + 1e-9) + radius * (1 + 1e-9)).all():
                        yield rows, cols


def finder(x: np.ndarray, y: np.ndarray, radius: float, mirrored: bool = False) -> Callable:
    """A function of rows of x and rows of y: (i, j, sure) of all pairs that may be within
    ``radius``, by one product, and whether rounding leaves no doubt.

    The product is in single precision unless its error, bounded by norms, is large beside the
    radius. Vectors are taken from their middle, but for mirrored ones.
    """
    square, dim = radius * radius, x.shape[1]
    middle = 0.0 if mirrored else (x.sum(0) + y.sum(0)) / (len(x) + len(y))
    u, v = x - middle, y - middle
    uu, vv = (u * u).sum(1, keepdims=True), (v * v).sum(1, keepdims=True)
    most = float(uu.max(initial=0) + vv.max(initial=0))
    doubt = lambda kind: 4 * (dim + 8) * float(np.finfo(kind).eps) * most
    kind = np.float32 if doubt(np.float32) < 0.01 * square and most < 1e30 and square > 1e-30 else np.float64
    if not mirrored:
        u, v = np.hstack([u, uu, np.ones_like(uu)]), np.hstack([-2 * v, np.ones_like(vv), vv])
    u, v, uu, vv, slack = u.astype(kind), v.astype(kind), uu.astype(kind), vv.astype(kind), doubt(kind)

    def found(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = u[rows] @ v[cols].T
        if mirrored:
            low = uu[rows] + vv[cols].T - 2 * np.abs(low)
        at = np.flatnonzero(low <= kind(square + slack))
        i, j = np.divmod(at, max(1, len(cols)))
        return rows[i], cols[j], low.ravel()[at] < kind(square - slack)

    return found


def radius_join(points: DataFrame, radius: float, pivots: int = 2, mirrored: bool = False, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(a, b, distance) for all pairs of ``points`` (id, x array<double>) with a < b that are
    at most ``radius`` apart. With ``mirrored``, x and -x count as the same point; with ``by``,
    only points that are equal in that column meet, nulls with nulls.

    By the triangle inequality such a pair's distances to any pivot differ by no more than
    the radius. So points are ordered by cells of pivot distances and cut to blocks, and two
    blocks, or two tiles of them, meet only if their ranges of distances do. Tiles are compared
    by one matrix product; what passes is computed again by differences. No pair comes up
    twice, a cell with most points takes many tasks, and a vector is stored once and read by
    each task that needs it. Null vectors are near to nothing; repeated ids are an error of
    the caller's.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    blocks, at = in_blocks(points, radius, pivots, mirrored, block, by)
    kind = points.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sides(batch):
                found = finder(a.x, b.x, radius, mirrored)
                for rows, cols in tiles(a, b, radius, at, mirrored):
                    i, j, _ = found(rows, cols)
                    if a is b and rows[0] == cols[0]:
                        i, j = i[i < j], j[i < j]
                    d = between(a.x, b.x, i, j, mirrored)
                    i, j, d = i[d <= radius], j[d <= radius], d[d <= radius]
                    if len(d):
                        yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(d)], ["a", "b", "distance"])

    met = block_pairs(blocks, radius).mapInArrow(compare, f"a {kind}, b {kind}, distance double")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def correlated_pairs(rows: DataFrame, least: float, signed: bool = False, by: str | None = None) -> DataFrame:
    """(a, b, r) of rows (id, x) whose Pearson correlation is ``least`` (above 0) or more
    either way, r being its absolute value, or if ``signed``, that far above 0 only. Constant
    rows correlate with nothing. With ``by``, rows meet within that column only.

    Centred rows of length 1 are sqrt(2 - 2 r) apart; mirrored ones have the other sign.
    """
    n = F.size("x")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x = F.col("x").cast("array<double>")
    own = ["id", *([by] if by else [])]
    centred = rows.select(*own, F.transform(x, lambda v: v - total(x) / n).alias("x"))
    length = F.sqrt(total(F.transform("x", lambda v: v * v)))
    unit = centred.withColumn("length", length).where("length > 0").select(*own, F.transform("x", lambda v: v / F.col("length")).alias("x"))
    found = radius_join(unit, float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6, mirrored=not signed, by=by)
    return found.select("a", "b", (1 - F.col("distance") * F.col("distance") / 2).alias("r")).where(F.col("r") >= least - 1e-12)


def reduce_correlated(rows: DataFrame, target: Column, least: float) -> DataFrame:
    """(id, target_r, kept, follows) for rows (id, x): of two that correlate by ``least`` or more
    the one that is less correlated with ``target`` goes, in a tie the one of smaller id.

    Pairs are gone through in order of (smaller id, greater id); a loser then follows what the
    winner follows at that time, itself at first. Each defeat therefore points to the
    winner's last defeat before it, and the ends of these pointers are found by doubling.
    """
    from .graph import pearson  # here, as it imports this module

    own = F.coalesce(F.abs(pearson(F.col("x").cast("array<double>"), target)), F.lit(0.0))
    scored = stored(rows.select("id", own.alias("target_r")), "target")
    side = lambda n: scored.select(F.col("id").alias(n), F.col("target_r").alias("r" + n))
    # Correlations that differ in the last digits only are ties.
    ra, rb = F.round("ra", 12), F.round("rb", 12)
    met = correlated_pairs(rows, least).join(side("a"), "a").join(side("b"), "b").select(
        F.struct("a", "b").alias("event"), F.when(ra > rb, F.col("b")).otherwise(F.col("a")).alias("loser"),
        F.when(ra > rb, F.col("a")).otherwise(F.col("b")).alias("winner"),
    )
    met = stored(met, "defeats")
    # The last defeat of the winner before each event, by the two together in order.
    beaten = met.select(F.col("loser").alias("who"), "event", F.col("event").alias("lost"), F.lit(None).cast(met.schema["loser"].dataType).alias("loser"))
    won = met.select(F.col("winner").alias("who"), "event", F.lit(None).cast(met.schema["event"].dataType).alias("lost"), "loser")



    ordered = in_ranges(beaten.unionByName(won), ["who"], [F.col("event"), F.col("loser").isNull()])
    last = running(ordered, ["who"], [F.col("event"), F.col("loser").isNull()], "lost", F.max, "last").where("loser IS NOT NULL")
    known = stored(last.select("event", F.col("who").alias("follows"), F.col("last").alias("before")), "chain")
    while known.where("before IS NOT NULL").take(1):
        ahead = known.select(F.col("event").alias("before"), F.col("follows").alias("further"), F.col("before").alias("next"))
        moved = known.join(ahead, "before", "left")
        known = stored(moved.select("event", F.coalesce("further", "follows").alias("follows"), F.col("next").alias("before")), "chain")
    final = met.groupBy("loser").agg(F.max("event").alias("event")).join(known, "event").select(F.col("loser").alias("id"), "follows")
    return scored.join(final, "id", "left").select("id", "target_r", F.col("follows").isNull().alias("kept"), F.coalesce("follows", "id").alias("follows"))
