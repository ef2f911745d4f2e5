"""Similarity of samples and distances of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

MAP_NODES = 10_000


def discretise(long: DataFrame, n_samples: int, bins: int = 100, least_share: float = 0.1, value: str = "value") -> DataFrame:
    """Bins of the non-zero values of each k-mer that is in enough samples.

    Bin 1 starts at the smallest non-zero value; where all are equal everything is in bin 1.
    """
    row = Window.partitionBy("kmer")
    present = long.where(F.col(value) > 0)
    low, high = F.min(value).over(row), F.max(value).over(row)
    share = F.count("*").over(row) / F.lit(n_samples)
    width = (F.col("high") - F.col("low")) / F.lit(float(bins - 1))
    place = F.when(F.col("high") == F.col("low"), 1).otherwise(F.floor((F.col(value) - F.col("low")) / width) + 1)
    marked = present.withColumn("low", low).withColumn("high", high).withColumn("share", share)
    return marked.where(F.col("share") >= least_share).select("kmer", "sample", "share", place.cast("long").alias("bin"))


def sample_similarity(binned: DataFrame, block: int = 2048) -> DataFrame:
    """Per pair of samples: over their common k-mers, twice the share of samples without
    the k-mer for equal bins, once for neighbouring ones.

    A k-mer's bins are one row; each task compares the columns of its rows and adds up one
    square matrix, of which cells are shuffled. Pairs without any agreement are left out.
    """
    spark = binned.sparkSession
    names = [r[0] for r in binned.select("sample").distinct().orderBy("sample").collect()]  # a matrix header
    place = F.array_position(F.array(*map(F.lit, names)), F.col("sample")).cast("int") - 1 if names else F.lit(0)
    rows = binned.withColumn("at", place).groupBy("kmer").agg(F.max("share").alias("share"), F.collect_list("at").alias("at"), F.collect_list("bin").alias("bin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), np.bool_)
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                share, at, bins = (part.column(i) for i in range(3))
                x = np.full((part.num_rows, len(names)), -9, np.int64)
                line = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                x[line, at.flatten().to_numpy()] = bins.flatten().to_numpy()
                gain = 1 - share.to_numpy()
                for i in range(len(names) - 1):
                    own = np.nonzero(x[:, i] > 0)[0]
                    apart = np.abs(x[own, i + 1 :] - x[own, i : i + 1])
                    total[i, i + 1 :] += ((apart == 0) * 2.0 + (apart == 1)).T @ gain[own]
                    met[i, i + 1 :] |= (apart <= 1).any(0)
        i, j = np.nonzero(met)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    if not names:
        return spark.createDataFrame([], f"s1 {binned.schema['sample'].dataType.simpleString()}, s2 {binned.schema['sample'].dataType.simpleString()}, similarity double")
    cells = rows.select("share", "at", "bin").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("similarity"))
    header = F.array(*map(F.lit, names))
    return cells.select(F.get(header, "i").alias("s1"), F.get(header, "j").alias("s2"), "similarity")


def square_matrix(similar: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, values): the symmetric matrix with a zero diagonal, a row a sample, its values
    in the order of ``samples``."""
    flipped = similar.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "similarity")
    rows = similar.unionByName(flipped).groupBy(F.col("s1").alias("sample")).agg(F.map_from_entries(F.collect_list(F.struct("s2", "similarity"))).alias("of"))
    names = similar.sparkSession.createDataFrame([(n,) for n in samples], "sample string")
    cells = [F.coalesce(F.try_element_at("of", F.lit(n)), F.lit(0.0)) for n in samples]
    return names.join(rows, "sample", "left").select("sample", F.array(*cells).alias("values"))


def _squared_distance(x, y):  # noqa: ANN001, ANN202
    parts = F.zip_with(x, y, lambda a, b: (a - b).cast("double") * (a - b).cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def column_products(rows: DataFrame) -> DataFrame:
    """(i, j, n, si, sj, q, qi, qj) for every two columns i < j of rows (counts): the number
    of rows, both sums, the sum of products and both sums of squares.

    Each task adds up one square matrix; what is shuffled are its cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, None, None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            if batch.num_rows:
                x = flat.reshape(batch.num_rows, -1)
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                product = x.T @ x if product is None else product + x.T @ x
        if n:
            i, j = np.triu_indices(len(total), 1)
            square = np.diag(product)
            yield pa.RecordBatch.from_pydict({
                "i": i.astype(np.int32), "j": j.astype(np.int32), "n": np.full(len(i), n), "si": total[i], "sj": total[j],
                "q": product[i, j], "qi": square[i], "qj": square[j],
            })

    kinds = "i int, j int, n long, si double, sj double, q double, qi double, qj double"
    cells = rows.select(F.col("counts").cast("array<double>")).mapInArrow(run, kinds)
    return cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "q", "qi", "qj")])


def column_correlations(rows: DataFrame) -> DataFrame:
    """Pearson's r of every two columns."""
    n = F.col("n")
    r = F.try_divide(n * F.col("q") - F.col("si") * F.col("sj"), F.sqrt(n * F.col("qi") - F.pow("si", 2)) * F.sqrt(n * F.col("qj") - F.pow("sj", 2)))
    return column_products(rows).select("i", "j", r.alias("r"))


def column_distances(rows: DataFrame) -> DataFrame:
    """Euclidean distances of every two columns."""
    square = F.col("qi") + F.col("qj") - 2 * F.col("q")
    return column_products(rows).select("i", "j", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def nearest_node(nodes: DataFrame, vectors: DataFrame, chunk: int = MAP_NODES) -> DataFrame:
    """The nearest node (node, weights) of each vector, the first among equals to nine digits.

    Nodes travel to the tasks as a matrix, ``chunk`` of them at a time; a map of more goes
    over the vectors once a chunk and keeps the best so far. Products find which nodes are
    near, and differences the distances of those.
    """
    kind, node = vectors.schema["vec_id"].dataType.simpleString(), nodes.schema["node"].dataType
    found = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(None).cast(node).alias("node"), F.lit(None).cast("double").alias("d"))
    names = nodes.select("node").distinct().count()
    for low in range(0, max(names, 1), chunk):
        grid = nodes.orderBy("node").offset(low).limit(chunk).select("node", F.col("weights").cast("array<double>")).collect()  # at most a chunk
        if not grid:
            break
        labels, w = np.array([r[0] for r in grid]), np.array([r[1] for r in grid], float)
        squares = (w * w).sum(1)

        def run(batches: Iterator[pa.RecordBatch], labels=labels, w=w, squares=squares) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    best, d = part.column(2).to_pylist(), part.column(3).to_pylist()
                    own = (x * x).sum(1)[:, None]
                    low_ = own + squares - 2 * x @ w.T
                    near = low_ <= low_.min(1, keepdims=True) + 1e-8 * (own + squares + 1)
                    for i, j in zip(*np.nonzero(near)):
                        new = round(float(np.sqrt(((x[i] - w[j]) ** 2).sum())), 9)
                        if d[i] is None or new < d[i]:
                            best[i], d[i] = labels[j].item(), new
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(best, part.schema.field(2).type), pa.array(d, pa.float64())], names=["vec_id", "v", "node", "d"])

        found = found.mapInArrow(run, f"vec_id {kind}, v array<double>, node {node.simpleString()}, d double")
        if low + chunk < names:
            found = stored(found, "nearest")
    return found.select("vec_id", "node", F.col("d").alias("distance"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """Silhouette of labelled vectors by distances to cluster centres: sums of squares
    give each point's mean squared distance to a cluster without any pair of points."""
    at = vectors.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    sums = at.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    clusters = sums.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n")
    ).select(F.col("label").alias("c_label"), "s", "q", "n")
    v = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z)
    total = F.col("n") * dot(v, v) - 2 * dot(v, F.col("s")) + F.col("q")
    own = F.col("label") == F.col("c_label")
    mean = F.when(own, F.try_divide(total, F.col("n") - 1)).otherwise(total / F.col("n"))
    far = vectors.join(clusters).select("vec_id", "label", own.alias("own"), mean.alias("mean"))  # one row a cluster
    ab = far.groupBy("vec_id", "label").agg(F.max(F.when(F.col("own"), F.col("mean"))).alias("a"), F.min(F.when(~F.col("own"), F.col("mean"))).alias("b"))
    return ab.select("vec_id", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def l2_normalised(long: DataFrame, by: str = "sample", value: str = "raw_count") -> DataFrame:
    norms = long.groupBy(by).agg(F.sqrt(F.sum((F.col(value) * F.col(value)).cast("double"))).alias("_norm"))
    return long.join(norms, by).withColumn("value", F.col(value) / F.col("_norm")).drop("_norm")
