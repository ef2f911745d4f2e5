"""Models: self-organising maps, clustering, forests, and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .density import dbscan  # noqa: F401
from .graph import components
from .reduce import balanced_split
from .similarity import nearest_node

CLASSIFIERS = {
    "forest": lambda: RandomForestClassifier(numTrees=50, seed=1),
    "logistic": lambda: LogisticRegression(maxIter=50),
    "bayes": lambda: NaiveBayes(modelType="gaussian"),
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20), parallelism=4),
    "perceptron": None,  # its layers depend on the data, see ``predicted``
}


def as_features(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def importances(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(feature, importance, rank) of a random forest."""
    model = CLASSIFIERS["forest"]().fit(as_features(rows, column))
    found = model.featureImportances.toArray().tolist()
    out = rows.sparkSession.createDataFrame(list(enumerate(found)), "feature long, importance double")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")) - 1)


def predicted(train: DataFrame, test: DataFrame, kind: str = "forest", column: str = "embedding", hidden: int = 10) -> DataFrame:
    """``test`` with its prediction; both need the same features, and labels from 0 on."""
    rows = as_features(train, column)
    if kind == "perceptron":
        ends = train.agg(F.max(F.size(column)), F.max("label")).first()
        model = MultilayerPerceptronClassifier(layers=[int(ends[0] or 1), hidden, int(ends[1] or 0) + 1], maxIter=100, seed=1).fit(rows)
    else:
        model = CLASSIFIERS[kind]().fit(rows)
    return model.transform(as_features(test, column)).drop("features", "rawPrediction", "probability")


def classifier_zoo(train: DataFrame, test: DataFrame, kinds: list[str] | None = None, column: str = "embedding") -> DataFrame:
    """(kind, accuracy, balanced_accuracy) of each kind of classifier on ``test``."""
    out = None
    for kind in kinds or sorted(CLASSIFIERS):
        one = accuracy(predicted(train, test, kind, column)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def missing_features(model_features: DataFrame, rows: DataFrame) -> DataFrame:
    """Features that a model needs and the rows lack; empty where prediction can go on."""
    return model_features.join(rows.select("kmer").distinct(), "kmer", "left_anti")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy and the mean of the classes' recalls, in percent."""
    hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    recall = rows.groupBy("label").agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return recall.agg(
        (100 * F.sum("hits") / F.sum("n")).alias("accuracy"), (100 * F.avg("recall")).alias("balanced_accuracy")
    )


def kmeans_merged(vectors: DataFrame, k: int, least: int) -> DataFrame:
    """K-means clusters; those with fewer than ``least`` members become one rest, -1."""
    model = KMeans(k=k, seed=1).fit(as_features(vectors))
    found = model.transform(as_features(vectors)).select("vec_id", F.col("prediction").alias("cluster"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))  # a row a cluster
    return found.join(F.broadcast(sizes), "cluster").select("vec_id", F.when(F.col("size") < least, -1).otherwise(F.col("cluster")).alias("cluster"))


def train_som(vectors: DataFrame, width: int, height: int, rounds: int = 10, column: str = "embedding") -> DataFrame:
    """(node, weights): a batch self-organising map, its sums taken by Spark each round.

    Every partition adds up its vectors by best node; what comes back is a node's sum and
    count, of the map's fixed size. The start is the first vectors by id.
    """
    spark, n = vectors.sparkSession, width * height
    first = vectors.orderBy("vec_id").limit(n).select(column).collect()
    weights = np.array([[float(x) for x in r[0]] for r in first])
    weights = np.resize(weights, (n, weights.shape[1]))
    grid = np.array([(i % width, i // width) for i in range(n)], float)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(2)

    def sums(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        total, count = np.zeros_like(weights), np.zeros(n)
        for pdf in batches:
            x = np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, weights.shape[1]))
            best = ((x * x).sum(1)[:, None] - 2 * x @ weights.T + (weights * weights).sum(1)[None]).argmin(1)
            np.add.at(total, best, x)
            count += np.bincount(best, minlength=n)
        yield pd.DataFrame({"node": range(n), "total": list(total), "count": count})

    for r in range(rounds):
        found = vectors.select(column).mapInPandas(sums, "node int, total array<double>, count double")
        rows = found.select("node", "count", F.posexplode("total").alias("i", "x")).groupBy("node", "i").agg(F.sum("x").alias("x"), F.sum("count").alias("c")).collect()
        total, count = np.zeros_like(weights), np.zeros(n)
        for row in rows:
            total[row[0], row[1]], count[row[0]] = row[2], row[3]
        near = np.exp(-apart / (2 * max(0.5, width / 2 * (1 - r / rounds)) ** 2))
        mass = near @ count
        weights = np.where(mass[:, None] > 1e-12, near @ total / np.maximum(mass, 1e-12)[:, None], weights)
    return spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "node int, weights array<double>")


def second_map(cells: DataFrame, width: int, height: int, rounds: int = 6) -> DataFrame:
    """(sample, node, distance): samples on a map of their own, trained on their projections
    ``cells`` (sample, node, total) on a first map; nodes without a cell count as 0."""
    names = [r[0] for r in cells.select("node").distinct().orderBy("node").collect()]  # a map's nodes
    of = F.map_from_entries(F.collect_list(F.struct("node", "total")))
    rows = cells.groupBy("sample").agg(of.alias("of")).select(
        F.col("sample").alias("vec_id"), F.array(*[F.coalesce(F.try_element_at("of", F.lit(n)), F.lit(0.0)) for n in names]).alias("embedding")
    )
    rows = stored(rows, "projections")
    return nearest_node(train_som(rows, width, height, rounds), rows).withColumnRenamed("vec_id", "sample")


def projection(long: DataFrame, bmu: DataFrame, mean: bool = False, value: str = "value") -> DataFrame:
    """Per sample and node the sum of its features' values, or over the node's features."""
    sums = long.join(bmu, "kmer").groupBy("sample", "node").agg(F.sum(value).alias("total"))
    if not mean:
        return sums
    sizes = bmu.groupBy("node").agg(F.count("*").alias("n"))
    return sums.join(sizes, "node").select("sample", "node", (F.col("total") / F.col("n")).alias("total"))


def class_projection(projected: DataFrame, samples: DataFrame) -> DataFrame:
    """(grp, node, mean, low, high) of the totals (sample, node, total) of each group's samples
    (sample, grp); a sample without the node counts as 0."""
    sizes = samples.groupBy("grp").agg(F.count("*").alias("n"))
    there = projected.join(samples.select("sample", "grp"), "sample").groupBy("grp", "node").agg(
        F.sum("total").alias("sum"), F.min("total").alias("low"), F.max("total").alias("high"), F.count("*").alias("k")
    ).join(sizes, "grp")
    lacks = F.col("k") < F.col("n")
    zero = lambda c, f: F.when(lacks, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)).alias(c)
    return there.select("grp", "node", (F.col("sum") / F.col("n")).alias("mean"), zero("low", F.least), zero("high", F.greatest))


def class_report(predicted: DataFrame) -> DataFrame:
    """Support, recall and precision of each label of (label, prediction)."""
    cells = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    rows = cells.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    named = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("named"))
    return rows.join(named, "label", "left").select("label", "support", (F.col("hit") / F.col("support")).alias("recall"), (F.col("hit") / F.col("named")).alias("precision"))


def node_norms(projected: DataFrame) -> DataFrame:
    """``share``: totals (sample, node, total) scaled to the node's least and greatest."""
    ends = projected.groupBy("node").agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    return projected.join(ends, "node").select("sample", "node", F.try_divide(F.col("total") - F.col("lo"), F.col("hi") - F.col("lo")).alias("share"))


def balanced_folds(samples: DataFrame, group: str, key: str, share: float, folds: int) -> DataFrame:
    """A balanced split for each fold, by another hash: (fold, ..., part)."""
    out = None
    for fold in range(folds):
        split = balanced_split(samples, group, key, share, seed=fold).withColumn("fold", F.lit(fold))
        out = split if out is None else out.unionByName(split)
    return out
