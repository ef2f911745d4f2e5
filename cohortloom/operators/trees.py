"""Forests of extremely randomised trees, grown level by level by Spark.

All trees of all forests grow together: a level is three sums over the rows' places in their
trees. What is random, the bag of each tree and the features and cuts that a node tries, is a
crc32 of names and numbers, so a forest is the same however its rows are dealt, and the bag
is known for every row: rows that a tree didn't see vote on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

KEYS = ("forest", "tree", "node")
#: Chances that a row is in a bag no more than 0, 1, 2, ... times, when as many rows are drawn as there are.
BAG = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7)]


def chance(*parts: Column) -> Column:
    """A number from 0 to below 1 by the crc32 of the parts, joined by bars."""
    return F.crc32(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")) / F.lit(float(1 << 32))


def _bag(u: Column) -> Column:
    out = F.when(u < BAG[0], 0)
    for k, upto in enumerate(BAG[1:], 1):
        out = out.when(u < upto, k)
    return out.otherwise(len(BAG))


def grow(rows: DataFrame, forests: dict[str, list[int]], trees: int, tries: int, depth: int, seed: int = 1, bagged: bool = True) -> tuple[DataFrame, DataFrame]:
    """Splits (forest, tree, node, feature, cut, gain) and places (forest, tree, node, id, label,
    bag, weight) of ``rows`` (id, label, x array<double>).

    ``forests`` names forests and the features that each may use. A node tries ``tries``
    of them, with one random cut each, and takes the greatest fall in Gini impurity; classes
    weigh alike in sum. Node 1 is the root, 2n and 2n + 1 are below n.
    """
    spark = rows.sparkSession
    label = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = label.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    weight = label.crossJoin(total).select("label", (F.col("all") / (F.col("classes") * F.col("n"))).alias("_w"))  # a row a class
    named = spark.createDataFrame([(k, v) for k, v in forests.items()], "forest string, features array<int>")
    named = named.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    bag = _bag(chance(F.lit(seed), F.col("forest"), F.col("tree"), F.col("id"))) if bagged else F.lit(1)
    state = rows.join(weight, "label").crossJoin(F.broadcast(named)).select(  # every row is in every tree
        "forest", "tree", F.lit(1).cast("long").alias("node"), "id", "label", F.col("x").cast("array<double>").alias("x"), "features", bag.alias("bag"), "_w"
    )
    state = stored(state.withColumn("weight", F.col("bag") * F.col("_w")).drop("_w"), "trees")
    splits, places, keep = [], [], ["forest", "tree", "node", "id", "label", "bag", "weight"]
    for _ in range(depth):
        tried = F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
        drawn = state.where("bag > 0").withColumn("try", tried)
        pick = F.floor(chance(F.lit(seed), F.col("forest"), F.col("tree"), F.col("node"), F.col("try"), F.lit("f")) * F.size("features")).cast("int")
        drawn = drawn.withColumn("feature", F.get("features", pick)).withColumn("v", F.get("x", F.col("feature")))
        ends = drawn.groupBy(*KEYS, "try", "feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
        place = chance(F.lit(seed), F.col("forest"), F.col("tree"), F.col("node"), F.col("try"), F.lit("c"))
        cuts = ends.select(*KEYS, F.struct("try", "feature", (F.col("low") + place * (F.col("high") - F.col("low"))).alias("cut")).alias("t"))
        offered = cuts.groupBy(*KEYS).agg(F.collect_list("t").alias("offers"))
        met = state.where("bag > 0").join(offered, list(KEYS)).select(*KEYS, "label", "weight", "x", F.explode("offers").alias("t"))
        below = F.get("x", F.col("t.feature")) <= F.col("t.cut")
        sides = met.groupBy(*KEYS, "t", "label").agg(
            F.sum(F.when(below, F.col("weight")).otherwise(0.0)).alias("l"), F.sum(F.when(below, 0.0).otherwise(F.col("weight"))).alias("r")
        )
        square = lambda c: F.sum(c * c) / F.nullif(F.sum(c), F.lit(0.0))
        gains = sides.groupBy(*KEYS, "t").agg((square(F.col("l")) + square(F.col("r")) - square(F.col("l") + F.col("r"))).alias("gain"))
        best = F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("t.try")).alias("less"), F.col("t.feature").alias("feature"), F.col("t.cut").alias("cut")))
        split = gains.groupBy(*KEYS).agg(best.alias("b")).where("b.gain > 0").select(*KEYS, "b.feature", "b.cut", "b.gain")
        split = stored(split, "splits")
        splits.append(split)
        moved = state.join(split.select(*KEYS, "feature", "cut"), list(KEYS), "left")
        moved = stored(moved, "trees")
        dropped(state)
        places.append(moved.where("feature IS NULL").select(*keep))
        further = F.col("node") * 2 + F.when(F.get("x", F.col("feature")) <= F.col("cut"), 0).otherwise(1)
        state = stored(moved.where("feature IS NOT NULL").withColumn("node", further).drop("feature", "cut"), "trees")
        if not split.take(1):
            break
    places.append(state.select(*keep))
    found, at = splits[0], places[0]
    for more in splits[1:]:
        found = found.unionByName(more)
    for more in places[1:]:
        at = at.unionByName(more)
    return found, at


def importances(splits: DataFrame, trees: int) -> DataFrame:
    """(forest, feature, importance): each tree's falls in impurity by feature, as shares of
    all of its falls, averaged over the trees."""
    own = splits.groupBy("forest", "tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = own.groupBy("forest", "tree").agg(F.sum("gain").alias("whole"))
    return own.join(whole, ["forest", "tree"]).groupBy("forest", "feature").agg((F.sum(F.col("gain") / F.col("whole")) / trees).alias("importance"))


def out_of_bag(places: DataFrame) -> DataFrame:
    """(forest, id, label, predicted): the class of the greatest mean share, the first among
    equals, in the leaves of those trees that didn't see the row. Rows that every tree has
    seen are left out."""
    leaf = places.where("bag > 0").groupBy(*KEYS, F.col("label").alias("class")).agg(F.sum("weight").alias("w"))
    whole = leaf.groupBy(*KEYS).agg(F.sum("w").alias("whole"))
    shares = leaf.join(whole, list(KEYS)).select(*KEYS, "class", (F.col("w") / F.col("whole")).alias("share"))
    votes = places.where("bag = 0").join(shares, list(KEYS)).groupBy("forest", "id", "label", "class").agg(F.round(F.sum("share"), 9).alias("votes"))
    best = F.max_by("class", F.struct("votes", (-F.col("class")).alias("less")))
    return votes.groupBy("forest", "id", "label").agg(best.alias("predicted"))


def accuracy_by_features(rows: DataFrame, most: int, trees: int, tries: int, depth: int, seed: int = 1) -> DataFrame:
    """(features, oob_accuracy, n): how well forests of the 2, 3, ... ``most`` most important
    features do on rows out of their bags. Features are ranked by a forest of all of them;
    ``label`` is a number."""
    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    first, _ = grow(rows, {"all": list(range(width))}, trees, tries, depth, seed)
    ranked = importances(first, trees).orderBy(F.desc(F.round("importance", 12)), "feature").limit(most)
    order = [r["feature"] for r in ranked.select("feature").collect()]  # at most ``most``
    if len(order) < 2:
        raise ValueError("fewer than two features tell the classes apart")
    forests = {f"{n:03d}": order[:n] for n in range(2, len(order) + 1)}
    _, places = grow(rows, forests, trees, tries, depth, seed)
    hit = (F.col("label") == F.col("predicted")).cast("double")
    return out_of_bag(places).groupBy(F.col("forest").cast("int").alias("features")).agg(F.avg(hit).alias("oob_accuracy"), F.count("*").alias("n"))
