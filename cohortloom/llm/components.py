"""Connected components of a graph in a table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _mark(edges: DataFrame) -> tuple:
    """The number of rows and 128 bits that tell one set of edges from another."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): its component's smallest node.

    Each round links neighbours to the smallest node that is known around them; a node's
    neighbours are only ever reduced to their minimum, never gathered. Rounds grow with the
    logarithm of the longest path.
    """
    current = save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    known = _mark(current)
    while True:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        following = save(small, "edges")
        discard(current)
        current, before, known = following, known, _mark(following)
        if known == before:
            break
    stars = current.groupBy("a").agg(F.min("b").alias("root"))
    roots = current.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), "root").unionByName(
        roots.join(stars, "a", "left_anti").select(F.col("a").alias("node"), "root")
    )
