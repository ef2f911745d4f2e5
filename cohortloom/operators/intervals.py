"""Intervals: overlap joins by bins, unions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins that an interval may touch before it goes to a level of wider ones.
SPAN = 64


def _levels(a: DataFrame, b: DataFrame) -> list[int]:
    """Widths of bins: twice the length that 95 of 100 intervals stay below, and as long as
    the longest interval touches more than ``SPAN`` of them, ``SPAN`` times as wide."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    row = a.select(length.alias("n")).unionByName(b.select(length.alias("n"))).agg(F.percentile_approx("n", 0.95).alias("p"), F.max("n").alias("m")).first()
    widths = [max(16, 2 * int(row["p"] or 1))]
    while int(row["m"] or 1) > SPAN * widths[-1]:
        widths.append(widths[-1] * SPAN)
    return widths


def _dealt(rows: DataFrame, start: str, end: str, widths: list[int], level: str, of: str, bin_: str) -> DataFrame:
    """``rows`` once for each bin that they touch, on their own level (``of``) and those above."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0))
    own = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        own = F.when(length <= SPAN * widths[i], i).otherwise(own)
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col(level) + 1)
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    placed = rows.withColumn(of, own).withColumn(level, F.explode(F.sequence(F.col(of), F.lit(len(widths) - 1))))
    return placed.withColumn(bin_, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(a: DataFrame, b: DataFrame, closed: bool = False, outer: bool = False, width: int | None = None) -> DataFrame:
    """Pairs of a (chrom, start, end, a_id) and b (chrom, start, end, b_id) that overlap.

    An interval is dealt to the bins that it touches and pairs meet on equal bins; a pair
    that shares several counts in the bin where the later one starts, so nothing has to be
    made distinct. Bins are as wide as the data ask for, or ``width``; much longer intervals
    have levels of wider bins, and a pair meets on the level of the longer one. ``outer``
    keeps rows of a without a partner.
    """
    widths = [width] if width else _levels(a, b)
    left = _dealt(a.select("chrom", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "a_id"), "a_start", "a_end", widths, "level", "a_of", "bin")
    right = _dealt(b.select(F.col("chrom").alias("b_chrom"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "b_id"), "b_start", "b_end", widths, "b_level", "b_of", "b_bin")
    meet = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) if closed else (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    wide = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("level") + 1)
    once = (F.floor(F.greatest("a_start", "b_start") / wide) == F.col("bin")) & (F.col("level") == F.greatest("a_of", "b_of"))
    same = (F.col("chrom") == F.col("b_chrom")) & (F.col("level") == F.col("b_level")) & (F.col("bin") == F.col("b_bin"))
    pairs = left.join(right, same & meet & once)
    pairs = pairs.select("chrom", "a_id", "a_start", "a_end", "b_id", "b_start", "b_end")
    if not outer:
        return pairs
    alone = a.select("chrom", "a_id", F.col("start").alias("a_start"), F.col("end").alias("a_end")).join(pairs.select("a_id").distinct(), "a_id", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def merged(intervals: DataFrame, by: list[str], width: int = 65_536) -> DataFrame:
    """Half-open intervals of each group united where they touch or overlap.

    Intervals of equal start are one from the first step. They are dealt to stretches of
    ``width`` by their start; a stretch gets to know the furthest end of all before it and
    how many islands begin there, from one row a stretch, so no task holds a whole group.
    """
    points = intervals.groupBy(*by, "start").agg(F.max("end").alias("end")).withColumn("_bin", F.floor(F.col("start") / width))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*by, "_bin").orderBy("start")
    ends = points.groupBy(*by, "_bin").agg(F.max("end").alias("_end")).select(*by, "_bin", F.max("_end").over(earlier).alias("_far"))
    before = F.greatest("_far", F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    opened = points.join(ends, [*by, "_bin"]).withColumn("_before", before).withColumn(
        "_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), 1).otherwise(0)
    )
    counts = opened.groupBy(*by, "_bin").agg(F.sum("_new").alias("_n")).select(*by, "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    island = F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_first")
    return opened.join(counts, [*by, "_bin"]).withColumn("_island", island).groupBy(*by, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("_island")


def covered(features: DataFrame, reads: DataFrame, width: int | None = None) -> DataFrame:
    """(a_id, a_start, a_end, covered): how much of each feature (chrom, start, end, a_id) reads
    (b_id) cover; features that no read meets are left out.

    Of reads that start at one place of a feature the longest counts, so a feature has no
    more rows than places; a row covers what reaches beyond all before it.
    """
    pairs = overlap_join(features, reads, width=width)
    at = ["a_id", "a_start", "a_end"]
    clipped = pairs.groupBy(*at, F.greatest("a_start", "b_start").alias("start")).agg(F.max(F.least("a_end", "b_end")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*at).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    adds = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, "start")), F.lit(0))
    return clipped.withColumn("adds", adds).groupBy(*at).agg(F.sum("adds").alias("covered"))


def coverage(features: DataFrame, reads: DataFrame, width: int | None = None) -> DataFrame:
    """Percent of each feature covered by reads, rounded down to hundredths."""
    share = F.try_divide(F.col("covered") * 10000, F.col("a_end") - F.col("a_start"))
    return covered(features, reads, width).select("a_id", (F.floor(share) / 100.0).alias("coverage"))


def window_lookup(alignments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Alignments in a region; one narrower than 1000 is widened by 500 on either side."""
    if end - start < 1000:
        start, end = start - 500, end + 500
    return alignments.where((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))


def splice_ends(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """Exons that end or start exactly where a block does: (a_id, left_exons, right_exons)."""
    left = blocks.join(exons.select("chrom", F.col("end").alias("end"), F.col("exon_id").alias("l")), ["chrom", "end"], "left")
    right = blocks.join(exons.select("chrom", F.col("start").alias("start"), F.col("exon_id").alias("r")), ["chrom", "start"], "left")
    a = left.groupBy("a_id").agg(F.array_sort(F.collect_set("l")).alias("left_exons"))
    b = right.groupBy("a_id").agg(F.array_sort(F.collect_set("r")).alias("right_exons"))
    return a.join(b, "a_id")


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between neighbouring exons of a transcript."""
    order = Window.partitionBy("transcript_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = exons.withColumn("before", before).where(F.col("before") < F.col("start"))
    return gap.select("chrom", "transcript_id", "gene_id", F.col("before").alias("start"), F.col("start").alias("end"))
