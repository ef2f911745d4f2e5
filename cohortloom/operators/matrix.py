"""The matrix: counts per sample and feature, in one long table; absent means 0.

``long`` tables have (sample, grp, kmer, raw_count); ``samples`` tables have one row a
sample (sample, grp), samples without any count included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import reverse_complement


def count_kmers(reads: DataFrame, k: int, least: int = 1, most: int = 4_294_967_295, flip: Column | None = None) -> DataFrame:
    """K-mer counts per sample of ``reads`` (sample, seq), over the letters A, C, G, T.

    ``flip`` marks reads to be read as their reverse complement; k-mers as such stay on
    their strand. Sequences are cut at other letters before any window is taken, so that
    windows are short slices.
    """
    clean = F.explode(F.filter(F.split("seq", "[^ACGT]+"), lambda p: F.length(p) >= k)).alias("piece")
    pieces = reads.select("sample", *([flip.alias("flip")] if flip is not None else []), clean)
    piece = F.when(F.col("flip"), reverse_complement(F.col("piece"))).otherwise(F.col("piece")) if flip is not None else F.col("piece")
    at = F.explode(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("at")
    windows = pieces.select("sample", piece.alias("piece")).select("sample", "piece", at)
    counted = windows.select("sample", F.substring(F.col("piece"), F.col("at"), F.lit(k)).alias("kmer")).groupBy("sample", "kmer").count()
    return counted.where(F.col("count") >= least).select("sample", "kmer", F.least("count", F.lit(most)).alias("raw_count"))


def totals(long: DataFrame, prefix: int) -> DataFrame:
    """Total count, distinct k-mers and distinct prefixes per sample."""
    return long.groupBy("sample").agg(
        F.sum("raw_count").alias("total_count"),
        F.count("*").alias("n_kmers"),
        F.count_distinct(F.substring("kmer", 1, prefix)).alias("n_prefixes"),
    )


def normalised(long: DataFrame, rescale: float) -> DataFrame:
    """``value``: counts per ``rescale`` of the sample's total, which is summed up before it
    is joined: one row a sample."""
    total = long.groupBy("sample").agg(F.sum("raw_count").alias("_total"))
    return long.join(total, "sample").select(*long.columns, (F.col("raw_count") / (F.col("_total") / F.lit(float(rescale)))).alias("value"))


def wide(long: DataFrame, samples: list[str], value: str = "raw_count") -> DataFrame:
    """One row a k-mer, one column a sample; the sample list comes from the header."""
    return long.groupBy("kmer").pivot("sample", samples).agg(F.first(value)).na.fill(0)


def as_arrays(long: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """(kmer, counts): an array in sample order, zeros filled in, by one shuffle."""
    n = samples.count()
    order = samples.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).alias("at"))
    placed = long.join(F.broadcast(order), "sample") if n <= 100_000 else long.join(order, "sample")
    held = placed.groupBy("kmer").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col(value).cast("double")))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return held.select("kmer", every.alias("counts"))


def dump(long: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows in k-mer order, from ``low`` to ``high`` inclusive."""
    if low is not None:
        long = long.where(F.col("kmer") >= low)
    if high is not None:
        long = long.where(F.col("kmer") <= high)
    return long.orderBy("kmer", "sample")


def extract(long: DataFrame, requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts of the requested k-mers (line, kmer) in every sample, 0 where absent."""
    asked = requests.join(samples)  # every request is answered for every sample
    return asked.join(long.select("sample", "kmer", "raw_count"), ["sample", "kmer"], "left").select(
        "line", "kmer", "sample", F.coalesce("raw_count", F.lit(0)).alias("raw_count")
    )


def min_count(long: DataFrame, least: int) -> DataFrame:
    """K-mers whose greatest raw count over samples is at least ``least``."""
    return long.groupBy("kmer").agg(F.max("raw_count").alias("max_count")).where(F.col("max_count") >= least)


def nonzero_fraction(long: DataFrame, n_samples: int, least: float) -> DataFrame:
    share = F.count_if(F.col("raw_count") > 0) / F.lit(n_samples)
    return long.groupBy("kmer").agg(share.alias("fraction")).where(F.col("fraction") >= least)


def entropy(long: DataFrame, value: str = "value") -> DataFrame:
    """Shannon entropy over samples in bits; null for rows that are all zero."""
    total = F.sum(value).over(Window.partitionBy("kmer"))
    p = F.try_divide(F.col(value), total)
    return long.withColumn("p", p).groupBy("kmer").agg(
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")))).alias("entropy")
    )
