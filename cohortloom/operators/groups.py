"""Groups of samples: means, tests and ranks, with implicit zeros counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import anova_p, fold_change, normal_p, pooled_t, student_p, welch_df, welch_t
from .running import in_ranges, numbered, running


def group_counts(samples: DataFrame) -> DataFrame:
    ranked = samples.groupBy("grp").count()
    return ranked.select((F.row_number().over(Window.orderBy("grp")) - 1).alias("group_id"), "grp", F.col("count").alias("n_samples"))


def group_sizes(samples: DataFrame) -> list[tuple[str, int]]:
    """(group, samples) in order: a header, as long as there are groups."""
    return sorted((r[0], r[1]) for r in samples.groupBy("grp").count().collect())


def _every_group(kmers: DataFrame, sizes: list[tuple[str, int]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).cast("long").alias("n")) for g, n in sizes]))
    return kmers.select("kmer", each.alias("g")).select("kmer", "g.grp", "g.n")


def group_stats(long: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """(kmer, grp, n, mean, sd): what is there is summed up around its own mean, and absent
    zeros are merged in by their number."""
    there = long.groupBy("kmer", "grp").agg(F.count("*").alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    every = _every_group(long.select("kmer").distinct(), group_sizes(samples)).join(there, ["kmer", "grp"], "left")
    n, k, m = F.col("n"), F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0))
    squares = k * F.coalesce("v", F.lit(0.0)) + m * m * k * (n - k) / n
    return every.select("kmer", "grp", "n", (m * k / n).alias("mean"), F.sqrt(F.try_divide(squares, n - 1)).alias("sd"))


def pairwise(stats: DataFrame) -> DataFrame:
    """Fold change and Welch statistics for every pair of groups g < h."""
    a = stats.select("kmer", *[F.col(c).alias(c + "_a") for c in ("grp", "n", "mean", "sd")])
    b = stats.select("kmer", *[F.col(c).alias(c + "_b") for c in ("grp", "n", "mean", "sd")])
    both = a.join(b, "kmer").where("grp_a < grp_b")
    va, vb = F.col("sd_a") * F.col("sd_a"), F.col("sd_b") * F.col("sd_b")
    return both.select(
        "kmer", "grp_a", "grp_b",
        fold_change(F.col("mean_a"), F.col("mean_b")).alias("fold"),
        welch_t(F.col("mean_a"), va, F.col("n_a"), F.col("mean_b"), vb, F.col("n_b")).alias("t"),
        welch_df(va, F.col("n_a"), vb, F.col("n_b")).alias("df"),
    )


def with_welch_p(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p", student_p(F.col("t"), F.col("df")))


def with_pooled_p(stats: DataFrame) -> DataFrame:
    """Student's t under equal variances for every pair of groups g < h, with its p-value."""
    a = stats.select("kmer", *[F.col(c).alias(c + "_a") for c in ("grp", "n", "mean", "sd")])
    b = stats.select("kmer", *[F.col(c).alias(c + "_b") for c in ("grp", "n", "mean", "sd")])
    va, vb = F.col("sd_a") * F.col("sd_a"), F.col("sd_b") * F.col("sd_b")
    t = pooled_t(F.col("mean_a"), va, F.col("n_a"), F.col("mean_b"), vb, F.col("n_b"))
    both = a.join(b, "kmer").where("grp_a < grp_b").select("kmer", "grp_a", "grp_b", t.alias("t"), (F.col("n_a") + F.col("n_b") - 2).cast("double").alias("df"))
    return both.withColumn("p", student_p(F.col("t"), F.col("df")))


def anova(stats: DataFrame) -> DataFrame:
    """One-way F over all groups, from the groups' means and deviations."""
    per_kmer = Window.partitionBy("kmer")
    grand = F.sum(F.col("n") * F.col("mean")).over(per_kmer) / F.sum("n").over(per_kmer)
    parts = stats.withColumn("grand", grand)
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)) / (F.count("*") - 1)
    within = F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")) / (F.sum("n") - F.count("*"))
    return parts.groupBy("kmer").agg(
        F.try_divide(between, within).alias("f"),
        (F.count("*") - 1).cast("long").alias("df1"),
        (F.sum("n") - F.count("*")).cast("long").alias("df2"),
    )


def with_anova_p(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", anova_p(F.col("f"), F.col("df1"), F.col("df2")))


def tie_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average ranks from 1, equal values sharing theirs: distinct values are counted, their
    counts run up in order, and rows look their value up."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = [F.col(value)]
    upto = running(in_ranges(counts, by, order), by, order, "_n", F.sum, "_upto")
    return rows.join(upto.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("rank")), [*by, value])


def mann_whitney(long: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """U (the greater one) and z with ties and continuity corrected, for every k-mer and
    every two groups (kmer, grp_a, grp_b, u, z).

    Values are counted by group first, absent zeros by their number, so a k-mer and pair
    have at most as many rows as distinct values.
    """
    sizes = group_sizes(samples)
    present = long.where(F.col(value) != 0).groupBy("kmer", "grp", F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    taken = present.groupBy("kmer", "grp").agg(F.sum("c").alias("k"))
    zeros = _every_group(long.select("kmer").distinct(), sizes).join(taken, ["kmer", "grp"], "left").select(
        "kmer", "grp", F.lit(0.0).alias("x"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("c")
    )
    counts = present.unionByName(zeros.where("c > 0"))
    pairs = [(g, h) for g, _ in sizes for h, _ in sizes if g < h]
    own = {g: [F.struct(F.lit(a).alias("grp_a"), F.lit(b).alias("grp_b")) for a, b in pairs if g in (a, b)] for g, _ in sizes}
    of = F.create_map(*[x for g, ps in own.items() if ps for x in (F.lit(g), F.array(*ps))])
    both = counts.select("kmer", "grp", "x", "c", F.explode(of[F.col("grp")]).alias("p")).select("kmer", "grp", "x", "c", "p.grp_a", "p.grp_b")
    dealt = both.groupBy("kmer", "grp_a", "grp_b", "x").agg(
        F.sum(F.when(F.col("grp") == F.col("grp_a"), F.col("c")).otherwise(0)).alias("a"), F.sum("c").alias("peers")
    )
    one = Window.partitionBy("kmer", "grp_a", "grp_b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("peers").over(one) - (F.col("peers") - 1) / 2.0
    sums = dealt.withColumn("rank", rank).groupBy("kmer", "grp_a", "grp_b").agg(
        F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum("a").alias("n1"), F.sum(F.col("peers") - F.col("a")).alias("n2"),
        F.sum(F.col("peers") * (F.col("peers") * F.col("peers") - 1)).alias("ties"),
    )
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = F.col("n1") + F.col("n2")
    sums = sums.withColumn("u", F.greatest(u1, F.col("n1") * F.col("n2") - u1))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2.0 - 0.5, sd)
    return sums.select("kmer", "grp_a", "grp_b", "u", z.alias("z"))


def with_normal_p(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", normal_p(F.col("z")))


def best_rank(scores: DataFrame) -> DataFrame:
    """Per comparison rank by score (high first), then p-value, then k-mer, from 0; the
    least of them over comparisons."""
    ranked = numbered(scores, ["comparison"], [F.desc("score"), F.asc("p"), F.asc("kmer")], "r")
    return ranked.groupBy("kmer").agg((F.min("r") - 1).cast("int").alias("best_rank"))


def _stepped(p_values: DataFrame, order: list[Column]) -> DataFrame:
    """The p-values in ranges of their order, with their place and the family's size."""
    sizes = p_values.groupBy("family").agg(F.count("*").alias("_m"))
    ranges = in_ranges(p_values.withColumn("_one", F.lit(1)), ["family"], order)
    placed = running(ranges, ["family"], order, "_one", F.sum, "_i")
    return placed.join(sizes, "family")


def holm(p_values: DataFrame) -> DataFrame:
    """Step-down: p times the number of those not smaller, never falling, at most 1."""
    order = [F.asc("p"), F.asc("kmer")]
    step = _stepped(p_values, order).withColumn("_adj", F.col("p") * (F.col("_m") - F.col("_i") + 1))
    top = running(step, ["family"], order, "_adj", F.max, "_top")
    return top.select(*p_values.columns, F.least(F.lit(1.0), F.col("_top")).alias("adjusted"))


def benjamini_hochberg(p_values: DataFrame) -> DataFrame:
    """Step-up: from the largest p down, p times the family's size over its place."""
    order = [F.desc("p"), F.desc("kmer")]
    step = _stepped(p_values, order).withColumn("_adj", F.col("p") * F.col("_m") / (F.col("_m") - F.col("_i") + 1))
    low = running(step, ["family"], order, "_adj", F.min, "_low")
    return low.select(*p_values.columns, F.least(F.lit(1.0), F.col("_low")).alias("adjusted"))
