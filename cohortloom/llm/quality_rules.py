"""Host-level quality rules, in built-in functions only.

Every document is held against a few rules. A host's failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts themselves, and the verdict
on the host is joined back to its documents: on a bad host a document with any failed
rule goes, elsewhere one needs two. Documents that fail no rule stay on any host.

Null texts count as texts without words; a null host is a host of its own.
Repeated rows are judged as they stand, each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def let(value: Column, body) -> Column:
    """Bind a value once: lambdas would work it out again for every element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    The windows' hashes are sorted with their places, so equal ones become neighbours;
    over the places of repeated windows in order, each adds 3 words less its overlap
    with the next.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.slice(w, 3, F.size(w)),
            lambda third, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), third),
        )

    def places(keyed: Column) -> Column:
        pairs = F.zip_with(
            F.slice(keyed, 1, F.size(keyed) - 1),
            F.slice(keyed, 2, F.size(keyed)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(
            F.slice(p, 1, F.size(p) - 1),
            F.slice(p, 2, F.size(p)),
            lambda a, b: F.least(b - a, F.lit(3)),
        )
        return F.aggregate(gaps, F.lit(3), lambda s, x: s + x)

    def count(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(some, let(let(keyed, places), covered)).otherwise(0)

    return F.when(n < 4, 0).otherwise(let(let(words, hashes), count))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The counts that rules look at, one row per document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return (
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")
        )
        .withColumn("words", words_of(text))
        .withColumn("n_words", F.size("words"))
        .select(
            "doc_id",
            "host",
            F.col("n_words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words"), F.col("n_words")).cast("long").alias("n_repeat_words"),
        )
    )


def host_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    bad_rate: float = 0.5,
) -> DataFrame:
    """Judge every document by its own rules and its host's shrunk failure rate.

    ``bad_rate`` is the shrunk share of failing documents above which a host is bad.
    """
    n = F.col("n_words")
    rules = [
        10 * F.col("n_symbols") > F.col("word_chars"),
        5 * F.col("n_repeat_words") > n,
        30 * F.col("n_dup_lines") > n,
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    ]
    failed_rules = sum((F.when(rule, 1).otherwise(0) for rule in rules), F.lit(0))
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    slim = save(
        measures(docs, id_col, text_col, host_col)
        .withColumn("base_failed", base)
        .withColumn("n_rules", failed_rules.cast("int")),
        "quality",
    )
    failing = F.col("base_failed") | (F.col("n_rules") > 0)
    hosts = slim.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.when(failing, 1).otherwise(0)).alias("host_failed")
    )
    # Moments of the hosts' rates give the beta prior; its weight stays within 2 and 1000.
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.var_samp(rate).alias("v"),
    ).select(
        "m",
        F.least(
            F.greatest(F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(2.0)), F.lit(2.0)),
            F.lit(1000.0),
        ).alias("weight"),
    )
    shrunk = (F.col("host_failed") + F.col("weight") * F.col("m")) / (F.col("host_docs") + F.col("weight"))
    verdicts = hosts.join(F.broadcast(prior)).select(  # the prior is one row
        F.col("host").alias("_host"), F.round(shrunk, 9).alias("host_rate")
    )
    allowed = F.when(F.col("host_rate") > bad_rate, 0).otherwise(1)
    return slim.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rate",
        (~F.col("base_failed") & (F.col("n_rules") <= allowed)).alias("kept"),
    )
