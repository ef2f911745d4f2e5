"""Browsing: conjunctive filters, ordering, pages, facets and contingency tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@dataclass
class Request:
    """What a table view asks for; 0, empty and None switch a filter off."""

    search: str = ""
    subset: list[str] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    least_count: float = 0
    least_score: float = 0
    least_fold: float = 0
    most_p: float = 0
    order: str = "best_rank"
    ascending: bool = True
    page_size: int = 50
    page: int = 0


def filtered(rows: DataFrame, request: Request) -> DataFrame:
    """Rows (kmer, values, ...) that pass every filter of the request.

    Optional columns: bmu, fold and p_values (rows without them pass), counts, events.
    """
    r, has = request, set(rows.columns)
    if r.nodes and "bmu" in has:
        rows = rows.where(F.col("bmu").isin(r.nodes))
    if r.least_score:
        rows = rows.where(F.exists("values", lambda v: v >= r.least_score))
    if r.least_fold and "fold" in has:
        rows = rows.where(F.col("fold").isNull() | F.exists("fold", lambda v: F.abs(v) >= r.least_fold))
    if r.most_p and "p_values" in has:
        rows = rows.where(F.col("p_values").isNull() | F.exists("p_values", lambda v: v <= r.most_p))
    if r.subset:
        rows = rows.where(F.col("kmer").isin(r.subset))
    if r.least_count and "counts" in has:
        rows = rows.where(F.exists("counts", lambda v: v >= r.least_count))
    if r.events and "events" in has:
        rows = rows.where(F.arrays_overlap("events", F.array(*map(F.lit, r.events))))
    if len(r.search) >= 2:
        rows = rows.where(F.contains(F.to_json(F.struct("*")), F.lit(r.search)))
    return rows


def ordered(rows: DataFrame, request: Request) -> DataFrame:
    """By the asked column, k-mers telling equals apart; ``values_1`` is a place in an array.
    Nulls and numbers that aren't finite, as folds of an empty group, come last either way."""
    name, _, place = request.order.rpartition("_")
    key = F.get(name, F.lit(int(place))) if place.isdigit() and name in rows.columns else F.col(request.order)
    if rows.select(key.alias("k")).schema["k"].dataType.simpleString() in ("double", "float"):
        key = F.when(F.isnan(key) | (F.abs(key) == float("inf")), None).otherwise(key)
    key = key.asc_nulls_last() if request.ascending else key.desc_nulls_last()
    return rows.orderBy(key, F.asc("kmer"))


def page(rows: DataFrame, request: Request) -> DataFrame:
    return ordered(filtered(rows, request), request).offset(request.page * request.page_size).limit(request.page_size)


def page_totals(rows: DataFrame, request: Request) -> DataFrame:
    """(records_total, records_filtered)."""
    kept = filtered(rows, request).agg(F.count("*").alias("records_filtered"))
    return rows.agg(F.count("*").alias("records_total")).join(kept)


def facets(rows: DataFrame, request: Request, column: str) -> DataFrame:
    """For each value of an array column: k-mers that the filters keep and that they hide."""
    kept = filtered(rows, request).select("kmer").withColumn("_in", F.lit(True))
    each = rows.select("kmer", F.explode(F.array_distinct(column)).alias("facet")).join(kept, "kmer", "left")
    return each.groupBy("facet").agg(
        F.count_if(F.col("_in").isNotNull()).alias("visible"), F.count_if(F.col("_in").isNull()).alias("hidden")
    )


def tag_facets(samples: DataFrame) -> DataFrame:
    """Counts per tag key and per key and value, from a map column ``metadata``."""
    tags = samples.select(F.explode("metadata").alias("key", "value"))
    return tags.groupingSets([["key"], ["key", "value"]], "key", "value").agg(F.count("*").alias("n"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns with their row, column and grand totals (null: all)."""
    return rows.cube(a, b).agg(F.count("*").alias("n"))


def sample_filter(samples: DataFrame, search: str = "", keys: list[str] = (), tags: dict[str, str] | None = None, k: list[int] = ()) -> DataFrame:
    if len(search) > 2:
        samples = samples.where(F.contains(F.to_json(F.struct("*")), F.lit(search)))
    if keys:
        samples = samples.where(F.arrays_overlap(F.map_keys("metadata"), F.array(*map(F.lit, keys))))
    for key, value in (tags or {}).items():
        samples = samples.where(F.col("metadata")[key] == value)
    return samples.where(F.col("k_len").isin(list(k))) if k else samples


def page_of(rows: DataFrame, order: str, ascending: bool, page_: int, size: int, key: str) -> DataFrame:
    """A page of any table, ordered by one column, nulls last, and by ``key`` among equals."""
    first = F.asc_nulls_last(order) if ascending else F.desc_nulls_last(order)
    return rows.orderBy(first, F.asc(key)).offset(page_ * size).limit(size)


def matrix_filter(matrices: DataFrame, search: str) -> DataFrame:
    """Rows that hold the searched text anywhere, as JSON; shorter than three letters finds all."""
    return matrices.where(F.contains(F.to_json(F.struct("*")), F.lit(search))) if len(search) > 2 else matrices


def map_filter(rows: DataFrame, samples: list[str] = (), nodes: list[int] = (), classes: list[str] = ()) -> DataFrame:
    """Rows (sample, node, class, ...) of a map's display that are asked for in every list;
    an empty list asks for all."""
    for column, asked in (("sample", samples), ("node", nodes), ("class", classes)):
        if asked:
            rows = rows.where(F.col(column).isin(list(asked)))
    return rows


def registry_stats(samples: DataFrame, visible: DataFrame, key: str = "name") -> DataFrame:
    """(kind, key, value, n) of the samples (name, metadata, k_len): how many of the visible
    ones have each k, each tag, each value of a tag, and, as value ``None``, lack the tag."""
    shown = samples.join(visible.select(key).withColumn("_v", F.lit(1)), key, "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    none = F.lit(None).cast("string")
    by_k = shown.groupBy(F.col("k_len").cast("string").alias("value")).agg(F.sum("_v").alias("n")).select(F.lit("k_len").alias("kind"), none.alias("key"), "value", "n")
    tags = shown.select("_v", F.explode("metadata").alias("key", "value")).groupBy("key", "value").agg(F.sum("_v").alias("n"))
    by_tag = tags.groupBy("key").agg(F.sum("n").alias("n"))
    whole = shown.agg(F.sum("_v").alias("all"))  # one row
    rest = by_tag.crossJoin(whole).select(F.lit("value").alias("kind"), "key", F.lit("None").alias("value"), (F.col("all") - F.col("n")).alias("n"))
    return (
        by_k.unionByName(by_tag.select(F.lit("tag").alias("kind"), "key", none.alias("value"), "n"))
        .unionByName(tags.select(F.lit("value").alias("kind"), "key", "value", "n")).unionByName(rest)
    )


def unmapped_events(kmers: DataFrame) -> DataFrame:
    """Event type by number of alignments: none unmapped, several multimap, else by gene."""
    n = F.size("alignments")
    kind = F.when(n == 0, "unmapped").when(n > 1, "multimap").when(F.col("gene").isNull(), "intergenic").otherwise("intragenic")
    return kmers.withColumn("event", kind)
