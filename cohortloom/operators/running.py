"""Ranks and running sums of groups of any size: by ranges, then across their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

PART = "_part"


def in_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` dealt to ranges of (by, order) of about equal size, with the range's number;
    stored, as ranges are drawn from a sample."""
    return stored(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(ranges: DataFrame, by: list[str], order: list[Column], value: str, how, out: str) -> DataFrame:  # noqa: ANN001
    """``out``: ``how`` (F.sum, F.max or F.min) of ``value`` over the rows of a group up to
    each one in order, itself included.

    A task holds a range of a group; ranges meet in one row each.
    """
    whole = ranges.groupBy(*by, PART).agg(how(value).alias("_t"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*[F.col(c).alias("_" + c) for c in [*by, PART]], how("_t").over(earlier).alias("_before"))
    within = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.withColumn("_here", how(value).over(within))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in [*by, PART]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    both = F.col("_here") if how is not F.sum else F.col("_here") + F.coalesce("_before", F.lit(0))
    if how is F.max:
        both = F.greatest("_here", "_before")
    elif how is F.min:
        both = F.least("_here", "_before")
    return local.join(before, on).select(*ranges.columns, both.alias(out))


def numbered(rows: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``out``: the row's number within its group, from 1; ``order`` tells rows apart."""
    ranges = in_ranges(rows.withColumn("_one", F.lit(1)), by, order)
    return running(ranges, by, order, "_one", F.sum, out).drop("_one", PART).withColumn(out, F.col(out).cast("long"))
