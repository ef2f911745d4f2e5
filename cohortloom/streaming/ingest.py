"""Samples that arrive one by one: appended to the long table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_counts(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Follow ``folder``/<sample>/*.tsv and append (sample, kmer, raw_count) to ``table``.

    Partitioned by sample, so that a later scan of a few samples reads only those. Files
    are taken once; a restart goes on from the checkpoint.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = (
        spark.readStream.option("recursiveFileLookup", "true").text(folder)
        .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("sample"), parts[0].alias("kmer"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("raw_count"))
        .where("raw_count IS NOT NULL")
    )

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").partitionBy("sample").parquet(table)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
