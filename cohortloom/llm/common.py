"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATORS = " \t\n\x0b\x0c\r"


#: Bytes of rows that go to a Python task at once, on either side of the pipe.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of documents or the like. Texts may be long, so batches for Python tasks are
    bounded in bytes for this session."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the
    session names none and all runs in one process, as in tests, a new local one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def save(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and
    a lost executor costs no more than a reread. Long rows are read with less memory
    when ``row_group``, in bytes, is small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results have been saved: its
    cleaner acts when the driver collects garbage, which may be long after."""
    spark._jvm.System.gc()


def discard(*saved: DataFrame) -> None:
    """Delete what ``save`` wrote, once nothing reads it any more."""
    for df in saved:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(divisor)


def spread(wide: int, *columns) -> Column:
    """A bucket from 0 to ``wide`` - 1 by hash, for salting and for ranking."""
    return F.pmod(F.xxhash64(*columns), F.lit(wide)).cast("int")


def numbered(
    df: DataFrame, group: list[str], order: list, bucket: Column, out: str
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no task more than a bucket.

    ``bucket`` deals a group's rows to buckets; rows are ordered by bucket, then by
    ``order``. ``df`` must give the same rows each time it is read (see ``save``), and
    ``order`` should tell rows apart.
    """
    dealt = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return (
        ranked.join(starts, on)
        .withColumn(out, (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_bucket", "_within", "_start", *[f"_k{i}" for i in range(len(keys))])
    )


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))
