"""The driver's tables as reads, matrices, samples and intervals, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import dna_of_text

RESCALE = 1e6

SQL_READS = """reads AS (
  SELECT doc_id, source AS sample, lang AS grp,
         regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]+', 'N', 'g') AS seq
  FROM documents
)"""
SQL_PIECES = SQL_READS + """, pieces AS (
  SELECT doc_id, sample, grp, unnest(string_split(seq, 'N')) AS piece FROM reads
)"""
SQL_M = """m AS (
  SELECT n_name AS sample, r_name AS grp, p_brand || '/' || p_type AS kmer, CAST(sum(l_quantity) AS BIGINT) AS raw_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3
), samples AS (
  SELECT n_name AS sample, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey
), v AS (
  SELECT *, raw_count / (sum(raw_count) OVER (PARTITION BY sample) / 1e6) AS value FROM m
), filled AS (
  SELECT k.kmer, s.sample, s.grp, coalesce(v.value, 0.0) AS x, coalesce(v.raw_count, 0) AS raw
  FROM (SELECT DISTINCT kmer FROM m) k CROSS JOIN samples s LEFT JOIN v ON v.kmer = k.kmer AND v.sample = s.sample
)"""
SQL_STATS = SQL_M + """, st AS (
  SELECT kmer, grp, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM filled GROUP BY 1, 2
)"""
SQL_INTERVALS = """a AS (
  SELECT o_orderstatus AS chrom, o_orderkey AS start, o_orderkey + o_custkey % 50 AS "end", o_orderkey AS a_id FROM orders
), b AS (
  SELECT l_linestatus AS chrom, l_orderkey AS start, l_orderkey + l_partkey % 30 AS "end", l_orderkey * 10 + l_linenumber AS b_id
  FROM lineitem
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("sample"), F.col("lang").alias("grp"), dna_of_text(F.col("text")).alias("seq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("sample"), F.col("r_name").alias("grp"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by nation (sample), region (group) and kind of part (feature)."""
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    return (
        t("lineitem", "l_orderkey", "l_partkey", "l_quantity")
        .join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part", "p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("n_name").alias("sample"), F.col("r_name").alias("grp"), F.concat("p_brand", F.lit("/"), "p_type").alias("kmer"))
        .agg(F.sum("l_quantity").cast("long").alias("raw_count"))
    )


def intervals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 50).alias("end"), F.col("o_orderkey").alias("a_id"))


def intervals_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_partkey") % 30).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("b_id"))
