"""Queries of the sample registry, the maps' displays and unannotated sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import annotation, browse, groups, intervals, models
from ..sources import files
from . import queries as Q
from . import tables as T

SAMPLES_SQL = """WITH s AS (
  SELECT c_name AS name, c_custkey AS id, c_acctbal AS total, 21 + 10 * (c_nationkey % 2) AS k_len, c_mktsegment AS segment, CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer
), v AS (SELECT * FROM s WHERE segment = 'BUILDING' AND k_len = 31)
"""


def _samples(s: SparkSession, d: str) -> DataFrame:
    tags = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("Segment").alias("key"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("Nation").alias("key"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey").cast("string")).alias("value")),
    ), lambda x: x["value"].isNotNull()))
    return T.table(s, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("total"), (21 + 10 * (F.col("c_nationkey") % 2)).alias("k_len"), tags.alias("metadata")
    )


def _visible(s: SparkSession, d: str) -> DataFrame:
    return browse.sample_filter(_samples(s, d), keys=["Segment"], tags={"Segment": "BUILDING"}, k=[31])


@Q.query(SAMPLES_SQL + "SELECT name, id FROM v")
def sample_filter(s: SparkSession, d: str) -> DataFrame:
    return _visible(s, d).select("name", "id")


@Q.query(SAMPLES_SQL + "SELECT name, total FROM v ORDER BY total DESC, name LIMIT 10 OFFSET 10")
def sample_page(s: SparkSession, d: str) -> DataFrame:
    """The second page of visible samples, the greatest totals first."""
    return browse.page_of(_visible(s, d), "total", False, 1, 10, "name").select("name", "total")


@Q.query(SAMPLES_SQL + """, w AS (SELECT s.*, v.name IS NOT NULL AS vis FROM s LEFT JOIN v ON v.name = s.name
), t AS (SELECT 'Segment' AS key, segment AS value, vis FROM w UNION ALL SELECT 'Nation', nation, vis FROM w WHERE nation IS NOT NULL
), g AS (SELECT key, sum(vis::INT)::BIGINT AS n FROM t GROUP BY key)
SELECT 'k_len' AS kind, NULL AS key, CAST(k_len AS VARCHAR) AS value, sum(vis::INT)::BIGINT AS n FROM w GROUP BY k_len
UNION ALL SELECT 'tag', key, NULL, n FROM g UNION ALL SELECT 'value', key, value, sum(vis::INT)::BIGINT FROM t GROUP BY key, value
UNION ALL SELECT 'value', key, 'None', (SELECT count(*) FROM v) - n FROM g""")
def registry_stats(s: SparkSession, d: str) -> DataFrame:
    return browse.registry_stats(_samples(s, d), _visible(s, d))


@Q.query("SELECT n_name AS name, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'ERI') OR contains(r_name, 'ERI')")
def matrix_filter(s: SparkSession, d: str) -> DataFrame:
    return browse.matrix_filter(T.samples(s, d).select(F.col("sample").alias("name"), "grp"), "ERI")


@Q.query(Q.NODE_SQL + "SELECT e.vec_id AS sample, near.node, e.label::VARCHAR AS class FROM near JOIN embeddings e USING (vec_id) WHERE near.node IN (1, 4, 7) AND e.label IN (2, 3, 4)")
def map_filter(s: SparkSession, d: str) -> DataFrame:
    """What a map shows of three nodes and three classes."""
    e = T.table(s, d, "embeddings")
    near = Q.similarity.nearest_node(Q._first_nodes(s, d), e).select("vec_id", "node")
    rows = near.join(e, "vec_id").select(F.col("vec_id").alias("sample"), "node", F.col("label").cast("string").alias("class"))
    return browse.map_filter(rows, nodes=[1, 4, 7], classes=["2", "3", "4"])


@Q.query("WITH " + T.SQL_M + "SELECT kmer, sample, raw_count FROM (SELECT *, row_number() OVER (PARTITION BY substr(kmer, 1, 7) ORDER BY kmer, sample) AS i FROM m) WHERE i <= 50")
def range_budget(s: SparkSession, d: str) -> DataFrame:
    """The first 50 rows of each range of k-mers, as many as a diagnosis of the gate reads."""
    ranked = groups.numbered(T.matrix(s, d).withColumn("range", F.substring("kmer", 1, 7)), ["range"], [F.asc("kmer"), F.asc("sample")], "i")
    return ranked.where("i <= 50").select("kmer", "sample", "raw_count")


@Q.query()
def second_map(s: SparkSession, d: str) -> DataFrame:
    """Samples placed on a map that is trained on their own totals by node of the first map."""
    e = T.table(s, d, "embeddings")
    near = Q.similarity.nearest_node(Q._first_nodes(s, d), e).join(e.select("vec_id", "label"), "vec_id")
    cells = near.groupBy(F.col("label").alias("sample"), "node").agg(F.sum("distance").alias("total"))
    return models.second_map(cells, 3, 1).select("sample", "node")


@Q.query("""WITH q AS (
  SELECT o_orderkey AS id, o_custkey AS best_kmer, count(l_orderkey) FILTER (l_quantity > 20) AS n, list(DISTINCT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END) FILTER (l_quantity > 20 AND l_suppkey % 3 > 0) AS genes
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
), k AS (SELECT *, CASE WHEN n = 0 THEN 'unmapped' WHEN n > 1 THEN 'multimap' WHEN genes IS NULL THEN 'intergenic' ELSE 'intragenic' END AS event FROM q WHERE best_kmer % 5 > 0
), f AS (SELECT best_kmer, arg_min(struct_pack(e := event, g := coalesce(list_sort(genes), []::BIGINT[])), id) AS x FROM k WHERE event <> 'intragenic' GROUP BY best_kmer)
SELECT best_kmer, x.e AS event, x.g AS genes FROM f""")
def unannotated_events(s: SparkSession, d: str) -> DataFrame:
    """Orders as sequences, their larger items as alignments, suppliers as genes."""
    o, li = T.table(s, d, "orders"), T.table(s, d, "lineitem").where("l_quantity > 20")
    gene = F.when(F.col("l_suppkey") % 3 > 0, F.array("l_suppkey")).otherwise(F.array().cast("array<bigint>"))
    aligned = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(gene.cast("array<bigint>")).alias("genes"))
    none = F.array().cast("array<array<bigint>>")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("best_kmer")).join(aligned, "id", "left").withColumn("genes", F.coalesce("genes", none))
    known = o.where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("best_kmer")).distinct()
    return annotation.unannotated_events(rows, known, perfect=True)


@Q.query("""WITH al AS (SELECT l_orderkey * 10 + l_linenumber AS kmer, CAST(l_quantity AS BIGINT) AS pos, l_suppkey % 20 AS gap FROM lineitem)
SELECT DISTINCT kmer, 'misalign' AS event FROM al WHERE kmer NOT IN (SELECT kmer FROM al WHERE (pos < 15) OR (pos < 45 AND pos + 9 > 25))""")
def misaligned(s: SparkSession, d: str) -> DataFrame:
    """Nine letters of a query, of which letters 15 to 25 and those from 45 on are in no block."""
    block = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    q, t = F.array(block(0, 15), block(25, 45)), F.array(block(100, 115), block(140, 160))
    rows = T.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kmer"), F.col("l_quantity").cast("long").alias("pos"))
    placed = rows.withColumn("blocks", annotation.lifted(q, t, F.col("pos"), F.col("pos") + 9)).where("size(blocks) > 0")
    return annotation.misaligned(rows, placed)


@Q.query("""WITH s AS (SELECT l_partkey AS best_kmer, max(l_extendedprice) AS best_score, list_sort(list(DISTINCT l_returnflag)) AS events FROM lineitem WHERE l_extendedprice >= 40000 GROUP BY 1) SELECT * FROM s""")
def winners(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "lineitem").select(F.col("l_partkey").alias("best_kmer"), F.col("l_extendedprice").alias("best_score"), F.col("l_returnflag").alias("event"))
    return annotation.winners(rows, 40000.0)


@Q.query("""WITH b AS (SELECT DISTINCT o_orderkey AS a_id, o_orderstatus AS chrom, o_custkey AS start, o_custkey + o_orderkey % 40 AS "end" FROM orders
), e AS (SELECT DISTINCT l_linestatus AS chrom, l_partkey AS start, l_partkey + l_suppkey % 40 AS "end", l_suppkey AS exon_id FROM lineitem
), l AS (SELECT b.a_id, list_sort(list(DISTINCT e.exon_id) FILTER (e.exon_id IS NOT NULL)) AS left_exons FROM b LEFT JOIN e ON e.chrom = b.chrom AND e."end" = b."end" GROUP BY 1
), r AS (SELECT b.a_id, list_sort(list(DISTINCT e.exon_id) FILTER (e.exon_id IS NOT NULL)) AS right_exons FROM b LEFT JOIN e ON e.chrom = b.chrom AND e.start = b.start GROUP BY 1)
SELECT a_id, coalesce(left_exons, []) AS left_exons, coalesce(right_exons, []) AS right_exons FROM l JOIN r USING (a_id)""")
def splice_ends(s: SparkSession, d: str) -> DataFrame:
    """Exons that end or start where a block does."""
    blocks = T.table(s, d, "orders").select(F.col("o_orderkey").alias("a_id"), F.col("o_orderstatus").alias("chrom"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("end"))
    exons = T.table(s, d, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey") % 40).alias("end"), F.col("l_suppkey").alias("exon_id")).distinct()
    return intervals.splice_ends(blocks, exons)


@Q.query("SELECT p_partkey AS kmer FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)")
def missing_features(s: SparkSession, d: str) -> DataFrame:
    """Parts that a model would need and the rows of single items lack."""
    rows = T.table(s, d, "lineitem").where("l_quantity < 2").select(F.col("l_partkey").alias("kmer"))
    return models.missing_features(T.table(s, d, "part").select(F.col("p_partkey").alias("kmer")), rows)


@Q.query("""WITH m AS (SELECT l_returnflag AS grp, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN hi = lo THEN -1 ELSE (l_extendedprice - lo) / (hi - lo) * 2 - 1 END, 6) AS value FROM lineitem JOIN m ON grp = l_returnflag""")
def rescaled(s: SparkSession, d: str) -> DataFrame:
    """Prices from -1 to 1 within their group."""
    li = T.table(s, d, "lineitem")
    ends = li.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    value = stats.rescaled(F.col("l_extendedprice"), F.col("lo"), F.col("hi"), -1.0, 1.0)
    return li.join(ends, "l_returnflag").select("l_orderkey", "l_linenumber", Q._r(value).alias("value"))


SAM_SQL = """WITH a AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS chrom, l_partkey AS pos, l_suppkey % 5 AS u, l_linenumber % 4 AS v, l_quantity % 2 > 0 AS intron, 'ACGTTGCATCAGGACTTACGATCGATTACA' AS seq FROM lineitem
), t AS (SELECT *, pos + CASE WHEN intron THEN 90 ELSE 0 END AS far FROM a
), s AS (
  SELECT id, chrom, 'clipping' AS kind, pos AS t_start, pos + 1 AS t_end, 0 AS q_start, 3 AS q_end, substr(seq, 1, 3) AS info FROM t
  UNION ALL SELECT id, chrom, 'mutation', pos + u, pos + u + 1, 3 + u, 4 + u, 'N>' || substr(seq, CAST(4 + u AS INT), 1) FROM t
  UNION ALL SELECT id, chrom, 'insertion', pos + 8, pos + 9, 11, 13, substr(seq, 12, 2) FROM t
  UNION ALL SELECT id, chrom, 'mutation', far + 8 + v, far + 9 + v, 13 + v, 14 + v, 'G>' || substr(seq, CAST(14 + v AS INT), 1) FROM t
  UNION ALL SELECT id, chrom, 'deletion', far + 14, far + 16, 19, 20, '^AC' FROM t
) SELECT id, chrom, kind, t_start::BIGINT AS t_start, t_end::BIGINT AS t_end, q_start::BIGINT AS q_start, q_end::BIGINT AS q_end, info FROM s"""


@Q.query(SAM_SQL)
def alignment_signatures(s: SparkSession, d: str) -> DataFrame:
    """Clipped ends, changed letters, insertions and deletions of alignments whose CIGAR and MD
    follow from the line items, half of them over an intron."""
    li = T.table(s, d, "lineitem")
    u, v = F.col("l_suppkey") % 5, F.col("l_linenumber") % 4
    intron = F.when(F.col("l_quantity") % 2 > 0, F.lit("90N")).otherwise(F.lit(""))
    cigar = F.concat(F.lit("3S8M2I"), intron, F.lit("6M2D11M"))
    text = lambda c: c.cast("string")
    md = F.concat(F.lit("MD:Z:"), text(u), F.lit("N"), text(7 - u + v), F.lit("G"), text(5 - v), F.lit("^AC11"))
    line = F.concat_ws(
        "\t", text(F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.lit("0"), "l_linestatus", text(F.col("l_partkey") + 1), F.lit("60"), cigar,
        F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTTGCATCAGGACTTACGATCGATTACA"), F.lit("*"), md,
    )
    found = files.sam_signatures(li.select(line.alias("value")))
    return found.withColumnRenamed("name", "id").withColumn("id", F.col("id").cast("long"))
