"""One query for each operator, with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kmers as K
from ..operators import annotation, browse, graph, groups, intervals, matrix, models, reduce, similarity
from . import tables as T

K_SMALL = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _normal(s: SparkSession, d: str) -> DataFrame:
    return matrix.normalised(T.matrix(s, d), T.RESCALE)


def _stats(s: SparkSession, d: str) -> DataFrame:
    return groups.group_stats(_normal(s, d), T.samples(s, d))


def _r(c, n: int = 6):  # noqa: ANN001, ANN202
    """Rounded, with no negative zero: floating sums differ in their last digits by order."""
    return F.round(c, n) + F.lit(0.0)


COUNT_SQL = "WITH " + T.SQL_PIECES + """, k AS (
  SELECT sample, substr(piece, i, 6) AS kmer
  FROM (SELECT sample, piece, unnest(range(1, len(piece) - 4)) AS i FROM pieces WHERE len(piece) >= 6)
), c AS (SELECT sample, kmer, count(*) AS raw_count FROM k GROUP BY 1, 2)
"""


@query(COUNT_SQL + "SELECT * FROM c")
def kmer_count(s: SparkSession, d: str) -> DataFrame:
    return matrix.count_kmers(T.reads(s, d), K_SMALL)


@query(COUNT_SQL + "SELECT sample, kmer, least(raw_count, 100) AS raw_count FROM c WHERE raw_count >= 5")
def kmer_count_min(s: SparkSession, d: str) -> DataFrame:
    return matrix.count_kmers(T.reads(s, d), K_SMALL, least=5, most=100)


@query("WITH " + T.SQL_PIECES + """, p AS (
  SELECT sample, CASE WHEN doc_id % 2 = 0 THEN reverse(translate(piece, 'ACGT', 'TGCA')) ELSE piece END AS piece FROM pieces
), k AS (
  SELECT sample, substr(piece, i, 6) AS kmer FROM (SELECT sample, piece, unnest(range(1, len(piece) - 4)) AS i FROM p WHERE len(piece) >= 6)
) SELECT sample, kmer, count(*) AS raw_count FROM k GROUP BY 1, 2""")
def kmer_strand_rc(s: SparkSession, d: str) -> DataFrame:
    return matrix.count_kmers(T.reads(s, d), K_SMALL, flip=F.col("doc_id") % 2 == 0)


@query("WITH " + T.SQL_PIECES + """, k AS (
  SELECT doc_id, substr(piece, i, 6) AS kmer FROM (SELECT doc_id, piece, unnest(range(1, len(piece) - 4)) AS i FROM pieces WHERE len(piece) >= 6)
) SELECT doc_id, kmer FROM k GROUP BY 1, 2""")
def kmer_distinct_per_doc(s: SparkSession, d: str) -> DataFrame:
    """Distinct within a row, without any shuffle."""
    pieces = F.filter(F.split("seq", "N"), lambda p: F.length(p) >= K_SMALL)
    each = F.array_distinct(F.flatten(F.transform(pieces, lambda p: K.kmers(p, K_SMALL))))
    return T.reads(s, d).select("doc_id", F.explode(each).alias("kmer"))


KMERS_SQL = COUNT_SQL + ", d AS (SELECT DISTINCT kmer FROM c)\n"


def _kmers(s: SparkSession, d: str) -> DataFrame:
    return kmer_count(s, d).select("kmer").distinct()


@query(KMERS_SQL + """SELECT kmer, round((SELECT count(*) FROM unnest(range(2, 7)) t(i) WHERE substr(kmer, i, 1) <> substr(kmer, i - 1, 1)) / 6.0, 6) AS complexity FROM d""")
def kmer_complexity(s: SparkSession, d: str) -> DataFrame:
    return _kmers(s, d).select("kmer", _r(K.complexity(F.col("kmer"))).alias("complexity"))


CODE_SQL = "CAST(" + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (5 - i)}" for i in range(6)) + " AS BIGINT)"


@query(KMERS_SQL + f"SELECT kmer, {CODE_SQL} AS code FROM d")
def kmer_to_int(s: SparkSession, d: str) -> DataFrame:
    return _kmers(s, d).select("kmer", K.kmer_to_int(F.col("kmer")).alias("code"))


@query(KMERS_SQL + f"SELECT {CODE_SQL} AS code, kmer FROM d")
def int_to_kmer(s: SparkSession, d: str) -> DataFrame:
    coded = kmer_to_int(s, d).select("code")
    return coded.select("code", K.int_to_kmer(F.col("code"), K_SMALL).alias("kmer"))


@query(KMERS_SQL + "SELECT kmer, substr(kmer, 1, 2) AS prefix, substr(kmer, 3) AS suffix, substr(kmer, 1, 2) || substr(kmer, 3) AS joined, reverse(translate(kmer, 'ACGT', 'TGCA')) AS revcomp FROM d")
def prefix_suffix(s: SparkSession, d: str) -> DataFrame:
    k = F.col("kmer")
    return _kmers(s, d).select(
        k, F.substring(k, 1, 2).alias("prefix"), F.substring(k, 3, K_SMALL).alias("suffix"),
        F.concat(F.substring(k, 1, 2), F.substring(k, 3, K_SMALL)).alias("joined"), K.reverse_complement(k).alias("revcomp"),
    )


@query("WITH " + T.SQL_READS + """, k AS (SELECT doc_id, seq FROM reads)
SELECT doc_id, seq SIMILAR TO '[ACGT]+' AS is_dna, upper(substr(seq, 1, 10)) AS head, CAST(len(string_split(seq, 'N')) AS INT) AS n_pieces FROM k""")
def dna_check(s: SparkSession, d: str) -> DataFrame:
    return T.reads(s, d).select("doc_id", K.is_dna(F.col("seq")).alias("is_dna"), F.upper(F.substring("seq", 1, 10)).alias("head"), F.size(F.split("seq", "N")).alias("n_pieces"))


@query("WITH " + T.SQL_M + "SELECT sample, CAST(sum(raw_count) AS BIGINT) AS total_count, count(*) AS n_kmers, count(DISTINCT substr(kmer, 1, 8)) AS n_prefixes FROM m GROUP BY 1")
def sample_totals(s: SparkSession, d: str) -> DataFrame:
    return matrix.totals(T.matrix(s, d), 8)


@query("WITH " + T.SQL_M + "SELECT sample, grp, kmer, raw_count, round(value, 6) AS value FROM v")
def matrix_normalised(s: SparkSession, d: str) -> DataFrame:
    return _normal(s, d).withColumn("value", _r(F.col("value")))


def _names(s: SparkSession, d: str) -> list[str]:
    return [r[0] for r in T.samples(s, d).select("sample").orderBy("sample").collect()]  # a matrix header


@query("WITH " + T.SQL_M + "SELECT kmer, string_agg(CAST(raw AS VARCHAR), ',' ORDER BY sample) AS row FROM filled GROUP BY kmer")
def matrix_wide(s: SparkSession, d: str) -> DataFrame:
    names = _names(s, d)
    return matrix.wide(T.matrix(s, d), names).select("kmer", F.concat_ws(",", *[F.col(f"`{n}`").cast("string") for n in names]).alias("row"))


@query("WITH " + T.SQL_M + "SELECT kmer, list(round(x, 6) ORDER BY sample) AS counts FROM filled GROUP BY kmer")
def matrix_arrays(s: SparkSession, d: str) -> DataFrame:
    rows = matrix.as_arrays(_normal(s, d), T.samples(s, d))
    return rows.select("kmer", F.transform("counts", lambda c: F.round(c, 6)).alias("counts"))


@query("WITH " + T.SQL_M + "SELECT sample, grp, kmer, raw_count FROM m ORDER BY kmer, sample")
def matrix_dump(s: SparkSession, d: str) -> DataFrame:
    return matrix.dump(T.matrix(s, d))


@query("WITH " + T.SQL_M + "SELECT sample, grp, kmer, raw_count FROM m WHERE kmer BETWEEN 'Brand#12' AND 'Brand#25'")
def matrix_range_dump(s: SparkSession, d: str) -> DataFrame:
    return matrix.dump(T.matrix(s, d), "Brand#12", "Brand#25")


@query("WITH " + T.SQL_M + """, q AS (
  SELECT p_partkey AS line, CASE WHEN p_partkey % 3 = 0 THEN 'absent' ELSE p_brand || '/' || p_type END AS kmer FROM part
) SELECT line, q.kmer, s.sample, coalesce(raw_count, 0) AS raw_count FROM q CROSS JOIN samples s LEFT JOIN m ON m.kmer = q.kmer AND m.sample = s.sample""")
def matrix_extract(s: SparkSession, d: str) -> DataFrame:
    asked = T.table(s, d, "part").select(
        F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 3 == 0, "absent").otherwise(F.concat("p_brand", F.lit("/"), "p_type")).alias("kmer")
    )
    return matrix.extract(T.matrix(s, d), asked, T.samples(s, d).select("sample"))


@query("WITH " + T.SQL_M + "SELECT kmer, max(raw_count) AS max_count FROM m GROUP BY 1 HAVING max(raw_count) >= 100")
def min_count_filter(s: SparkSession, d: str) -> DataFrame:
    return matrix.min_count(T.matrix(s, d), 100)


@query("WITH " + T.SQL_M + "SELECT kmer, round(count(*) FILTER (raw_count > 0) / 25.0, 6) AS fraction FROM m GROUP BY 1 HAVING count(*) FILTER (raw_count > 0) / 25.0 >= 0.1")
def nonzero_fraction(s: SparkSession, d: str) -> DataFrame:
    return matrix.nonzero_fraction(T.matrix(s, d), T.samples(s, d).count(), 0.1).withColumn("fraction", _r(F.col("fraction")))


ENTROPY_SQL = "WITH " + T.SQL_M + """, e AS (
  SELECT kmer, -sum(p * log2(p)) AS entropy FROM (SELECT kmer, value / sum(value) OVER (PARTITION BY kmer) AS p FROM v WHERE value > 0) GROUP BY 1
)
"""


@query(ENTROPY_SQL + "SELECT kmer, round(entropy, 6) AS entropy FROM e")
def entropy(s: SparkSession, d: str) -> DataFrame:
    return matrix.entropy(_normal(s, d)).withColumn("entropy", _r(F.col("entropy")))


@query(ENTROPY_SQL + "SELECT kmer, round(entropy, 6) AS entropy FROM e WHERE entropy >= 4")
def entropy_gate_fixed(s: SparkSession, d: str) -> DataFrame:
    return matrix.entropy(_normal(s, d)).where("entropy >= 4").withColumn("entropy", _r(F.col("entropy")))


BIN_SQL = "WITH " + T.SQL_M + """, w AS (
  SELECT kmer, sample, value, min(value) OVER (PARTITION BY kmer) AS lo, max(value) OVER (PARTITION BY kmer) AS hi,
         count(*) OVER (PARTITION BY kmer) / 25.0 AS share FROM v WHERE value > 0
), b AS (
  SELECT kmer, sample, share, CAST(CASE WHEN hi = lo THEN 1 ELSE floor((value - lo) / ((hi - lo) / 19.0)) + 1 END AS BIGINT) AS bin FROM w WHERE share >= 0.1
)
"""


@query(BIN_SQL + "SELECT kmer, sample, round(share, 6) AS share, bin FROM b")
def discretise(s: SparkSession, d: str) -> DataFrame:
    return similarity.discretise(_normal(s, d), T.samples(s, d).count(), bins=20).withColumn("share", _r(F.col("share")))


@query(BIN_SQL + """SELECT x.sample AS s1, y.sample AS s2, round(sum(CASE WHEN x.bin = y.bin THEN 2 ELSE 1 END * (1 - x.share)), 6) AS similarity
FROM b x JOIN b y ON x.kmer = y.kmer AND x.sample < y.sample AND abs(x.bin - y.bin) <= 1 GROUP BY 1, 2""")
def sample_similarity(s: SparkSession, d: str) -> DataFrame:
    binned = similarity.discretise(_normal(s, d), T.samples(s, d).count(), bins=20)
    return similarity.sample_similarity(binned).withColumn("similarity", _r(F.col("similarity")))


@query("WITH " + T.SQL_M + "SELECT CAST(row_number() OVER (ORDER BY grp) - 1 AS INT) AS group_id, grp, count(*) AS n_samples FROM samples GROUP BY grp")
def group_counts(s: SparkSession, d: str) -> DataFrame:
    return groups.group_counts(T.samples(s, d))


@query("WITH " + T.SQL_STATS + "SELECT kmer, grp, n, round(mean, 5) AS mean, round(sd, 5) AS sd FROM st")
def group_mean_sd(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d).select("kmer", "grp", "n", _r(F.col("mean"), 5).alias("mean"), _r(F.col("sd"), 5).alias("sd"))


@query("WITH " + T.SQL_STATS + """SELECT a.kmer, a.grp AS grp_a, b.grp AS grp_b, CASE WHEN a.mean = 0 THEN CAST('inf' AS DOUBLE) WHEN b.mean = 0 THEN CAST('-inf' AS DOUBLE)
  WHEN a.mean > b.mean THEN round(a.mean / b.mean, 5) ELSE round(-b.mean / a.mean, 5) END AS fold FROM st a JOIN st b ON a.kmer = b.kmer AND a.grp < b.grp""")
def fold_change(s: SparkSession, d: str) -> DataFrame:
    return groups.pairwise(_stats(s, d)).select("kmer", "grp_a", "grp_b", F.round("fold", 5).alias("fold"))


@query("WITH " + T.SQL_STATS + """SELECT a.kmer, a.grp AS grp_a, b.grp AS grp_b, round((a.mean - b.mean) / nullif(sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n), 0), 4) + 0.0 AS t,
  round(power(a.sd * a.sd / a.n + b.sd * b.sd / b.n, 2) / nullif(power(a.sd * a.sd / a.n, 2) / (a.n - 1) + power(b.sd * b.sd / b.n, 2) / (b.n - 1), 0), 3) AS df
FROM st a JOIN st b ON a.kmer = b.kmer AND a.grp < b.grp""")
def welch_t_stat(s: SparkSession, d: str) -> DataFrame:
    """Null where neither group varies."""
    return groups.pairwise(_stats(s, d)).select("kmer", "grp_a", "grp_b", _r(F.col("t"), 4).alias("t"), _r(F.col("df"), 3).alias("df"))


@query()
def welch_p(s: SparkSession, d: str) -> DataFrame:
    return groups.with_welch_p(groups.pairwise(_stats(s, d)))


@query("WITH " + T.SQL_STATS + """, g AS (SELECT *, sum(n * mean) OVER (PARTITION BY kmer) / sum(n) OVER (PARTITION BY kmer) AS grand FROM st)
SELECT kmer, round((sum(n * power(mean - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * sd * sd) / (sum(n) - count(*))), 5) AS f,
  CAST(count(*) - 1 AS BIGINT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g GROUP BY kmer""")
def anova_f(s: SparkSession, d: str) -> DataFrame:
    return groups.anova(_stats(s, d)).withColumn("f", _r(F.col("f"), 5))


# With an even first number of degrees of freedom the p-value is a polynomial: here 4 and 20.
@query("WITH " + T.SQL_STATS + """, g AS (SELECT *, sum(n * mean) OVER (PARTITION BY kmer) / sum(n) OVER (PARTITION BY kmer) AS grand FROM st
), f AS (SELECT kmer, (sum(n * power(mean - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * sd * sd) / (sum(n) - count(*))) AS f,
  CAST(count(*) - 1 AS BIGINT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g GROUP BY kmer)
SELECT kmer, round(f, 5) AS f, df1, df2, round(CASE WHEN df1 = 4 AND df2 = 20 THEN power(20 / (20 + 4 * f), 10) * (1 + 10 * 4 * f / (20 + 4 * f)) END, 8) AS p FROM f""")
def anova_p(s: SparkSession, d: str) -> DataFrame:
    return groups.with_anova_p(groups.anova(_stats(s, d))).withColumn("f", _r(F.col("f"), 5)).withColumn("p", _r(F.col("p"), 8))


# With an even number of degrees of freedom it is a finite sum: here 8.
@query("WITH " + T.SQL_STATS + """, t AS (
  SELECT a.kmer, a.grp AS grp_a, b.grp AS grp_b, (a.n + b.n - 2)::DOUBLE AS df,
         (a.mean - b.mean) / sqrt(((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / nullif(a.n + b.n - 2, 0) * (1.0 / a.n + 1.0 / b.n)) AS t
  FROM st a JOIN st b ON a.kmer = b.kmer AND a.grp < b.grp
), c AS (SELECT *, 8 / (8 + t * t) AS c FROM t)
SELECT kmer, grp_a, grp_b, round(t, 4) AS t, df, round(CASE WHEN df = 8 THEN 1 - abs(t) / sqrt(8 + t * t) * (1 + c / 2 + 3 * c * c / 8 + 5 * c * c * c / 16) END, 7) AS p FROM c""")
def pooled_p(s: SparkSession, d: str) -> DataFrame:
    return groups.with_pooled_p(_stats(s, d)).withColumn("t", _r(F.col("t"), 4)).withColumn("p", _r(F.col("p"), 7))


MWU_SQL = "WITH " + T.SQL_M + """, two AS (
  SELECT f.kmer, a.grp AS grp_a, b.grp AS grp_b, f.grp, round(f.x, 6) AS x
  FROM (SELECT DISTINCT grp FROM samples) a JOIN (SELECT DISTINCT grp FROM samples) b ON a.grp < b.grp JOIN filled f ON f.grp IN (a.grp, b.grp)
), r AS (
  SELECT *, rank() OVER (PARTITION BY kmer, grp_a, grp_b ORDER BY x) + (count(*) OVER (PARTITION BY kmer, grp_a, grp_b, x) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY kmer, grp_a, grp_b, x) AS peers FROM two
), q AS (
  SELECT kmer, grp_a, grp_b, sum(CASE WHEN grp = grp_a THEN rk ELSE 0 END) AS r1, count(*) FILTER (grp = grp_a) AS n1, count(*) FILTER (grp = grp_b) AS n2,
         sum(peers * peers - 1) AS ties FROM r GROUP BY 1, 2, 3
), u AS (SELECT *, greatest(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) AS u FROM q)
SELECT kmer, grp_a, grp_b, round(u, 4)::DOUBLE AS u, round(CASE WHEN (n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)) > 0 THEN (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) END, 5) AS z FROM u"""


@query(MWU_SQL)
def mannwhitney_u(s: SparkSession, d: str) -> DataFrame:
    values = _normal(s, d).withColumn("value", F.round("value", 6))
    return groups.mann_whitney(values, T.samples(s, d)).select("kmer", "grp_a", "grp_b", _r(F.col("u"), 4).alias("u"), _r(F.col("z"), 5).alias("z"))


@query("WITH " + T.SQL_M + """SELECT a.sample AS s1, b.sample AS s2, round(corr(a.x, b.x), 5) AS r FROM filled a JOIN filled b ON a.kmer = b.kmer AND a.sample < b.sample GROUP BY 1, 2""")
def pearson_pairs(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, _names(s, d)))
    pairs = similarity.column_correlations(matrix.as_arrays(_normal(s, d), T.samples(s, d)))
    return pairs.select(F.get(names, "i").alias("s1"), F.get(names, "j").alias("s2"), _r(F.col("r"), 5).alias("r"))


RANK_SQL = "WITH " + T.SQL_STATS + """, sc AS (SELECT grp AS comparison, kmer, round(mean, 4) AS score, 1 / (1 + round(sd, 4)) AS p FROM st)
"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d).select(F.col("grp").alias("comparison"), "kmer", F.round("mean", 4).alias("score"), (1 / (1 + F.round("sd", 4))).alias("p"))


@query(RANK_SQL + """SELECT kmer, CAST(min(r) AS INT) AS best_rank FROM (SELECT kmer, row_number() OVER (PARTITION BY comparison ORDER BY score DESC, p, kmer) - 1 AS r FROM sc) GROUP BY kmer""")
def best_rank(s: SparkSession, d: str) -> DataFrame:
    return groups.best_rank(_scores(s, d))


@query("WITH " + T.SQL_M + "SELECT sample, kmer, raw_count, rank() OVER (PARTITION BY sample ORDER BY raw_count) + (count(*) OVER (PARTITION BY sample, raw_count) - 1) / 2.0::DOUBLE AS rank FROM m")
def tie_ranks(s: SparkSession, d: str) -> DataFrame:
    return groups.tie_ranks(T.matrix(s, d).select("sample", "kmer", "raw_count"), ["sample"], "raw_count")


@query(RANK_SQL + """SELECT comparison AS family, kmer, round(least(1.0, max(p * (m - i + 1)) OVER (PARTITION BY comparison ORDER BY p, kmer)), 6) AS adjusted
FROM (SELECT *, count(*) OVER (PARTITION BY comparison) AS m, row_number() OVER (PARTITION BY comparison ORDER BY p, kmer) AS i FROM sc)""")
def holm(s: SparkSession, d: str) -> DataFrame:
    return groups.holm(_scores(s, d).withColumnRenamed("comparison", "family")).select("family", "kmer", _r(F.col("adjusted")).alias("adjusted"))


@query(RANK_SQL + """SELECT comparison AS family, kmer, round(least(1.0, min(p * m / i) OVER (PARTITION BY comparison ORDER BY p DESC, kmer DESC)), 6) AS adjusted
FROM (SELECT *, count(*) OVER (PARTITION BY comparison) AS m, row_number() OVER (PARTITION BY comparison ORDER BY p, kmer) AS i FROM sc)""")
def bh(s: SparkSession, d: str) -> DataFrame:
    return groups.benjamini_hochberg(_scores(s, d).withColumnRenamed("comparison", "family")).select("family", "kmer", _r(F.col("adjusted")).alias("adjusted"))


BROWSE_SQL = "WITH " + T.SQL_STATS + """, w AS (SELECT kmer, list(round(mean, 3) ORDER BY grp) AS vals FROM st GROUP BY kmer
), c AS (SELECT kmer, list(raw ORDER BY sample) AS counts FROM filled GROUP BY kmer
), rr AS (SELECT w.kmer, vals, counts, [split_part(w.kmer, ' ', 1), split_part(w.kmer, '/', 1)] AS events FROM w JOIN c USING (kmer)
), f AS (SELECT * FROM rr WHERE list_max(vals) >= 5000 AND list_max(counts) >= 50 AND contains(kmer, 'Brand#'))
"""


def _browsed(s: SparkSession, d: str) -> DataFrame:
    values = _stats(s, d).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("grp", F.round("mean", 3).alias("v")))).alias("a"))
    counts = matrix.as_arrays(T.matrix(s, d), T.samples(s, d), "raw_count")
    kmer = F.col("kmer")
    events = F.array(F.substring_index(kmer, " ", 1), F.substring_index(kmer, "/", 1))
    return values.join(counts, "kmer").select("kmer", F.transform("a", lambda x: x["v"]).alias("values"), "counts", events.alias("events"))


REQUEST = browse.Request(search="Brand#", least_score=5000, least_count=50, order="values_1", ascending=False, page_size=20, page=1)


@query(BROWSE_SQL + "SELECT kmer, vals[2] AS second FROM f")
def browse_filter(s: SparkSession, d: str) -> DataFrame:
    return browse.filtered(_browsed(s, d), REQUEST).select("kmer", F.get("values", F.lit(1)).alias("second"))


@query(BROWSE_SQL + "SELECT kmer, vals[2] AS second FROM f ORDER BY vals[2] DESC, kmer LIMIT 20 OFFSET 20")
def browse_page(s: SparkSession, d: str) -> DataFrame:
    return browse.page(_browsed(s, d), REQUEST).select("kmer", F.get("values", F.lit(1)).alias("second"))


@query(BROWSE_SQL + "SELECT (SELECT count(*) FROM rr) AS records_total, (SELECT count(*) FROM f) AS records_filtered")
def browse_totals(s: SparkSession, d: str) -> DataFrame:
    return browse.page_totals(_browsed(s, d), REQUEST)


@query(BROWSE_SQL + """SELECT facet, count(*) FILTER (vis) AS visible, count(*) FILTER (NOT vis) AS hidden
FROM (SELECT unnest(list_distinct(events)) AS facet, kmer IN (SELECT kmer FROM f) AS vis FROM rr) GROUP BY facet""")
def facet_counts(s: SparkSession, d: str) -> DataFrame:
    return browse.facets(_browsed(s, d), REQUEST, "events")




@query("""WITH x AS (SELECT 'Segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'Nation', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT key, value, count(*) AS n FROM x GROUP BY GROUPING SETS ((key), (key, value))""")
def facet_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("Segment"), F.col("c_mktsegment"), F.lit("Nation"), F.col("c_nationkey").cast("string"))
    return browse.tag_facets(T.table(s, d, "customer").select(tags.alias("metadata")))


@query("SELECT o_orderstatus AS chrom, o_orderpriority AS class, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def contingency_cube(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "orders").select(F.col("o_orderstatus").alias("chrom"), F.col("o_orderpriority").alias("class"))
    return browse.contingency(rows, "chrom", "class")


# The overlap graph of all k-mers.
EDGE_SQL = COUNT_SQL.replace("6)", "9)").replace("- 4", "- 7").replace(">= 6", ">= 9") + """, n AS (
  SELECT kmer, max(raw_count) AS score FROM c GROUP BY kmer
), j AS (
  SELECT a.kmer AS src, b.kmer AS dst, s.shift FROM n a CROSS JOIN (VALUES (1), (2)) s(shift) JOIN n b ON substr(a.kmer, s.shift + 1) = substr(b.kmer, 1, 9 - s.shift)
), p AS (SELECT src, shift, count(*) AS partners FROM j GROUP BY 1, 2
), one AS (SELECT src, arg_min(partners, shift) AS partners, min(shift) AS shift FROM p GROUP BY src
), e AS (SELECT j.src, j.dst, j.shift FROM j JOIN one ON one.src = j.src AND one.shift = j.shift WHERE one.partners < 4 AND j.src <> j.dst)
"""


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return matrix.count_kmers(T.reads(s, d), 9).groupBy("kmer").agg(F.max("raw_count").cast("double").alias("score"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.overlap_edges(_nodes(s, d), 9, reach=2)


@query(EDGE_SQL + "SELECT src, dst, CAST(shift AS INT) AS shift FROM e")
def overlap_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


@query(EDGE_SQL + """SELECT kmer, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS kmer, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY kmer""")
def overlap_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(s, d))


@query(EDGE_SQL + "SELECT kmer FROM n WHERE kmer NOT IN (SELECT dst FROM e)")
def graph_roots(s: SparkSession, d: str) -> DataFrame:
    return graph.roots(_nodes(s, d), _edges(s, d))


# Components keep one row a k-mer, whose label only ever falls.
COMPONENT_SQL = EDGE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, bi AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e
), cc(kmer, component) USING KEY (kmer) AS (
  SELECT a AS kmer, min(least(a, b)) AS component FROM bi GROUP BY a
  UNION
  SELECT x.kmer, x.component FROM (SELECT bi.a AS kmer, min(cc.component) AS component FROM cc JOIN bi ON bi.b = cc.kmer GROUP BY bi.a) x
  JOIN recurring.cc r ON r.kmer = x.kmer WHERE x.component < r.component
), dg AS (SELECT kmer, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM (SELECT src AS kmer, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY kmer
), ty AS (
  SELECT component, count(*) AS n_nodes, CASE WHEN max(greatest(o, i)) > 1 THEN 'complex' ELSE 'linear' END || CASE WHEN min(i) > 0 THEN '_circular' ELSE '' END AS graph_type
  FROM cc JOIN dg USING (kmer) GROUP BY component
)
"""


def _typed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..storage import stored

    edges = stored(_edges(s, d), "edges")
    return edges, graph.components(edges)


@query(COMPONENT_SQL + "SELECT component, count(*) AS n_nodes FROM cc GROUP BY component")
def component_sizes(s: SparkSession, d: str) -> DataFrame:
    return _typed(s, d)[1].groupBy("component").agg(F.count("*").alias("n_nodes"))


@query(COMPONENT_SQL + "SELECT component, n_nodes, graph_type FROM ty")
def component_type(s: SparkSession, d: str) -> DataFrame:
    edges, parts = _typed(s, d)
    return graph.component_types(parts, edges)


@query(COMPONENT_SQL + "SELECT graph_type, count(*) AS n_graphs, sum(n_nodes)::BIGINT AS n_nodes FROM ty GROUP BY graph_type")
def component_type_counts(s: SparkSession, d: str) -> DataFrame:
    edges, parts = _typed(s, d)
    return graph.type_counts(graph.component_types(parts, edges))


@query(COMPONENT_SQL + "SELECT component, arg_max(kmer, (score, kmer)) AS best_kmer, max(score)::DOUBLE AS best_score FROM cc JOIN n USING (kmer) GROUP BY component")
def component_best(s: SparkSession, d: str) -> DataFrame:
    return graph.best_per_component(_typed(s, d)[1], _nodes(s, d))


@query()
def assemble_sequences(s: SparkSession, d: str) -> DataFrame:
    edges, parts = _typed(s, d)
    nodes = _nodes(s, d).select("kmer", F.array("score").alias("scores"))
    chosen = graph.seeds(nodes, parts, 2.0)
    return graph.assemble(nodes, graph.cut_circles(edges, parts, chosen), parts.join(chosen, "component", "left_semi"), 9, 2.0)


@query(COMPONENT_SQL + """, met AS (SELECT kmer, score FROM n WHERE score >= 3 UNION SELECT kmer, score FROM (SELECT kmer, score FROM n ORDER BY score DESC, kmer LIMIT 11))
SELECT component, arg_min(kmer, (-score, kmer)) AS seed, 0 AS comparison, max(score)::DOUBLE AS score FROM met JOIN cc USING (kmer) GROUP BY component""")
def component_seeds(s: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(s, d).select("kmer", F.array("score").alias("scores"))
    return graph.seeds(nodes, _typed(s, d)[1], 3.0)


INTERVAL_SQL = "WITH " + T.SQL_INTERVALS


@query(INTERVAL_SQL + """SELECT a.chrom, a.a_id, a.start AS a_start, a."end" AS a_end, b.b_id, b.start AS b_start, b."end" AS b_end
FROM a LEFT JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" """)
def interval_overlap_loj(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_join(T.intervals_a(s, d), T.intervals_b(s, d), outer=True)


@query(INTERVAL_SQL + """SELECT a.chrom, a.a_id, a.start AS a_start, a."end" AS a_end, b.b_id, b.start AS b_start, b."end" AS b_end
FROM a JOIN b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" """)
def interval_overlap_closed(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_join(T.intervals_a(s, d), T.intervals_b(s, d), closed=True)


@query(INTERVAL_SQL + """, w AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT chrom, start, "end" FROM b)
), i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT chrom, min(start) AS start, max("end") AS "end" FROM i GROUP BY chrom, island""")
def interval_union(s: SparkSession, d: str) -> DataFrame:
    return intervals.merged(T.intervals_b(s, d), ["chrom"])


@query(INTERVAL_SQL + """, o AS (
  SELECT DISTINCT a.a_id, a.start AS s0, a."end" AS e0, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"
), w AS (SELECT *, max("end") OVER (PARTITION BY a_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o
), i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY a_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM w
), u AS (SELECT a_id, s0, e0, min(start) AS start, max("end") AS "end" FROM i GROUP BY a_id, s0, e0, island)
SELECT a_id, floor(sum("end" - start) * 10000 / nullif(e0 - s0, 0)) / 100.0 AS coverage FROM u GROUP BY a_id, s0, e0""")
def interval_coverage(s: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(T.intervals_a(s, d), T.intervals_b(s, d))


@query(INTERVAL_SQL + """SELECT * FROM a WHERE chrom = 'O' AND start <= 1900 AND "end" >= 500""")
def window_lookup(s: SparkSession, d: str) -> DataFrame:
    return intervals.window_lookup(T.intervals_a(s, d), "O", 1000, 1400)


@query("""WITH x AS (SELECT conv_id, turn, role || ':' || turn || ';' || role AS tags FROM conversations)
SELECT conv_id, turn, role, CAST(turn AS VARCHAR) AS of_role, role AS of_group FROM conversations""")
def metadata_parse(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "conversations")
    tags = K.metadata_map(F.concat("role", F.lit(":"), F.col("turn").cast("string"), F.lit(";"), "role"))
    return rows.select("conv_id", "turn", "role", tags.alias("m")).select("conv_id", "turn", "role", F.col("m")[F.col("role")].alias("of_role"), F.col("m")["Group"].alias("of_group"))


@query("WITH " + T.SQL_M + "SELECT c_mktsegment AS grp, replace(n_name, ' ', '_') AS sample, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def matrix_from_tag(s: SparkSession, d: str) -> DataFrame:
    """Samples regrouped by the value of a tag."""
    c, n = T.table(s, d, "customer"), T.table(s, d, "nation")
    tagged = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_name", F.create_map(F.lit("Segment"), F.col("c_mktsegment")).alias("metadata"))
    return tagged.groupBy(F.col("metadata")["Segment"].alias("grp"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("sample")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_samples_anti(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "customer").select("c_custkey").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def manifest_semi(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "customer").select("c_custkey", "c_name").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


def _first_nodes(s: SparkSession, d: str) -> DataFrame:
    e = T.table(s, d, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("weights")).select(F.col("label").alias("node"), "weights")


NODE_SQL = """WITH nodes AS (SELECT label AS node, arg_min(embedding, vec_id) AS w FROM embeddings GROUP BY label
), dist AS (
  SELECT vec_id, node, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(embedding[i]::DOUBLE - w[i]::DOUBLE, 2)))), 9) AS d FROM embeddings CROSS JOIN nodes
), near AS (SELECT vec_id, arg_min(node, (d, node)) AS node, min(d) AS d FROM dist GROUP BY vec_id)
"""


@query(NODE_SQL + "SELECT vec_id, node, round(d, 6) AS distance FROM near")
def nearest_node(s: SparkSession, d: str) -> DataFrame:
    found = similarity.nearest_node(_first_nodes(s, d), T.table(s, d, "embeddings"))
    return found.withColumn("distance", _r(F.col("distance")))


@query(NODE_SQL + "SELECT e.label, near.node, count(*) AS n FROM near JOIN embeddings e USING (vec_id) GROUP BY 1, 2")
def class_cluster_counts(s: SparkSession, d: str) -> DataFrame:
    e = T.table(s, d, "embeddings")
    found = similarity.nearest_node(_first_nodes(s, d), e)
    return found.join(e.select("vec_id", "label"), "vec_id").groupBy("label", "node").agg(F.count("*").alias("n"))


@query("WITH " + T.SQL_M + """, rows_ AS (SELECT kmer, list(raw::DOUBLE ORDER BY sample) AS x FROM filled GROUP BY kmer
), nodes AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS node, x AS w FROM rows_ ORDER BY kmer LIMIT 6
), dist AS (
  SELECT kmer, node, round(sqrt(list_sum(list_transform(range(1, 26), lambda i: power(x[i] - w[i], 2)))), 9) AS d FROM rows_ CROSS JOIN nodes
), bmu AS (SELECT kmer, CAST(arg_min(node, (d, node)) AS INT) AS node FROM dist GROUP BY kmer)
SELECT sample, node, round(sum(value), 4) AS total FROM v JOIN bmu USING (kmer) GROUP BY 1, 2""")
def som_projection(s: SparkSession, d: str) -> DataFrame:
    """Totals by map node; the map's six nodes are the first k-mers' counts."""
    rows = matrix.as_arrays(T.matrix(s, d), T.samples(s, d), "raw_count")
    first = [r[0] for r in rows.orderBy("kmer").limit(6).select("counts").collect()]  # the map
    nodes = s.createDataFrame(list(enumerate(first)), "node int, weights array<double>")
    bmu = similarity.nearest_node(nodes, rows.select(F.col("kmer").alias("vec_id"), F.col("counts").alias("embedding")))
    return models.projection(_normal(s, d), bmu.select(F.col("vec_id").alias("kmer"), "node")).withColumn("total", _r(F.col("total"), 4))


@query("WITH " + T.SQL_M + """SELECT a.sample AS s1, b.sample AS s2, round(sqrt(sum(power(a.x - b.x, 2))), 3) AS distance FROM filled a JOIN filled b ON a.kmer = b.kmer AND a.sample < b.sample GROUP BY 1, 2""")
def euclidean_distance(s: SparkSession, d: str) -> DataFrame:
    """Of sample columns."""
    names = F.array(*map(F.lit, _names(s, d)))
    pairs = similarity.column_distances(matrix.as_arrays(_normal(s, d), T.samples(s, d)))
    return pairs.select(F.get(names, "i").alias("s1"), F.get(names, "j").alias("s2"), _r(F.col("distance"), 3).alias("distance"))


@query("""WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)
), c AS (SELECT label AS cl, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY 1, 2
), f AS (SELECT x.vec_id, x.label, c.cl, max(c.n) AS n, max(c.n) * sum(x.x * x.x) - 2 * sum(x.x * c.s) + sum(c.q) AS t FROM x JOIN c ON c.i = x.i GROUP BY 1, 2, 3
), ab AS (SELECT vec_id, label, max(CASE WHEN cl = label THEN t / (n - 1) END) AS a, min(CASE WHEN cl <> label THEN t / n END) AS b FROM f GROUP BY 1, 2)
SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM ab""")
def silhouette(s: SparkSession, d: str) -> DataFrame:
    return similarity.silhouette(T.table(s, d, "embeddings")).withColumn("silhouette", _r(F.col("silhouette"), 5))


@query("WITH " + T.SQL_M + "SELECT sample, kmer, round(raw_count / sqrt(sum(raw_count::DOUBLE * raw_count) OVER (PARTITION BY sample)), 6) AS value FROM m")
def l2_normalise(s: SparkSession, d: str) -> DataFrame:
    return similarity.l2_normalised(T.matrix(s, d)).select("sample", "kmer", _r(F.col("value")).alias("value"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings
), g AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)
), z AS (SELECT least, CASE WHEN CAST(floor(least * 0.25) AS INT) < 2 AND least > 5 THEN 2 ELSE CAST(floor(least * 0.25) AS INT) END AS t FROM g)
SELECT vec_id, label, CASE WHEN i <= least - t THEN 'train' WHEN i <= least THEN 'test' ELSE 'unused' END AS part FROM r, z""")
def balanced_split(s: SparkSession, d: str) -> DataFrame:
    return reduce.balanced_split(T.table(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.25)


def _array_rows(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    of = [r[1] for r in T.samples(s, d).orderBy("sample").collect()]  # a matrix header
    return matrix.as_arrays(_normal(s, d), T.samples(s, d)), of


@query()
def reduce_nb(s: SparkSession, d: str) -> DataFrame:
    rows, of = _array_rows(s, d)
    return reduce.accurate(reduce.pairwise_score(rows, of), 55.0)


@query()
def reduce_adaptive(s: SparkSession, d: str) -> DataFrame:
    rows, of = _array_rows(s, d)
    return reduce.reduce_adaptive(rows, of, 55.0)


@query("WITH " + T.SQL_STATS + """SELECT kmer, CAST(row_number() OVER (PARTITION BY kmer ORDER BY grp) - 1 AS INT) AS comparison,
  round(mean, 4) AS raw, round(round(mean, 4) * 100 / max(round(mean, 4)) OVER (PARTITION BY grp), 4) AS score FROM st""")
def rescaled_scores(s: SparkSession, d: str) -> DataFrame:
    means = _stats(s, d).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("grp", F.round("mean", 4).alias("v")))).alias("a"))
    out = reduce.rescaled_scores(means.select("kmer", F.transform("a", lambda x: x["v"]).alias("acc")))
    return out.withColumn("score", _r(F.col("score"), 4))


@query()
def rf_importance(s: SparkSession, d: str) -> DataFrame:
    return models.importances(T.table(s, d, "embeddings"))


@query()
def kmeans(s: SparkSession, d: str) -> DataFrame:
    return models.kmeans_merged(T.table(s, d, "embeddings"), 10, 20)


@query()
def som_bmu(s: SparkSession, d: str) -> DataFrame:
    e = T.table(s, d, "embeddings")
    return similarity.nearest_node(models.train_som(e, 4, 3, 6), e)


@query()
def classifier_accuracy(s: SparkSession, d: str) -> DataFrame:
    e = reduce.balanced_split(T.table(s, d, "embeddings"), "label", "vec_id", 0.25, seed=3)
    return models.accuracy(models.predicted(e.where("part = 'train'"), e.where("part = 'test'"), "logistic"))


@query(NODE_SQL + "SELECT e.label::DOUBLE AS label, near.node::DOUBLE AS prediction, count(*) AS n FROM near JOIN embeddings e USING (vec_id) GROUP BY 1, 2")
def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    """Labels against those of the nearest first vector."""
    e = T.table(s, d, "embeddings")
    near = similarity.nearest_node(_first_nodes(s, d), e).select("vec_id", F.col("node").cast("double").alias("prediction"))
    return models.confusion(e.select("vec_id", F.col("label").cast("double").alias("label")).join(near, "vec_id"))


@query("WITH " + T.SQL_M + """, a AS (SELECT kmer, split_part(kmer, '/', 1) AS gene, list(raw ORDER BY sample) AS x, max(raw) AS score FROM filled GROUP BY 1, 2
), p AS (SELECT a.kmer AS i, b.kmer AS j, a.score AS si, b.score AS sj, (SELECT corr(a.x[t.k], b.x[t.k]) FROM unnest(range(1, 26)) t(k)) AS r FROM a JOIN a b ON a.gene = b.gene AND a.kmer < b.kmer)
SELECT DISTINCT CASE WHEN si > sj THEN j ELSE i END AS kmer FROM p WHERE r > 0.4""")
def correlation_collapse(s: SparkSession, d: str) -> DataFrame:
    rows = matrix.as_arrays(T.matrix(s, d), T.samples(s, d), "raw_count")
    return graph.correlated_losers(rows.select("kmer", F.substring_index("kmer", "/", 1).alias("gene"), F.array_max("counts").alias("score"), F.col("counts").alias("x")), 0.4)


@query("WITH " + T.SQL_M + "SELECT sample, kmer, raw_count FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY raw_count DESC, kmer) AS i FROM m) WHERE i <= 5")
def top_features(s: SparkSession, d: str) -> DataFrame:
    ranked = groups.numbered(T.matrix(s, d), ["sample"], [F.desc("raw_count"), F.asc("kmer")], "i")
    return ranked.where("i <= 5").select("sample", "kmer", "raw_count")


@query("WITH " + T.SQL_M + """SELECT sample, quantile_cont(raw_count, 0.5) AS median, round(avg(raw_count), 5) AS mean, round(var_samp(raw_count), 3) AS variance,
  round(stddev_samp(raw_count) / sqrt(count(*)), 5) AS stderr FROM m GROUP BY 1""")
def column_statistics(s: SparkSession, d: str) -> DataFrame:
    c = F.col("raw_count")
    return T.matrix(s, d).groupBy("sample").agg(
        F.percentile(c, F.lit(0.5)).alias("median"), _r(F.avg(c), 5).alias("mean"), _r(F.var_samp(c), 3).alias("variance"),
        _r(F.stddev_samp(c) / F.sqrt(F.count("*")), 5).alias("stderr"),
    )


@query("WITH " + T.SQL_M + """SELECT kmer, list(DISTINCT grp ORDER BY grp) AS grps, list_has_any(list(DISTINCT grp), ['ASIA']) AS in_asia FROM m WHERE raw_count >= 150 GROUP BY kmer""")
def winner_events(s: SparkSession, d: str) -> DataFrame:
    """One row a k-mer with the set of what it stands for."""
    rows = T.matrix(s, d).where("raw_count >= 150").groupBy("kmer").agg(F.array_sort(F.collect_set("grp")).alias("grps"))
    return rows.withColumn("in_asia", F.arrays_overlap("grps", F.array(F.lit("ASIA"))))


@query("""SELECT l_linestatus AS chrom, l_partkey AS position, l_returnflag AS kind, max(l_extendedprice) AS best_score,
  arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS best_kmer, bool_and(l_discount > 0.02) AS generates_event FROM lineitem GROUP BY 1, 2, 3""")
def signature_merge(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "lineitem").select(
        F.col("l_linestatus").alias("chrom"), F.col("l_partkey").alias("position"), F.col("l_returnflag").alias("kind"),
        F.col("l_orderkey").alias("kmer"), F.col("l_extendedprice").alias("score"), (F.col("l_discount") > 0.02).alias("generates_event"),
    )
    return annotation.merged_signatures(rows).select("chrom", "position", "kind", "best_score", "best_kmer", "generates_event")


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS gene, l_partkey AS start, l_orderkey % 97 AS e FROM lineitem)
SELECT a.gene, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.gene = b.gene AND a.id < b.id AND (a.start = b.start) <> (a.e = b.e)""")
def shared_splice_ends(s: SparkSession, d: str) -> DataFrame:
    rows = T.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("start"), (F.col("l_orderkey") % 97).alias("end")
    )
    return annotation.shared_splice_ends(rows)


@query("WITH " + T.SQL_STATS + """, w AS (SELECT kmer, list(round(mean, 3) ORDER BY grp) AS means FROM st GROUP BY kmer), m1 AS (SELECT kmer, count(*) AS n FROM m GROUP BY kmer)
SELECT kmer, CASE WHEN n = 1 THEN 0 ELSE 1 END AS repetitive, CAST(CASE WHEN list_max(means) > 0 THEN list_position(means, list_max(means)) - 1 ELSE -1 END AS INT) AS class FROM w JOIN m1 USING (kmer)""")
def ideogram(s: SparkSession, d: str) -> DataFrame:
    means = _stats(s, d).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("grp", F.round("mean", 3).alias("v")))).alias("a"))
    places = T.matrix(s, d).groupBy("kmer").agg(F.collect_list("sample").alias("alignments"))
    return annotation.ideogram(means.join(places, "kmer").select("kmer", "alignments", F.transform("a", lambda x: x["v"]).alias("means")))
