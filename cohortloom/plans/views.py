"""Queries of views, filters, annotation and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import annotation, browse, groups, intervals, matrix, models, similarity
from . import queries as Q
from . import tables as T
from .queries import _browsed, _normal, _r, _stats, query


@query("WITH " + T.SQL_STATS + """, w AS (SELECT kmer, list(round(mean, 3) ORDER BY grp) AS vals FROM st GROUP BY kmer)
SELECT kmer, vals FROM w WHERE list_max(vals) >= 7000""")
def load_threshold(s: SparkSession, d: str) -> DataFrame:
    """K-mers of which any score reaches the threshold."""
    rows = _browsed(s, d).select("kmer", F.col("values").alias("vals"))
    return rows.where(F.exists("vals", lambda v: v >= 7000))


@query("WITH " + T.SQL_M + """, a AS (SELECT kmer, list(raw::DOUBLE ORDER BY raw) AS x FROM filled GROUP BY kmer)
SELECT kmer, [x[CAST(round(len(x) * 0.25) AS INT) + 1], x[CAST(round(len(x) * 0.5) AS INT) + 1], x[CAST(round(len(x) * 0.75) AS INT) + 1]] AS quartiles FROM a""")
def quartiles(s: SparkSession, d: str) -> DataFrame:
    rows = matrix.as_arrays(T.matrix(s, d), T.samples(s, d), "raw_count")
    return rows.select("kmer", S.quartiles(F.col("counts")).alias("quartiles"))


def _two_groups(s: SparkSession, d: str) -> DataFrame:
    a, b = (_stats(s, d).select("kmer", *[F.col(c).alias(f"{c}_{x}") for c in ("grp", "n", "mean", "sd")]) for x in "ab")
    return a.join(b, "kmer").where("grp_a < grp_b")


@query("WITH " + T.SQL_STATS + """SELECT a.kmer, a.grp AS grp_a, b.grp AS grp_b,
  round((a.mean - b.mean) / nullif(sqrt(((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 0), 4) + 0.0 AS t
FROM st a JOIN st b ON a.kmer = b.kmer AND a.grp < b.grp""")
def pooled_t(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = S.pooled_t(c("mean_a"), c("sd_a") * c("sd_a"), c("n_a"), c("mean_b"), c("sd_b") * c("sd_b"), c("n_b"))
    return _two_groups(s, d).select("kmer", "grp_a", "grp_b", _r(t, 4).alias("t"))


@query("WITH " + T.SQL_STATS + """SELECT a.kmer, a.grp AS grp_a, b.grp AS grp_b, CASE WHEN a.mean = 0 AND b.mean = 0 THEN 0.0 WHEN least(a.mean, b.mean) = 0 THEN CAST('inf' AS DOUBLE)
  ELSE round(greatest(a.mean, b.mean) / least(a.mean, b.mean), 5) END AS max_fold FROM st a JOIN st b ON a.kmer = b.kmer AND a.grp < b.grp""")
def max_fold(s: SparkSession, d: str) -> DataFrame:
    return _two_groups(s, d).select("kmer", "grp_a", "grp_b", F.round(S.max_fold(F.col("mean_a"), F.col("mean_b")), 5).alias("max_fold"))


@query("WITH " + T.SQL_STATS + "SELECT kmer, grp, round(-log10(1 / (1 + round(sd, 4))), 6) + 0.0 AS minus_log10 FROM st")
def minus_log10(s: SparkSession, d: str) -> DataFrame:
    return _stats(s, d).select("kmer", "grp", _r(S.minus_log10(1 / (1 + F.round("sd", 4)))).alias("minus_log10"))


@query(Q.NODE_SQL + "SELECT doc_id, lang, near.node FROM documents LEFT JOIN near ON near.vec_id = doc_id")
def link_to_node(s: SparkSession, d: str) -> DataFrame:
    """Rows with the map node of their vector, where they have one."""
    near = similarity.nearest_node(Q._first_nodes(s, d), T.table(s, d, "embeddings")).select(F.col("vec_id").alias("doc_id"), "node")
    return T.table(s, d, "documents").select("doc_id", "lang").join(near, "doc_id", "left")


@query(Q.RANK_SQL + """, br AS (SELECT kmer, CAST(min(r) AS INT) AS best_rank FROM (SELECT kmer, row_number() OVER (PARTITION BY comparison ORDER BY score DESC, p, kmer) - 1 AS r FROM sc) GROUP BY kmer
), w AS (SELECT kmer, list(DISTINCT grp ORDER BY grp) AS events FROM m WHERE raw_count >= 150 GROUP BY kmer
), mx AS (SELECT kmer, max(raw_count) AS max_count FROM m GROUP BY kmer HAVING max(raw_count) >= 200)
SELECT k.kmer, best_rank, events, max_count FROM (SELECT DISTINCT kmer FROM m) k LEFT JOIN br USING (kmer) LEFT JOIN w USING (kmer) LEFT JOIN mx USING (kmer)""")
def enriched_records(s: SparkSession, d: str) -> DataFrame:
    """Every k-mer with its best rank, events and greatest count, where it has them."""
    long = T.matrix(s, d)
    events = long.where("raw_count >= 150").groupBy("kmer").agg(F.array_sort(F.collect_set("grp")).alias("events"))
    rows = long.select("kmer").distinct().join(groups.best_rank(Q._scores(s, d)), "kmer", "left")
    return rows.join(events, "kmer", "left").join(matrix.min_count(long, 200), "kmer", "left")


@query(Q.BROWSE_SQL + "SELECT DISTINCT gene FROM (SELECT unnest(events) AS gene FROM f) WHERE gene <> ''")
def visible_genes(s: SparkSession, d: str) -> DataFrame:
    return browse.filtered(_browsed(s, d), Q.REQUEST).select(F.explode("events").alias("gene")).where("gene <> ''").distinct()


@query("WITH " + T.SQL_M + "SELECT sample, split_part(kmer, '/', 1) AS gene, CAST(sum(raw_count) AS BIGINT) AS raw_count FROM m GROUP BY 1, 2")
def gene_rollup(s: SparkSession, d: str) -> DataFrame:
    return T.matrix(s, d).groupBy("sample", F.substring_index("kmer", "/", 1).alias("gene")).agg(F.sum("raw_count").alias("raw_count"))


@query("SELECT c_mktsegment AS matrix, n_name AS grp, count(*) AS n_samples FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def samples_per_group(s: SparkSession, d: str) -> DataFrame:
    """Samples of each matrix by group."""
    c, n = T.table(s, d, "customer"), T.table(s, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("c_mktsegment").alias("matrix"), F.col("n_name").alias("grp")).agg(F.count("*").alias("n_samples"))


@query("WITH " + T.SQL_M + "SELECT kmer, count(*) FILTER (raw >= 20) AS n_known FROM filled GROUP BY kmer HAVING count(*) FILTER (raw >= 20) > 5 * 0.5")
def known_share_mask(s: SparkSession, d: str) -> DataFrame:
    """K-mers known in more samples than a share of the smallest group; counts under 20
    stand for unknown."""
    least = min(n for _, n in groups.group_sizes(T.samples(s, d)))
    known = T.matrix(s, d).groupBy("kmer").agg(F.count_if(F.col("raw_count") >= 20).alias("n_known"))
    return known.where(F.col("n_known") > least * 0.5)


@query(Q.RANK_SQL + """, sig AS (SELECT comparison, kmer, score, p FROM sc WHERE p < 0.00015
), few AS (SELECT c.comparison, count(s.kmer) AS n FROM (SELECT DISTINCT comparison FROM sc) c LEFT JOIN sig s ON s.comparison = c.comparison GROUP BY 1
), r AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p, kmer) AS i FROM sc)
SELECT r.comparison, r.kmer, r.p < 0.00015 AS significant FROM r JOIN few USING (comparison) WHERE CASE WHEN n > 20 THEN r.p < 0.00015 ELSE i <= 100 END""")
def significant_or_top(s: SparkSession, d: str) -> DataFrame:
    """Significant rows of a comparison, or its first hundred where there are 20 or fewer."""
    scores = Q._scores(s, d)
    few = scores.groupBy("comparison").agg(F.count_if(F.col("p") < 0.00015).alias("n"))
    ranked = groups.numbered(scores, ["comparison"], [F.asc("p"), F.asc("kmer")], "i").join(few, "comparison")
    kept = ranked.where(F.when(F.col("n") > 20, F.col("p") < 0.00015).otherwise(F.col("i") <= 100))
    return kept.select("comparison", "kmer", (F.col("p") < 0.00015).alias("significant"))


@query(Q.RANK_SQL + "SELECT DISTINCT kmer FROM (SELECT kmer, row_number() OVER (PARTITION BY comparison ORDER BY score DESC, kmer) AS i FROM sc) WHERE i <= 10")
def feature_union(s: SparkSession, d: str) -> DataFrame:
    """The ten best features of each comparison, together."""
    ranked = groups.numbered(Q._scores(s, d), ["comparison"], [F.desc("score"), F.asc("kmer")], "i")
    return ranked.where("i <= 10").select("kmer").distinct()


@query(Q.INTERVAL_SQL + """SELECT a.a_id, b.b_id, CASE WHEN a.start = b.start AND a."end" = b."end" THEN 'equal' WHEN a.start <= b.start AND a."end" >= b."end" THEN 'contains'
  WHEN a.start >= b.start AND a."end" <= b."end" THEN 'within' WHEN a.start < b."end" AND b.start < a."end" THEN 'overlaps' ELSE 'apart' END AS relation
FROM a JOIN b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" """)
def segment_relations(s: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlap_join(T.intervals_a(s, d), T.intervals_b(s, d), closed=True)
    c = F.col
    return pairs.select("a_id", "b_id", annotation.segment_relation(c("a_start"), c("a_end"), c("b_start"), c("b_end")).alias("relation"))


GENE_SQL = """WITH ex AS (
  SELECT l_orderkey AS chrom, l_orderkey % 97 AS gene_id, l_orderkey AS transcript_id, l_linenumber * 200 + l_partkey % 50 AS start, l_linenumber * 200 + l_partkey % 50 + 40 + l_suppkey % 60 AS "end" FROM lineitem
), al AS (
  SELECT l_orderkey AS chrom, l_suppkey * 7 % 1500 AS start, l_suppkey * 7 % 1500 + CAST(l_quantity AS BIGINT) * 3 AS "end", l_orderkey * 10 + l_linenumber AS b_id, l_partkey AS kmer, l_extendedprice AS score FROM lineitem
), it AS (
  SELECT chrom, gene_id, transcript_id, before AS start, start AS "end" FROM (
    SELECT *, max("end") OVER (PARTITION BY transcript_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ex) WHERE before < start
), parts AS (
  SELECT 'i' AS kind, * FROM it UNION ALL SELECT DISTINCT 'e', * FROM ex
), o AS (
  SELECT p.kind, p.gene_id, p.transcript_id, p.start AS s0, p."end" AS e0, greatest(p.start, al.start) AS start, least(p."end", al."end") AS "end", b_id, kmer, score
  FROM parts p JOIN al ON p.chrom = al.chrom AND p.start < al."end" AND al.start < p."end"
), w AS (
  SELECT *, max("end") OVER (PARTITION BY kind, gene_id, transcript_id, s0, e0 ORDER BY start, "end", b_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o
), cov AS (
  SELECT kind, gene_id, transcript_id, s0, e0, sum(greatest("end" - greatest(start, coalesce(before, start)), 0)) AS covered, floor(covered * 10000 / (e0 - s0)) / 100.0 AS coverage
  FROM w GROUP BY 1, 2, 3, 4, 5
), tr AS (
  SELECT e.gene_id, e.transcript_id, floor(sum(coalesce(c.covered, 0)) * 10000 / sum(e."end" - e.start)) / 100.0 AS coverage
  FROM (SELECT DISTINCT * FROM ex) e LEFT JOIN cov c ON c.kind = 'e' AND c.transcript_id = e.transcript_id AND c.s0 = e.start AND c.e0 = e."end" GROUP BY 1, 2
)
"""


def _exons(s: SparkSession, d: str) -> DataFrame:
    start = F.col("l_linenumber") * 200 + F.col("l_partkey") % 50
    return T.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("chrom"), (F.col("l_orderkey") % 97).alias("gene_id"), F.col("l_orderkey").alias("transcript_id"),
        start.alias("start"), (start + 40 + F.col("l_suppkey") % 60).alias("end"),
    )


def _blocks(s: SparkSession, d: str) -> DataFrame:
    start = F.col("l_suppkey") * 7 % 1500
    return T.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("b_id"),
        F.col("l_partkey").alias("kmer"), F.col("l_extendedprice").alias("score"),
    )


@query(GENE_SQL + "SELECT gene_id, transcript_id, s0 AS start, e0 AS \"end\", coverage FROM cov WHERE kind = 'i'")
def intron_coverage(s: SparkSession, d: str) -> DataFrame:
    return annotation.intron_coverage(_exons(s, d), _blocks(s, d))


@query(GENE_SQL + "SELECT gene_id, transcript_id, coverage FROM tr")
def gene_coverage(s: SparkSession, d: str) -> DataFrame:
    return annotation.transcript_coverage(_exons(s, d), _blocks(s, d))


SPLICE_SQL = """, sp AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 97 AS gene, l_partkey AS start, 1000000 + l_suppkey * 7 + l_linenumber AS "end", l_partkey AS kmer, l_extendedprice AS score FROM lineitem
), gb AS (SELECT gene_id, arg_min(kmer, (-score, kmer)) AS best_kmer, max(score) AS best_score FROM o WHERE kind = 'e' GROUP BY gene_id)
"""


def _splices(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 97).alias("gene"), F.col("l_partkey").alias("start"),
        (1000000 + F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("end"), F.col("l_partkey").alias("kmer"), F.col("l_extendedprice").alias("score"),
    )


@query(GENE_SQL + SPLICE_SQL + """, known AS (
  SELECT DISTINCT gene_id, 'intron' AS event, best_kmer FROM (
    SELECT o.gene_id, o.transcript_id, o.s0, o.e0, arg_min(kmer, (-score, kmer)) AS best_kmer FROM o
    JOIN cov ON cov.kind = 'i' AND o.kind = 'i' AND cov.transcript_id = o.transcript_id AND cov.s0 = o.s0 AND cov.e0 = o.e0 AND cov.gene_id = o.gene_id WHERE coverage > 60 GROUP BY 1, 2, 3, 4)
  UNION ALL SELECT o.gene_id, 'DE', arg_min(kmer, (-score, kmer)) FROM o JOIN tr ON o.kind = 'e' AND tr.transcript_id = o.transcript_id AND tr.gene_id = o.gene_id WHERE coverage > 60 GROUP BY 1
  UNION ALL SELECT DISTINCT a.gene, 'multiple_splice_junctions', CASE WHEN b.score > a.score THEN b.kmer ELSE a.kmer END
  FROM sp a JOIN sp b ON a.gene = b.gene AND a.id < b.id AND (a.start = b.start) <> (a."end" = b."end")
)
SELECT * FROM known UNION ALL SELECT gene_id, 'gene', best_kmer FROM gb WHERE (gene_id, best_kmer) NOT IN (SELECT gene_id, best_kmer FROM known)""")
def gene_events(s: SparkSession, d: str) -> DataFrame:
    return annotation.gene_events(_exons(s, d), _blocks(s, d), _splices(s, d), 60.0)


@query(GENE_SQL + SPLICE_SQL + "SELECT sp.id, sp.gene AS gene_id, sp.score > 20000 AND coalesce(sp.score >= best_score - 3000, true) AS generates_event FROM sp LEFT JOIN gb ON gb.gene_id = sp.gene")
def signature_gate(s: SparkSession, d: str) -> DataFrame:
    """Signatures far below their gene's best k-mer generate no event; scores are prices."""
    signatures = _splices(s, d).select("id", F.col("gene").alias("gene_id"), "score", (F.col("score") > 20000).alias("generates_event"))
    best = annotation.gene_best(_exons(s, d), _blocks(s, d))
    return annotation.gated_signatures(signatures, best, 3000.0).select("id", "gene_id", "generates_event")


@query("""WITH sig AS (SELECT l_linestatus AS chrom, l_partkey AS position, l_returnflag AS kind, arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS best_kmer, bool_and(l_discount > 0.02) AS g FROM lineitem GROUP BY 1, 2, 3
), gn AS (SELECT DISTINCT l_linestatus AS chrom, l_partkey AS position, l_suppkey AS gene FROM lineitem)
SELECT sig.chrom, sig.position, kind || '_borders' AS event, best_kmer, list(DISTINCT gene ORDER BY gene) AS genes FROM sig JOIN gn USING (chrom, position) WHERE g GROUP BY 1, 2, 3, 4""")
def border_events(s: SparkSession, d: str) -> DataFrame:
    genes = T.table(s, d, "lineitem").select(F.col("l_linestatus").alias("chrom"), F.col("l_partkey").alias("position"), F.col("l_suppkey").alias("gene")).distinct()
    return annotation.border_events(Q.signature_merge(s, d), genes)


@query("""WITH al AS (
  SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS id, l_linestatus AS chrom, l_partkey AS t, l_suppkey % 20 AS gap, CAST(l_quantity AS BIGINT) AS pos FROM lineitem
), b AS (
  SELECT rid, id, chrom, pos, i, CASE i WHEN 0 THEN 0 ELSE 25 END AS qs, CASE i WHEN 0 THEN 25 ELSE 60 END AS qe, CASE i WHEN 0 THEN t ELSE t + 25 + gap END AS ts FROM al, range(2) r(i)
), c AS (
  SELECT rid, id, chrom, i, ts + greatest(pos - qs, 0) AS start, ts + (qe - qs) - greatest(qe - (pos + 9), 0) AS "end" FROM b WHERE qs < pos + 9 AND pos < qe
) SELECT id, chrom, string_agg(start || '-' || "end", ',' ORDER BY i) AS blocks FROM c WHERE start < "end" GROUP BY rid, id, chrom""")
def lift_over(s: SparkSession, d: str) -> DataFrame:
    """Nine letters of two-block alignments, by their place in the query."""
    li = T.table(s, d, "lineitem")
    t, gap = F.col("l_partkey"), F.col("l_suppkey") % 20
    block = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    q = F.array(block(F.lit(0), F.lit(25)), block(F.lit(25), F.lit(60)))
    on = F.array(block(t, t + 25), block(t + 25 + gap, t + 60 + gap))
    at = F.col("l_quantity").cast("long")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("chrom"), annotation.lifted(q, on, at, at + 9).alias("b"))
    text = F.concat_ws(",", F.transform("b", lambda x: F.concat(x["start"], F.lit("-"), x["end"])))
    return rows.where("size(b) > 0").select("id", "chrom", text.alias("blocks"))


@query("""WITH sc AS (SELECT l_orderkey AS name, l_linenumber * 9 + l_partkey % 9 AS pos, l_partkey AS kmer, l_extendedprice AS score FROM lineitem
), f AS (SELECT o_orderkey AS name, 80 AS size, 10 + o_custkey % 40 AS start, 14 + o_custkey % 40 AS "end", o_custkey % 3 = 0 AS minus FROM orders
), n0 AS (SELECT *, greatest(start - 4, 0) AS lo0, least("end" + 4, size) AS hi0, greatest(start - 17, 0) AS flo0, least("end" + 17, size) AS fhi0 FROM f
), n AS (SELECT name, start, "end", CASE WHEN minus THEN size - hi0 ELSE lo0 END AS lo, CASE WHEN minus THEN size - lo0 ELSE hi0 END AS hi,
  CASE WHEN minus THEN size - fhi0 ELSE flo0 END AS flo, CASE WHEN minus THEN size - flo0 ELSE fhi0 END AS fhi FROM n0
), j AS (SELECT n.*, sc.pos, sc.kmer, sc.score FROM n JOIN sc USING (name)
), b AS (
  SELECT name, start, "end", arg_max(kmer, (score, -pos, kmer)) FILTER (pos >= lo AND pos + 5 <= hi) AS best_kmer, max(score) FILTER (pos >= lo AND pos + 5 <= hi) AS best_score,
         max(score) FILTER (pos >= flo AND pos + 5 <= lo AND lo - flo > 5) AS l, max(score) FILTER (pos >= hi AND pos + 5 <= fhi AND fhi - hi > 5) AS h FROM j GROUP BY 1, 2, 3
) SELECT name, start, "end", best_kmer, best_score, (l IS NULL OR best_score > l) AND (h IS NULL OR best_score > h) AS generates_event FROM b WHERE best_score IS NOT NULL""")
def best_and_border(s: SparkSession, d: str) -> DataFrame:
    scored = T.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("name"), (F.col("l_linenumber") * 9 + F.col("l_partkey") % 9).alias("at"), F.col("l_partkey").alias("kmer"), F.col("l_extendedprice").alias("score")
    )
    start = F.col("o_custkey") % 40
    features = T.table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.lit(80).alias("size"), (start + 10).alias("start"), (start + 14).alias("end"),
        F.when(F.col("o_custkey") % 3 == 0, "-").otherwise("+").alias("strand"),
    )
    return annotation.best_in_window(scored, features, 5)


@query(Q.NODE_SQL + """, c AS (SELECT e.label, near.node, count(*) AS n FROM near JOIN embeddings e USING (vec_id) GROUP BY 1, 2
), t AS (SELECT label, sum(n) AS support, sum(CASE WHEN label = node THEN n ELSE 0 END) AS hit FROM c GROUP BY 1
), p AS (SELECT node, sum(n) AS named FROM c GROUP BY 1)
SELECT t.label, CAST(support AS BIGINT) AS support, round(hit / support, 6) AS recall, round(hit / named, 6) AS precision FROM t LEFT JOIN p ON p.node = t.label""")
def class_report(s: SparkSession, d: str) -> DataFrame:
    """Recall and precision of each class, vectors being given the label of the nearest
    first vector."""
    return models.class_report(_nearest_labels(s, d)).withColumns({c: _r(F.col(c)) for c in ("recall", "precision")})


def _nearest_labels(s: SparkSession, d: str) -> DataFrame:
    e = T.table(s, d, "embeddings")
    near = similarity.nearest_node(Q._first_nodes(s, d), e).select("vec_id", F.col("node").alias("prediction"))
    return e.select("vec_id", "label").join(near, "vec_id").select("label", "prediction")


@query(Q.NODE_SQL + """, t AS (SELECT e.label, avg(CASE WHEN e.label = near.node THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n, sum(CASE WHEN e.label = near.node THEN 1 ELSE 0 END) AS hit FROM near JOIN embeddings e USING (vec_id) GROUP BY 1)
SELECT round(100.0 * sum(hit) / sum(n), 5) AS accuracy, round(100 * avg(r), 5) AS balanced FROM t""")
def accuracy_summary(s: SparkSession, d: str) -> DataFrame:
    report = models.class_report(_nearest_labels(s, d))
    hit = F.sum(F.col("recall") * F.col("support"))
    return report.agg(_r(100 * hit / F.sum("support"), 5).alias("accuracy"), _r(100 * F.avg("recall"), 5).alias("balanced"))


@query("WITH " + T.SQL_M + """, p AS (SELECT sample, split_part(kmer, '/', 1) AS node, sum(value) AS total FROM v GROUP BY 1, 2)
SELECT sample, node, round((total - min(total) OVER (PARTITION BY node)) / nullif(max(total) OVER (PARTITION BY node) - min(total) OVER (PARTITION BY node), 0), 5) AS share FROM p""")
def node_norms(s: SparkSession, d: str) -> DataFrame:
    """Totals of a node scaled to its least and greatest over samples."""
    rows = _normal(s, d)
    node = rows.select("kmer").distinct().withColumn("node", F.substring_index("kmer", "/", 1))
    return models.node_norms(models.projection(rows, node)).withColumn("share", _r(F.col("share"), 5))
