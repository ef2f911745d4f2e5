"""Queries of model studies and neighbour graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, models, neighbours, reduce, scoring, trees
from . import queries as Q
from . import tables as T

POINTS_SQL = """WITH RECURSIVE p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
), near AS (SELECT a, b, d FROM p WHERE d <= 1.2)
"""


def _points(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


@Q.query(POINTS_SQL + "SELECT a, b, round(d, 6) AS distance FROM near")
def radius_join(s: SparkSession, d: str) -> DataFrame:
    """Every pair of vectors at most 1.2 apart."""
    return neighbours.radius_join(_points(s, d), 1.2).withColumn("distance", Q._r(F.col("distance")))


@Q.query(POINTS_SQL + """, bi AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), cores AS (SELECT vec_id AS core FROM embeddings LEFT JOIN bi ON vec_id = a GROUP BY vec_id HAVING count(b) + 1 >= 4
), link AS (SELECT a, b FROM bi WHERE a IN (SELECT core FROM cores) AND b IN (SELECT core FROM cores)
), reach AS (SELECT core AS a, core AS b FROM cores UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b
), own AS (SELECT a AS core, min(b) AS cluster FROM reach GROUP BY a
), border AS (SELECT a, min(cluster) AS cluster FROM bi JOIN own ON core = b GROUP BY a)
SELECT vec_id AS id, coalesce(own.cluster, border.cluster) AS cluster FROM embeddings LEFT JOIN own ON core = vec_id LEFT JOIN border ON border.a = vec_id""")
def dbscan(s: SparkSession, d: str) -> DataFrame:
    return models.dbscan(_points(s, d), 1.2, 4)


def _target_rows(s: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    """Normalised counts of each feature, and the samples' group numbers, in sample order."""
    rows = matrix.as_arrays(Q._normal(s, d), T.samples(s, d)).select(F.col("kmer").alias("id"), F.col("counts").alias("x"))
    groups = [r["grp"] for r in T.samples(s, d).orderBy("sample").collect()]  # a matrix header
    order = sorted(set(groups))
    return rows, F.array(*[F.lit(float(order.index(g))) for g in groups])


TARGET_SQL = "WITH RECURSIVE " + T.SQL_M + """, g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS y FROM (SELECT DISTINCT grp FROM samples)
), f AS (SELECT kmer AS id, sample, x, y::DOUBLE AS y FROM filled JOIN g USING (grp)
), c AS (SELECT id, round(coalesce(abs(CASE WHEN stddev_pop(x) > 0 THEN corr(x, y) END), 0), 12) AS t FROM f GROUP BY id
), p AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.sample = b.sample AND a.id < b.id GROUP BY 1, 2 HAVING abs(corr(a.x, b.x)) >= 0.5
), ev AS (
  SELECT row_number() OVER (ORDER BY a, b) AS e, CASE WHEN ca.t > cb.t THEN b ELSE a END AS loser, CASE WHEN ca.t > cb.t THEN a ELSE b END AS winner
  FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b
), link AS (SELECT ev.e, any_value(ev.winner) AS follows, max(o.e) AS before FROM ev LEFT JOIN ev o ON o.loser = ev.winner AND o.e < ev.e GROUP BY ev.e
), walk AS (
  SELECT loser AS id, max(e) AS e FROM ev GROUP BY loser
  UNION ALL SELECT walk.id, link.before FROM walk JOIN link ON link.e = walk.e WHERE link.before IS NOT NULL
), ends AS (SELECT id, arg_min(follows, e) AS follows FROM walk JOIN link USING (e) GROUP BY id)
"""


@Q.query(TARGET_SQL + "SELECT id, round(t, 6) AS target_r, follows IS NULL AS kept, coalesce(follows, id) AS follows FROM c LEFT JOIN ends USING (id)")
def reduce_correlated(s: SparkSession, d: str) -> DataFrame:
    """Of features that correlate by 0.5 or more, those less correlated with the group go."""
    rows, target = _target_rows(s, d)
    return neighbours.reduce_correlated(rows, target, 0.5).withColumn("target_r", Q._r(F.col("target_r")))


@Q.query()
def multiclass_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of each feature over all groups at once, by repeated hold-out."""
    rows, _ = _target_rows(s, d)
    groups = [r["grp"] for r in T.samples(s, d).orderBy("sample").collect()]  # a matrix header
    scored = reduce.pairwise_score(rows.select(F.col("id").alias("kmer"), F.col("x").alias("counts")), groups, reduce.multiclass_accuracy)
    return scored.select("kmer", Q._r(F.element_at("acc", 1)).alias("accuracy"))


def _long(s: SparkSession, d: str) -> DataFrame:
    e = T.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "value"))


LONG_SQL = """WITH long AS (
  SELECT vec_id AS sample, label, i - 1 AS feature, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)
)"""
BAG_SQL = LONG_SQL + """, train AS (
  SELECT CASE WHEN feature < 16 THEN 'few' ELSE 'many' END AS study, m AS model, long.* FROM long CROSS JOIN range(5) t(m) WHERE sample % 5 <> m
), st AS (SELECT study, model, label AS class, feature, avg(value) AS c, var_pop(value) + 1e-10 AS v, count(*) AS n FROM train GROUP BY 1, 2, 3, 4
), sz AS (SELECT study, model, class, max(n) AS n FROM st GROUP BY 1, 2, 3
), pr AS (SELECT study, model, class, ln(n / sum(n) OVER (PARTITION BY study, model)) AS prior FROM sz
), sc AS (
  SELECT l.sample, st.study, st.model, st.class, sum(-0.5 * (ln(v) + power(l.value - c, 2) / v)) AS score FROM long l JOIN st ON l.feature = st.feature GROUP BY 1, 2, 3, 4
), sp AS (SELECT sample, study, model, class, score + prior AS score FROM sc JOIN pr USING (study, model, class)
), ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sample, study, model)) AS e FROM sp
), pb AS (SELECT *, e / sum(e) OVER (PARTITION BY sample, study, model) AS p FROM ex
), mean AS (SELECT sample, study, class, avg(p) AS probability FROM pb GROUP BY 1, 2, 3)
"""


def _bagged(s: SparkSession, d: str) -> DataFrame:
    """Ten models: two studies, of few and of many features, with five bags each."""
    bags = F.explode(F.array(*map(F.lit, range(5))))
    train = _long(s, d).withColumn("model", bags).where(F.col("sample") % 5 != F.col("model"))
    return scoring.bayes_models(train.withColumn("study", F.when(F.col("feature") < 16, "few").otherwise("many")))


@Q.query(BAG_SQL + "SELECT sample, study, class, round(probability, 6) AS probability, class = max(struct_pack(p := round(probability, 12), c := class)) OVER (PARTITION BY sample, study).c AS predicted FROM mean")
def bagged_prediction(s: SparkSession, d: str) -> DataFrame:
    long = _long(s, d)
    found = scoring.predictions(_bagged(s, d), long.select("sample", "feature", "value"), long.select("sample"))
    return found.withColumn("probability", Q._r(F.col("probability")))


@Q.query(BAG_SQL + "SELECT sample, study, class, round(probability, 6) AS probability, class = max(struct_pack(p := round(probability, 12), c := class)) OVER (PARTITION BY sample, study).c AS predicted FROM mean WHERE sample = (SELECT min(vec_id) FROM embeddings)")
def sample_against_all_models(s: SparkSession, d: str) -> DataFrame:
    """The first vector under every study's models."""
    long = _long(s, d)
    first = long.select(F.min("sample").alias("sample"))
    values = long.join(F.broadcast(first), "sample").select("sample", "feature", "value")  # one row
    return scoring.predictions(_bagged(s, d), values, first).withColumn("probability", Q._r(F.col("probability")))


CV_SQL = LONG_SQL + """, grid AS (SELECT * FROM (VALUES ('none', 1e-10), ('some', 0.005), ('much', 0.1)) t(study, extra)
), f AS (SELECT *, sample % 4 AS fold FROM long
), st AS (
  SELECT study, m AS model, label AS class, feature, avg(value) AS c, var_pop(value) + max(extra) AS v, count(*) AS n
  FROM f CROSS JOIN range(4) t(m) CROSS JOIN grid WHERE fold <> m GROUP BY 1, 2, 3, 4
), sz AS (SELECT study, model, class, max(n) AS n FROM st GROUP BY 1, 2, 3
), pr AS (SELECT study, model, class, ln(n / sum(n) OVER (PARTITION BY study, model)) AS prior FROM sz
), sc AS (
  SELECT l.sample, any_value(l.label) AS label, st.study, st.model, st.class, sum(-0.5 * (ln(v) + power(l.value - c, 2) / v)) AS score
  FROM f l JOIN st ON l.feature = st.feature AND l.fold = st.model GROUP BY l.sample, st.study, st.model, st.class
), sp AS (SELECT sample, label, study, model, class, score + prior AS score FROM sc JOIN pr USING (study, model, class)
), ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sample, study)) AS e FROM sp
), cv AS (SELECT study, model AS fold, sample, label, class, e / sum(e) OVER (PARTITION BY sample, study) AS probability FROM ex
), best AS (SELECT study, fold, sample, label, arg_max(class, struct_pack(p := round(probability, 12), c := class)) AS predicted FROM cv GROUP BY 1, 2, 3, 4)
"""


def _validated(s: SparkSession, d: str) -> DataFrame:
    return scoring.cross_validated(_long(s, d).withColumn("fold", F.col("sample") % 4), {"none": 1e-10, "some": 0.005, "much": 0.1})


@Q.query(CV_SQL + "SELECT study, fold, sample, label, class, round(probability, 6) AS probability, class = predicted AS predicted FROM cv JOIN best USING (study, fold, sample, label)")
def cross_validation(s: SparkSession, d: str) -> DataFrame:
    return _validated(s, d).withColumn("probability", Q._r(F.col("probability")))


@Q.query(CV_SQL + """, r AS (SELECT study, fold, label, avg((predicted = label)::INT) AS recall FROM best GROUP BY 1, 2, 3
), a AS (SELECT study, avg(acc) AS accuracy FROM (SELECT study, fold, avg(recall) AS acc FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT study, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY round(accuracy, 12) DESC, study) = 1 AS best FROM a""")
def grid_search(s: SparkSession, d: str) -> DataFrame:
    return scoring.grid_search(_validated(s, d)).withColumn("accuracy", Q._r(F.col("accuracy")))


ROC_SQL = CV_SQL + """, o AS (SELECT study, class, (label = class)::INT AS y, round(probability, 9) AS score FROM cv
), e AS (SELECT study, class, score, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY 1, 2, 3
), w AS (
  SELECT *, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER g AS P, sum(neg) OVER g AS N FROM e
  WINDOW up AS (PARTITION BY study, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY study, class)
)
"""


def _one_against_rest(s: SparkSession, d: str) -> DataFrame:
    return _validated(s, d).select("study", "class", (F.col("label") == F.col("class")).cast("long").alias("label"), F.round("probability", 9).alias("score"))


@Q.query(ROC_SQL + "SELECT study, class, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM w")
def roc_curve(s: SparkSession, d: str) -> DataFrame:
    """Each class against the rest, over the predictions of all folds."""
    points = scoring.roc_points(_one_against_rest(s, d), ["study", "class"])
    return points.select("study", "class", *[Q._r(F.col(c)).alias(c) for c in ("tpr", "fpr")], "score", "tp", "fp")


@Q.query(ROC_SQL + "SELECT study, class, round(sum(neg * (tp - pos + pos / 2)) / (max(P) * max(N)), 6) AS area FROM w GROUP BY 1, 2")
def roc_area(s: SparkSession, d: str) -> DataFrame:
    return scoring.roc_area(_one_against_rest(s, d), ["study", "class"]).withColumn("area", Q._r(F.col("area")))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))


@Q.query()
def oob_by_features(s: SparkSession, d: str) -> DataFrame:
    """Out-of-bag accuracy of forests of the 2 to 6 most important dimensions."""
    return trees.accuracy_by_features(_labelled(s, d), 6, 8, 4, 5).withColumn("oob_accuracy", Q._r(F.col("oob_accuracy")))


@Q.query()
def node_importance(s: SparkSession, d: str) -> DataFrame:
    """Importance of each dimension in extremely randomised trees."""
    splits, _ = trees.grow(_labelled(s, d), {"all": list(range(64))}, 20, 8, 5)
    return trees.importances(splits, 20).select("feature", Q._r(F.col("importance")).alias("importance"))


@Q.query()
def classifier_zoo(s: SparkSession, d: str) -> DataFrame:
    """How naive Bayes and linear machines do on the held-out vectors."""
    e = reduce.balanced_split(T.table(s, d, "embeddings"), "label", "vec_id", 0.25, seed=3)
    return models.classifier_zoo(e.where("part = 'train'"), e.where("part = 'test'"), ["bayes", "svm"])


@Q.query("WITH " + T.SQL_M + """, b AS (SELECT DISTINCT kmer, ascii(substr(kmer, 7, 1)) % 4 AS node FROM m
), p AS (SELECT sample, node, sum(value) AS total FROM v JOIN b USING (kmer) GROUP BY 1, 2
), z AS (SELECT s.grp, n.node, coalesce(p.total, 0.0) AS total FROM samples s CROSS JOIN (SELECT DISTINCT node FROM p) n LEFT JOIN p ON p.sample = s.sample AND p.node = n.node)
SELECT grp, node, round(avg(total), 4) AS mean, round(min(total), 4) AS low, round(max(total), 4) AS high FROM z GROUP BY 1, 2""")
def class_projection(s: SparkSession, d: str) -> DataFrame:
    """Each group's mean, least and greatest totals by node; nodes from a letter of the feature."""
    normal = Q._normal(s, d)
    bmu = normal.select("kmer", (F.ascii(F.substring("kmer", 7, 1)) % 4).alias("node")).distinct()
    found = models.class_projection(models.projection(normal, bmu), T.samples(s, d))
    return found.select("grp", "node", *[Q._r(F.col(c), 4).alias(c) for c in ("mean", "low", "high")])
