import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import kmers as K
from cohortloom.functions import stats as S
from cohortloom.operators import groups, matrix, similarity


def one(spark, expression, text="x", value=""):
    return spark.createDataFrame([(value,)], f"{text} string").select(expression).first()[0]


def test_kmers_of_a_sequence(spark):
    assert one(spark, K.kmers(F.col("x"), 3), value="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, K.kmers(F.col("x"), 3), value="AC") == []
    assert one(spark, K.distinct_kmers(F.col("x"), 2), value="ACACG") == ["AC", "CA", "CG"]


def test_codes_go_there_and_back(spark):
    rows = spark.createDataFrame([("ACGT", 27), ("TTTT", 255), ("AAAA", 0)], "k string, code long")
    got = rows.select(K.kmer_to_int(F.col("k")), K.int_to_kmer(F.col("code"), 4), "k", "code").collect()
    assert all(r[0] == r[3] and r[1] == r[2] for r in got)


def test_strand_complexity_and_overlap(spark):
    assert one(spark, K.reverse_complement(F.col("x")), value="AACG") == "CGTT"
    assert one(spark, K.reverse_complement(F.col("x")), value="AANG") is None
    assert one(spark, K.complexity(F.col("x")), value="AACA") == 0.5
    assert one(spark, K.overlap_shift(F.col("x"), F.lit("CGTT"), 4), value="ACGT") == 1
    assert one(spark, K.overlap_shift(F.col("x"), F.lit("GGGG"), 4), value="ACCC") == 0


def test_metadata(spark):
    assert one(spark, K.metadata_map(F.col("x")), value="tissue:liver;case;age:") == {"tissue": "liver", "Group": "case", "age": "NA"}


def test_p_values_match_known_ones():
    # Fixed values of Student's t: 2.228 with 10 and 12.706 with 1 degree of freedom are at 5 %.
    assert np.allclose(S.student_p_values([2.2281388, 12.7062047], [10, 1]), 0.05, atol=1e-7)
    assert math.isclose(S.f_p_values(np.array([4.9646027]), np.array([1.0]), np.array([10.0]))[0], 0.05, abs_tol=1e-7)


def counts4(spark):
    rows = [
        ("s1", "a", "AAAA", 1), ("s2", "a", "AAAA", 1), ("s3", "b", "AAAA", 1), ("s4", "b", "AAAA", 1),
        ("s1", "a", "AAAC", 4), ("s3", "b", "AAAG", 1), ("s4", "b", "AAAG", 2), ("s1", "a", "AAAG", 1),
    ]
    return spark.createDataFrame(rows, "sample string, grp string, kmer string, raw_count long")


def samples4(spark):
    return spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b"), ("s4", "b")], "sample string, grp string")


def test_entropy_by_hand(spark):
    got = {r[0]: r[1] for r in matrix.entropy(counts4(spark), "raw_count").collect()}
    assert got == {"AAAA": 2.0, "AAAC": 0.0, "AAAG": 1.5}
    nothing = counts4(spark).withColumn("raw_count", F.lit(0))
    assert all(r[1] is None for r in matrix.entropy(nothing, "raw_count").collect())


def test_extract_fills_zeros(spark):
    asked = spark.createDataFrame([(1, "AAAC"), (2, "TTTT")], "line int, kmer string")
    got = matrix.extract(counts4(spark), asked, samples4(spark).select("sample")).collect()
    assert len(got) == 8 and sum(r["raw_count"] for r in got) == 4


def test_arrays_follow_the_sample_order(spark):
    got = {r[0]: r[1] for r in matrix.as_arrays(counts4(spark), samples4(spark), "raw_count").collect()}
    assert got["AAAG"] == [1.0, 0.0, 1.0, 2.0]


def test_group_stats_count_zeros(spark):
    got = {(r.kmer, r.grp): (r.mean, r.sd) for r in groups.group_stats(counts4(spark), samples4(spark), "raw_count").collect()}
    assert got["AAAC", "a"] == (2.0, math.sqrt(8)) and got["AAAC", "b"] == (0.0, 0.0)


def test_fold_change_order_of_zero_tests(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (0.0, 3.0), (3.0, 0.0), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(S.fold_change(F.col("a"), F.col("b"))).collect()]
    assert got == [2.0, -2.0, math.inf, -math.inf, math.inf]


def test_equal_values_are_all_in_bin_one(spark):
    got = similarity.discretise(counts4(spark), 4, 10, 0.1, "raw_count").where("kmer = 'AAAA'").collect()
    assert {r["bin"] for r in got} == {1} and len(got) == 4


def test_empty_matrix(spark):
    empty = counts4(spark).limit(0)
    assert matrix.entropy(empty, "raw_count").count() == 0
    assert groups.group_stats(empty, samples4(spark), "raw_count").count() == 0


def test_gamma_and_normal_kernels():
    x = np.array([1e-3, 0.1, 0.4999, 0.5, 1, 2.5, 10, 171.3, 1e4])
    assert S.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    z = np.array([0, 1e-8, 0.3, -1, 1.99, 2.0, 2.01, 5, -9, 30, np.inf, np.nan])
    want = [math.erfc(abs(v) / math.sqrt(2)) for v in z[:-1]]
    got = S.normal_p_values(z)
    assert got[:-1] == pytest.approx(want, rel=1e-10, abs=1e-300) and np.isnan(got[-1])
