import random
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.common import free_name
from cohortloom.llm.surrogates import replaced
from tests_brute import brute_components, brute_removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "leader", "kept", "n_bytes", "n_removed", "n_spans", "entities", "_t", "_h", "_spans", "_again", "class", "node", "n", "piece")


def corpus():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 500)}" for _ in range(n))
    base, passage = words(120), words(150)
    texts = [words(60) for _ in range(12)]
    texts += [base, base + " tail", base.replace("w1 ", "w2 "), base.upper(), passage + words(200), words(150) + " " + passage, words(30) + passage]
    texts += ["Mrs Anna Smith wrote to a.b@mail.example.com " + words(40), None, "", " \n", "one", texts[0], words(30_000)]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = corpus()
    spark.createDataFrame(rows + [rows[0], (None, "no id at all here", "en", None, 17)], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_with_clashing_names_and_no_rows(spark, tables, name):
    stage = dict(P.STAGES)[name]
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(1) for c in CLASHING})
    some = docs.where("doc_id < 3 OR doc_id IS NULL OR text IS NULL OR text = ''")
    got = stage(spark, some, tables)
    if name != "packing":
        assert got.columns == docs.columns and {r["score"] for r in got.select("score").distinct().collect()} == {1}
    assert got.count() >= 5
    assert stage(spark, docs.where("false"), tables).count() == 0


def test_toxic_documents_go(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert P.drop_toxic(spark, docs, tables).count() == docs.count()  # no label is toxic
    rng = random.Random(5)
    names = ["garden", "river", "market", "teacher", "window", "bread", "winter", "story", "music", "letter"]
    clean = lambda: f"The {rng.choice(names)} was near the {rng.choice(names)} and we liked the {rng.choice(names)}."
    rude = lambda: f"{clean()} You are a {rng.choice(['zorgle', 'blimpet'])} and a fool. {clean()}"
    rows = [(i, rude() if i % 3 == 0 else " ".join(clean() for _ in range(3)), "en", "s", 1) for i in range(400)]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in P.drop_toxic(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert kept == {i for i in range(400) if i % 3}


def test_one_of_each_group_stays(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    leader = {i: c for i, (_, c) in brute_components([(i, t) for i, t, *_ in corpus()]).items()}
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in P.one_of_near_copies(spark, docs, tables).collect())
    assert got == [-1, *sorted(i for i, c in leader.items() if i == c)]


def test_rows_of_one_id_and_without_ids_stand_for_themselves(spark, tables):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    near, other, third = words(120), words(90), words(80)
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    stay = lambda rows: sorted(map(str, ((r["doc_id"], r["text"]) for r in P.one_of_near_copies(spark, docs(rows), tables).collect())))
    want = lambda rows: sorted(map(str, rows))
    # A row without an id goes when it is linked, whatever other such rows do.
    assert stay([(1, near), (None, near + " tail"), (None, other)]) == want([(1, near), (None, other)])
    # Of two texts of one id, one is a near copy and the other is not.
    assert stay([(1, near), (5, near + " tail"), (5, other)]) == want([(1, near), (5, other)])
    # Repeated rows stay once, linked rows without ids too, and so do null texts.
    assert stay([(7, third), (7, third), (None, other), (None, other), (8, None), (8, None), (8, "")]) == want([(7, third), (None, other), (8, None), (8, "")])


def test_repeated_passages_go(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = corpus()
    want = brute_removed([t for _, t, *_ in rows], 400)
    for r in P.cut_repeats(spark, docs, tables).collect():
        old = rows[r["doc_id"]][1]
        if old is None:
            assert r["text"] is None
        else:
            assert len(old.encode()) - len(r["text"].encode()) == want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])


def test_passages_of_over_50_words_go_though_they_have_fewer_than_400_bytes(spark, tables):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    long, short, copy, often = words(51), words(50), " ".join(words(60)), words(59)
    rows = [words(40) + long + words(9), long + words(30), words(7) + short, short + words(3), words(8) + ["\n".join(long[:20]), "\t ".join(long[20:])]]
    rows += [words(i) + often[: 59 - i % 9] + words(3) for i in range(400)]  # more than are sorted at once
    texts = [" ".join(r) for r in rows] + [copy, copy, None, "", " \n", "é" * 150]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["text"] for r in P.cut_repeats(spark, docs, tables).collect()}
    count = Counter(tuple(w[i : i + 51]) for w in ((t or "").encode().split() for t in set(texts)) for i in range(len(w) - 50))
    bytes_gone = brute_removed(texts, 400)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        at = [k for k in range(len(w) - 50) if count[tuple(w[k : k + 51])] > 1]
        gone = {k + j for k in at for j in range(51)}
        assert bytes_gone[i][1] == 0
        assert got[i] == t if not gone else got[i].encode().split() == [x for k, x in enumerate(w) if k not in gone]
    assert len(got[0].split()) == 49 and got[1].split() == rows[1][51:] and got[4].split() == rows[4][:8]
    assert [got[i] for i in (2, 3, 405, 406)] == [texts[i] for i in (2, 3, 405, 406)]


def test_entities_are_hidden(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    key = P.surrogate_key(spark)
    for r in P.hide_entities(spark, docs, tables).collect():
        old = corpus()[r["doc_id"]][1]
        assert r["text"] == (replaced(old, key, {})[0] if old else old)


def test_the_whole_run(spark, tables):
    got = P.run(spark, tables)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(got.columns)
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 2048 OR n <> end").count() == 0


def test_names_that_are_free(spark):
    df = spark.range(1).select(F.lit(1).alias("Kept"), F.lit(1).alias("kept_"))
    assert free_name(df, "kept") == "kept__" and free_name(df, "other") == "other"
