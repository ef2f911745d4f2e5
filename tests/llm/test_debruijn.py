import random

import pytest

from cohortloom.llm import debruijn
from cohortloom.llm.debruijn import remove_repeated_words

WIDE = 20


def brute(rows):
    first, out = {}, []
    docs = sorted(((i, (t or "").encode().split()) for i, t in rows), key=lambda r: r[0])
    for i, w in docs:
        for k in range(len(w) - WIDE + 1):
            first.setdefault(tuple(w[k : k + WIDE]), (i, k))
    for i, w in docs:
        gone = set()
        for k in range(len(w) - WIDE + 1):
            if first[tuple(w[k : k + WIDE])] != (i, k):
                gone.update(range(k, k + WIDE))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def corpus(rng):
    word = lambda: f"w{rng.randint(0, 300)}"
    shared = [[word() for _ in range(rng.randint(15, 90))] for _ in range(6)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(shared)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 50))]
            if rng.random() < 0.3:
                part = part[rng.randint(0, 10) :]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = word()
            w += part
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, None), (93, ""), (94, " \n"), (95, "a " * 70), (96, "a b " * 30), (97, "A " * 19), (98, "A " * 20), (99, "a " * 3000)]
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(t, "x", i) for i, t in rows], "text string, d string, doc_id long").repartition(5, "doc_id")
    assert result(remove_repeated_words(docs)) == sorted(brute(rows), key=str)


def test_hashes_that_collide_are_found_out(spark, monkeypatch):
    """With all nodes alike, stretches of different words count as equal, until the seed changes."""
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    real, tried = debruijn._cut_texts, []

    def weak(d, hits, seed):
        tried.append(seed)
        made = real(d, hits, seed)
        if len(tried) > 1:
            return made
        same = debruijn.F.transform("parts", lambda p: p.withField("a", p["a"] * 0).withField("b", p["b"] * 0))
        return made.withColumn("parts", same)

    monkeypatch.setattr(debruijn, "_cut_texts", weak)
    assert result(remove_repeated_words(docs)) == sorted(brute(rows), key=str)
    assert len(tried) == 2


def test_repeated_rows_shared_and_missing_ids(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (5, "x " + text), (5, "y " + text)], "doc_id long, text string").repartition(2, "text")
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept"][:3]) for r in remove_repeated_words(docs).collect())
    assert got == [("3", 40, ""), ("3", 40, ""), ("5", 40, "x"), ("5", 40, "y"), ("None", 0, "v0 ")]
    assert remove_repeated_words(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", text), ("a", text)], "name string, body string")
    assert {r["name"]: r["n_removed"] for r in remove_repeated_words(named, "name", "body").collect()} == {"a": 0, "b": 40}
