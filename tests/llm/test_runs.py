import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortloom.llm.periodic_runs import periodic_runs, planted, run_report, runs_of


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, times * q):
                if not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n = len(w)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def periodic_text(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice(["a", "b", "Ab", "ab", "é", "x" * 300, f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(1, 6))]
        out += (base * rng.randint(1, 9))[: rng.randint(1, 40)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_batches_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(rng.randint(1, 8))]
        texts += [list(rng.choice(texts)) for _ in range(3)]
        number = {}
        ids = np.array([number.setdefault(x, len(number)) for t in texts for x in t], np.int64)
        starts = np.cumsum([0] + [len(t) for t in texts])
        found = [[] for _ in texts]
        for t, s, e, p in zip(*(x.tolist() for x in runs_of(ids, starts))):
            found[t].append((s, e - s, p))
        assert found == [brute_runs(t) for t in texts]


def test_long_texts_and_few_different_words():
    rng = np.random.default_rng(1)
    assert [x.tolist() for x in runs_of(np.zeros(400_000, np.int64), np.array([0, 400_000]))] == [[0], [0], [400_000], [1]]
    tiled = np.tile(np.arange(500), 400)
    assert [x.tolist() for x in runs_of(tiled, np.array([0, len(tiled)]))] == [[0], [0], [200_000], [500]]
    coins = rng.integers(0, 2, 3000)
    t, s, e, p = runs_of(coins, np.array([0, 3000]))
    assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == brute_runs(coins.tolist())


def test_reports_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(300 + i, rng.choice([" ", "\n", "\t \x0b"]).join(periodic_text(rng))) for i in range(100)]
    rows += [(400, None), (401, ""), (402, " \r\n"), (403, "a " * 900), (404, "a a " * 7), (404, "b " * 7), (404, "b " * 7), (None, "c " * 50)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, collapsed string").repartition(3)
    got = sorted(map(tuple, run_report(periodic_runs(docs, rewrite=planted)).collect()), key=str)
    assert got == sorted(((i, *brute_report(i, t)) for i, t in rows), key=str)
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got)


def test_text_ids_collapsed_words_and_no_rows(spark):
    docs = spark.createDataFrame([("k", "x a b a b a b a b y")], "doc_id string, text string")
    row = periodic_runs(docs).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (10, [(1, 8, 2)], "x a b y")
    assert run_report(periodic_runs(docs.limit(0), rewrite=planted)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)
