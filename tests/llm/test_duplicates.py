import random
import re
from collections import Counter

import pytest

from tests_brute import brute_components, brute_removed

from cohortloom.llm import jaccard, suffix_dedup
from cohortloom.llm.jaccard import near_duplicates
from cohortloom.llm.queries import op5_suffix_dedup
from cohortloom.llm.suffix_dedup import as_letters, remove_repeats, repeated_windows, spans_within, two_stage_sort


def words(rng, n, v=400):
    return [f"w{rng.randint(0, v)}" for _ in range(n)]


@pytest.mark.parametrize(("seed", "frequent"), [(4, 1 << 20), (5, 100), (6, 20)])
def test_components_against_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(8):
        base = words(rng, rng.randint(3, 120))
        for _ in range(rng.randint(1, 12)):
            copy = [f"x{rng.randint(0, 9999)}" if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, class string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    assert remove_repeats(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_duplicates(docs).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("None", 2, "None")]


def test_a_group_of_near_copies_of_which_few_link(spark):
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, " ".join(f"x{rng.randint(0, 99999)}" if rng.random() < 0.03 else w for w in base)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == brute_components(rows) and 1 < len({c for _, c in got.values()}) < 120


def test_a_row_without_an_id_links_others(spark):
    a = [f"w{i}" for i in range(60)]
    b = [*a[:-4], "v1", "v2", "v3", "v4"]
    c = ["u1", "u2", "u3", "u4", *b[4:]]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b, c)]
    near = [100 * len(x & y) >= 80 * len(x | y) for x, y in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))]
    assert near == [True, True, False]
    for middle, want in ((2, {1: 1, 2: 1, 3: 1}), (None, {1: 1, None: 1, 3: 1})):
        docs = spark.createDataFrame([(1, " ".join(a)), (middle, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("group", [300, 3])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    shared = noise(700)
    texts = [noise(rng.randint(0, 300)) + shared[rng.randint(0, 150) : 700 - rng.randint(0, 150)] + noise(rng.randint(0, 300)) for _ in range(14)]
    texts += [noise(100) + "ab" * 400, "ab" * 800, "a" * 1500, "a" * 399, "a" * 400, shared, shared, None, ""]
    real = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n=400: real(d, n, group))
    docs = spark.createDataFrame([(i, t, b"k") for i, t in enumerate(texts)], "doc_id long, text string, t binary").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()}
    want = brute_removed(texts, 400)
    assert [got[i] for i in range(len(texts))] == want


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 4))]
        counts = [rng.randint(1, len(t)) for t in texts]
        got = [texts[j][p:] for j, p in two_stage_sort(texts, counts)]
        assert got == sorted(t[p:] for t, c in zip(texts, counts) for p in range(c))


def test_neighbours_show_repeats():
    texts = [b"abcabcx", b"zabcy"]
    marks = repeated_windows(texts, [len(t) - 2 for t in texts], 3)
    assert [bytes(m) for m in marks] == [b"\1\0\0\1\0", b"\0\1\0"]


def brute_passages(texts: list[str | None], words: int = 51) -> list[tuple[int, int]]:
    """Bytes and number of stretches in so many words that stand in another text or place."""
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    windows = [[tuple(m.group() for m in w[k : k + words]) for k in range(len(w) - words + 1)] for w in found]
    count = Counter(x for t, w in {t: w for t, w in zip(texts, windows)}.items() for x in w)
    out = []
    for ms, ws in zip(found, windows):
        gone = sorted({k + j for k, x in enumerate(ws) if count[x] > 1 for j in range(words)})
        ends = [i for i, k in enumerate(gone) if i + 1 == len(gone) or gone[i + 1] > k + 1]
        starts = [0, *[i + 1 for i in ends[:-1]]] if gone else []
        out.append((sum(ms[gone[b]].end() - ms[gone[a]].start() for a, b in zip(starts, ends)), len(ends)))
    return out


def test_op5_tells_of_passages_of_over_50_words_with_fewer_than_400_bytes(spark, tmp_path):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    passage, brief, often, long = words(55), words(50), words(59), words(200)
    rows = [words(30) + passage + words(20), passage + words(5) + long, long[10:] + words(9), words(4) + brief, brief + words(4), passage + words(2) + passage]
    rows += [words(i) + often[: 59 - i % 9] + words(3) for i in range(320)]  # more than are sorted at once
    texts = [" ".join(r) for r in rows]
    texts += [texts[0], "\t \n".join([*passage[:20], "é", *passage]), "no " * 400, "a b", None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got[0]["n_removed"] > 0 and got[5]["n_removed"] == 0  # 0 has an exact copy
    assert got[5]["n_passages"] == 2
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute_removed(texts, 400)
    assert [(got[i]["n_passage_bytes"], got[i]["n_passages"]) for i in range(len(texts))] == brute_passages(texts)


def test_letters_of_several_bytes_sort_as_numbers():
    rng = random.Random(4)
    rows = [[rng.choice([1, 255, 256, 1 << 63]) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    texts = as_letters([b"".join(x.to_bytes(8, "little") for x in r) for r in rows], 8)
    got = [rows[j][p:] for j, p in two_stage_sort(texts, [len(r) for r in rows])]
    assert got == sorted(r[p:] for r in rows for p in range(len(r)))


@pytest.mark.parametrize("times", [1, 2, 9])
def test_halving_a_group_leaves_no_repeat_out(times):
    rng, length = random.Random(8), 12
    marked = lambda rows, times: {
        (t, p) for t, a, b in spans_within(rows, 0, 8, length, 1, times) for p in range(a, b - length + 1)
    }
    core = b"zzzz"  # at place d of a window, d from 0 to 8
    for _ in range(100):
        rows = []
        for t in range(rng.randint(2, 9)):
            dlo = rng.randint(0, 8)
            dhi = rng.randint(dlo, 8)
            body = [rng.choice(b"ab") for _ in range(dhi - dlo + length)]
            body[dhi : dhi + 4] = core
            rows.append((rng.choice([1, 1, 2]), dlo, dhi, bytes([t]), 0, bytes(body)))
        assert marked(rows, times) == marked(rows, 0)


def test_both_kinds_of_repeats_and_large_groups_take_few_jobs(spark, monkeypatch):
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    often = words(60)
    texts = [" ".join(words(60) + often[i % 4 :] + words(60)) for i in range(330)]  # more than are sorted at once
    names, real = [], suffix_dedup.save
    monkeypatch.setattr(suffix_dedup, "save", lambda df, name, *more: names.append(name) or real(df, name, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = remove_repeats(docs, words=51, cut_words=False).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == [x[:3] for x in brute_removed(texts, 400)]
    assert len(names) <= 20, names
