import math
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.bm25 import Index, Queries, counted, top_k
from cohortloom.llm.hidden_markov import CLASSES, END, Model, score_texts
from cohortloom.llm.quality_rules import host_quality
from cohortloom.llm.sharding import shard_documents, text_hub
from cohortloom.llm import surrogates
from cohortloom.llm.surrogates import entities, luhn, permuted, replace_entities, replaced, second_tries, surrogate
from cohortloom.llm.toxicity import CLASSES as WORD_CLASSES
from cohortloom.llm.toxicity import Scorer, choose_stems, context, toxicity
from cohortloom.llm.words import WordHasher

KEY = b"k"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.0, True) for i, t, s in rows], "doc_id long, text string, source string, score double, kept boolean")


def test_forward_likelihood_against_all_paths():
    rng = np.random.default_rng(2)
    model = Model(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(CLASSES + 1), 2))
    sequences = [[3, 5, 5, END], [END], [7, 3, END]]
    got = model.likelihoods(np.concatenate(sequences), np.array([len(s) for s in sequences]))
    for s, g in zip(sequences, got):
        total = 0.0
        for path in product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            total += p
        assert math.isclose(g, math.log10(total), rel_tol=1e-9)


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(3)
    model = Model(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(CLASSES + 1), 2))
    s = [3, 5, END]
    padded = np.zeros((1, 4), np.int64)
    padded[0, :3] = s
    start, move, emit = model.expected(padded, np.array([3]))
    want_move, total = np.zeros((2, 2)), 0.0
    for path in product(range(2), repeat=3):
        p = model.start[path[0]] * model.emit[path[0], s[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= model.move[a, b] * model.emit[b, x]
        total += p
        for a, b in zip(path, path[1:]):
            want_move[a, b] += p
    assert np.allclose(move, want_move / total) and math.isclose(start.sum(), 1) and math.isclose(emit.sum(), 3)


def test_language_model_counts_and_gain(spark):
    a, b = "the cat and the dog ran", "le chat et le chien vont"
    rows = [(i, " ".join([(a if i % 2 else b)] * 12), "s") for i in range(60)] + [(100, None, None), (101, "", "s"), (101, "", "s")]
    got = score_texts(docs_of(spark, rows), states=2, rounds=4, chunk=7).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    train = [(i, t or "") for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    words = [w for _, t in train for w in [*t.split(), None]]
    n, v = len(words), len(set(words))
    assert {r["train_tokens"] for r in got} == {n}
    one = next(r for r in got if r["doc_id"] == 3)
    want = sum(math.log10((words.count(w) + 1) / (n + v + 1)) for w in [*rows[3][1].split(), None])
    assert math.isclose(one["base_score"], want, rel_tol=1e-9) and one["n_known"] == one["n_tokens"]
    assert score_texts(docs_of(spark, [])).count() == 0


def test_documents_below_their_bound_are_not_scored():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{min(200, int(x))}" for x in rng.exponential(30, 40)) + (f" r{i // 40}" * 3) for i in range(2000)]
    h, starts = WordHasher().hashes(pa.array(texts))
    n = np.diff(starts)
    terms, at, docs, times = counted(h, np.repeat(np.arange(2000), n), 2000)
    index = Index(list(range(2000)), n, terms, at, docs, times, n.mean())
    assert 0 < (index.column >= 0).sum() < len(terms)
    asked = np.unique(h[starts[7] : starts[8]]).view(np.int64)
    where = np.searchsorted(terms.view(np.uint64), asked.view(np.uint64))
    weight = np.log(1 + 2000 / np.diff(at)[where])
    score = np.zeros(2000)
    for t, w in zip(where, weight):
        score[docs[at[t] : at[t + 1]]] += w * index.impact[at[t] : at[t + 1]]
    want = sorted(range(2000), key=lambda i: (-round(score[i], 6), i))[:5]
    one = Queries(np.array([0, len(asked)]), asked, weight)
    (q, found), = index.search(one, 5, np.zeros(1))
    assert q == 0 and [d for _, d in found] == want
    scored = index.scored
    (_, found), = index.search(one, 5, np.array([found[-1][0] - 1e-5]))
    assert [d for _, d in found] == want and index.scored - scored < scored < 1000


def test_search_of_nothing(spark):
    some, none = docs_of(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a", "s")]), docs_of(spark, [])
    assert top_k(none, some).count() == 0 and top_k(some, none).count() == 0
    got = sorted((r["rank"], r["doc_id"]) for r in top_k(some, some.where("doc_id = 1").limit(1), 2).collect())
    assert got == [(1, 1), (2, 1)]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(60, int(x))}" for x in rng.exponential(15, rng.integers(0, 60))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(300, None, "s"), (301, texts[5], "s")]
    docs = docs_of(spark, rows)
    got = {}
    for r in top_k(docs, docs.where("doc_id % 25 = 0"), 5, shard_bytes=2000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    bags = [(i, (t or "").split()) for i, t, _ in rows]
    mean = sum(len(b) for _, b in bags) / len(bags)
    df = {w: sum(w in b for _, b in bags) for w in {w for _, b in bags for w in b}}
    for q in range(0, 301, 25):
        asked = dict(bags)[q]
        scores = []
        for i, b in bags:
            s = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in asked if w in b)
            if s:
                scores.append((-round(s, 6), i))
        want = [i for _, i in sorted(scores)[:5]]
        assert [d for _, d, _ in sorted(got.get(q, []))] == want


def test_hosts_and_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    spam = "### buy $$$ " * 30
    rows = [(i, spam, "bad") for i in range(30)] + [(50, clean, "bad"), (51, clean, None), (52, None, "good"), (53, "", "good")]
    got = {r["doc_id"]: r for r in host_quality(docs_of(spark, rows)).collect()}
    assert got[50]["kept"] and got[51]["kept"] and not got[0]["kept"] and not got[52]["kept"]
    assert got[50]["host_rate"] > 0.5 > got[51]["host_rate"] or got[51]["host_rate"] <= 1
    assert got[0]["n_repeat_words"] == 90 and got[0]["n_symbols"] == 180
    assert host_quality(docs_of(spark, [])).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i}", "s") for i in range(400)] + [(1000 + i, f"copy {i % 20}", "s") for i in range(60)] + [(2000 + i, "hot", "s") for i in range(200)] + [(None, None, None)]
    got = shard_documents(docs_of(spark, rows), text_hub(), 10).toPandas()
    sizes = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
    assert len(got) == len(rows) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    copies = got[(got.doc_id >= 1000) & (got.doc_id < 2000)].assign(g=lambda x: x.doc_id % 20)
    assert (copies.groupby("g")["shard"].nunique() == 1).mean() > 0.9
    assert got[got.doc_id >= 2000]["shard"].nunique() <= 5
    assert shard_documents(docs_of(spark, []), text_hub()).count() == 0


def test_surrogates_are_distinct_and_consistent(spark):
    card = "455667788990012"
    card += str(luhn(card))
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    text = f"Mrs Anna Smith, a.b@mail3.example.com or A.B@mail3.example.com, +1 (212) 555-7713, 10.20.30.40, {card}, not {wrong}"
    out = {r["doc_id"]: r for r in replace_entities(docs_of(spark, [(1, text, "s"), (2, text, "s"), (3, None, "s"), (4, "", "s")]), KEY).collect()}
    assert out[1]["text"] == out[2]["text"] != text and out[3]["text"] is None and out[4]["entities"] == []
    new = out[1]["text"]
    assert wrong in new and card not in new and "10.20.30.40" not in new and "@mail3" not in new
    mails = [e["surrogate"] for e in out[1]["entities"] if e["type"] == "email"]
    assert mails[0].lower() == mails[1].lower() and mails[0] != mails[1]
    found = {k: v for k, _, _, v in entities(new)}
    assert luhn(found["card"][:-1]) == int(found["card"][-1]) and new.startswith("Mrs ") and "+1 (" in new
    assert [e["type"] for e in out[1]["entities"]] == ["female", "family", "email", "email", "phone", "ip", "card"]


def test_numbers_beside_entities():
    card = "455667788990012"
    card += str(luhn(card))
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    grouped = [sep.join(x[i : i + 4] for i in range(0, 16, 4)) for x in (card, wrong) for sep in " -"]
    kinds = {card: "card", grouped[0]: "card", grouped[1]: "card", "555-123-4567": "phone", "123-45-6789": "ssn", "0033 6 12 34 56 78": "phone"}
    for found, kind in kinds.items():
        for before in ("", "in ", "7 ", "42 ", "980 ", "2024 "):
            for after in ("", " items", " 7", " 42", " 123", " 2024"):
                text = before + found + after
                assert [(k, text[a:b]) for k, a, b, _ in entities(text)] == [(kind, found)], text
    text = f"555-123-4567 {card} 123-45-6789"
    assert [k for k, *_ in entities(text)] == ["phone", "card", "ssn"]
    assert not any(entities(x) for x in (wrong, *grouped[2:]))


def test_permutation_of_a_range():
    assert sorted(permuted(i, 1000, KEY, "x") for i in range(1000)) == list(range(1000))


def test_full_format_gets_more_letters(spark):
    rows = [(26 * i + j, f"{chr(97 + i)}@{chr(97 + j)}.co", "s") for i in range(26) for j in range(26)]
    docs = docs_of(spark, rows)
    real, made = {t for _, t, _ in rows}, [r["text"] for r in replace_entities(docs, KEY).collect()]
    assert len(set(made)) == 676 and not real & set(made)
    with pytest.raises(RuntimeError):
        second_tries(docs, KEY, "text", 4)


def test_bare_keys_on_lines_without_digits():
    for found in ("sk-" + "abcdefghij" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghij" * 3):
        text = f"a line\nuse {found} here\nend"
        assert [(k, text[a:b]) for k, a, b, _ in entities(text)] == [("secret", found)]


def test_one_person_in_several_mentions():
    text = "Mrs Anna Smith came. Mrs Smith left; Dr Anna Smith and SMITH stayed, said Anna. Mr Smith and Mrs Annabel Jones. Smithy"
    new, listed = replaced(text, KEY, {})
    first, family = (next(e["surrogate"] for e in listed if e["original"] == w) for w in ("anna", "smith"))
    other, jones = (next(e["surrogate"] for e in listed if e["original"] == w) for w in ("annabel", "jones"))
    assert new == (
        f"Mrs {first} {family} came. Mrs {family} left; Dr {first} {family} and {family.upper()} stayed, said {first}. "
        f"Mr {family} and Mrs {other} {jones}. Smithy"
    )
    assert len({first, family, other, jones, "Anna", "Smith"}) == 6


def test_names_keep_gender_and_script():
    endings = surrogates.ENDINGS
    new, _ = replaced("Mr Anna Smith, госпожа Мария Иванова", KEY, {})
    words = new.replace(",", "").split()
    assert any(words[1].endswith(e) for e in endings["latin"]["male"]) and any(words[2].endswith(e) for e in endings["latin"]["family"])
    assert words[3] == "госпожа" and any(words[4].endswith(e) for e in endings["cyrillic"]["female"])
    assert all("а" <= c <= "я" for w in words[4:] for c in w.lower())


def test_surrogates_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Mrs Aa Bb", "x", 1), (1, "Mrs Aa Bb", "x", 1), (None, None, None, None)], "doc_id long, text string, _h string, _again int")
    got = replace_entities(docs, KEY, out_col="found").collect()
    assert len({r["text"] for r in got}) == 2 and sorted(len(r["found"]) for r in got) == [0, 2, 2]
    assert replace_entities(docs.where("false"), KEY).count() == 0


def test_grammar_knows_the_clause():
    scorer = Scorer({"idiot": 5.0})
    at = dict(zip(scorer.NAMES, range(9)))
    assert scorer.features("A fine day.")[at["most"]] == 0
    five = pytest.approx(math.log1p(5))
    assert scorer.features("What an idiot. You left.")[at["plain"]] == five
    assert scorer.features("You are an idiot!")[at["aimed"]] == five
    assert scorer.features("An idiot you are")[at["aimed"]] == five
    assert scorer.features("He is not an idiot")[at["negated"]] == five
    assert scorer.features("she said idiot")[at["reported"]] == five
    assert scorer.features("idiot, she said")[at["reported"]] == five


def test_a_composed_machine_does_what_its_parts_do_in_turn():
    parts = [context("target", "aimed", 2), context("negation", "negated", 3), context("report", "reported", 1)]
    whole = parts[0] @ parts[1] @ parts[2]
    rng = np.random.default_rng(3)
    for _ in range(200):
        symbols = [str(c) for c in rng.choice(WORD_CLASSES, 12)]
        want = symbols
        for p in parts:
            state, out = 0, []
            for c in want:
                state, c = p.read(state, c)
                out.append(c)
            want = out
        state, got = 0, []
        for c in symbols:
            state, c = whole.step[state][c]
            got.append(c)
        assert got == want


def test_threats_count_without_insults():
    scorer = Scorer({"idiot": 5.0, "kill": 2.0})
    of = lambda text: {k: round(math.expm1(v), 6) for k, v in zip(scorer.NAMES, scorer.features(text)) if "threat" in k and v}
    assert of("You there, I will murder you") == {"aimed_threat": 1}
    assert of("What an idiot. He said murder! Never hurt. To beat") == {"reported_threat": 1, "negated_threat": 1, "plain_threat": 1}
    assert of("To kill") == {"plain_threat": 1} and of("A diet.") == {}
    assert Scorer({}).features("You murder")[scorer.NAMES.index("aimed_threat")] > 0


def test_elided_words_hide_no_stem():
    scorer = Scorer({"idiot": 5.0, "imb": 4.0})
    at = dict(zip(scorer.NAMES, range(20)))
    assert scorer.features("pas d'idiot")[at["negated"]] == pytest.approx(math.log1p(5))
    assert scorer.features("voilà l’imbécile, l'imbecile")[at["plain"]] == pytest.approx(math.log1p(8))


def test_toxicity_learns_stems(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghi"), 4))
    rows = [(i, " ".join([word() for _ in range(40)] + (["zorg" + word()] * 2 if i % 5 == 0 else [])), "s") for i in range(600)]
    docs = docs_of(spark, [*rows, (9000, None, "s"), (9001, "", None)])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["doc_id"] < 600)
    none = toxicity(docs, labels.where("toxic = 0")).agg(F.max("predicted")).first()[0]
    assert none == 0


def test_stems_are_the_longest_common_ones():
    found = [("zo", 50, list(range(20))), ("zor", 0, list(range(20))), ("zorg", 0, list(range(20))), ("zorga", 0, list(range(9)))]
    assert list(choose_stems(found, 20, 200)) == ["zorg"]
