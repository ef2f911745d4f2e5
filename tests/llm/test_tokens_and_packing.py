import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import packing
from cohortloom.llm.byte_bpe import ByteBpe, encode_decode
from cohortloom.llm.common import tokenizer_file
from cohortloom.llm.packing import WordEncoder, best_configuration, best_plan, bounded_plan, pack, solve

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = ["", " ", "it's  DON'T\r\n\tx", "<|endoftext|>x <|endoftext|>", "x" * 3000, "ab" * 900 + "漢字 🙂", "a\x1cb\x85c　d", "ñß12٣ é́\n\n  \n a"]


def texts():
    rng = random.Random(1)
    letters = "ab'sS té  \n\t\r\x1c\x85\xa0　ñß12٣漢字🙂́*#%|<>.,the "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]


def test_encoding_is_the_librarys_and_decoding_gives_the_text_back():
    mine, theirs = ByteBpe(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    for text in texts():
        n, ids, decoded = mine.encode(text)
        want = theirs.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert decoded == theirs.decode(want, skip_special_tokens=False)


def test_certain_cuts_lie_in_no_token():
    bpe = ByteBpe(BYTE)
    pairs = {t[i : i + 2] for t in bpe.token.values() for i in range(len(t) - 1)}
    word = " naïve漢字".encode()
    parts = bpe.cuts(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert all(a[-1:] + b[:1] not in pairs for a, b in zip(parts, parts[1:]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")


def test_encode_decode_of_a_table(spark):
    got = encode_decode(table(spark, [(1, "a b"), (1, "a b"), (None, None)]), BYTE).collect()
    assert sorted((r["n_tokens"], r["ids"], r["decoded"]) for r in got) == [(0, "", "")] + [(2, "64,275", "a b")] * 2
    assert encode_decode(table(spark, []), BYTE).count() == 0


def packed_rows(spark, rows, **more):
    return pack(table(spark, rows), WORD, **more).collect()


def test_packing_holds_every_piece_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("one two three".split()) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(900, None), (901, ""), (901, "")]
    got = packed_rows(spark, rows, capacity=64)
    library = tokenizers.Tokenizer.from_file(WORD)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    at: dict = {}
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(want[i]) for i, _ in rows)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert len(at) <= -(-total // 64) + 2
    assert packed_rows(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_solution_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(101, np.int64)
    np.add.at(histogram, rng.integers(1, 101, 400), rng.integers(0, 9, 400))
    left = histogram.copy()
    for pattern, times in solve(histogram, 100):
        assert sum(n * k for n, k in pattern.items()) <= 100
        for n, k in pattern.items():
            left[n] -= k * times
    assert not left.any()


def test_knapsack_against_brute_force():
    value = np.zeros(11)
    value[[3, 4, 5]] = [3.1, 4.5, 5.2]
    limit = np.full(11, 2)
    best = max(
        (a * 3.1 + b * 4.5 + c * 5.2) for a in range(3) for b in range(3) for c in range(3) if 3 * a + 4 * b + 5 * c <= 10
    )
    got = best_configuration(value, limit, 10)
    assert np.isclose(sum(value[n] * k for n, k in got.items()), best)


def test_program_places_every_piece(monkeypatch):
    rng = np.random.default_rng(5)
    histogram = np.bincount(np.clip(rng.lognormal(6, 1, 3000), 1, 2047).astype(int), minlength=2049)
    priced = []

    def keep(*args):
        priced.append(best_configuration(*args))
        return priced[-1]

    monkeypatch.setattr(packing, "best_configuration", keep)
    plan, left = solve(histogram, 2048), histogram.copy()
    for pattern, times in plan:
        assert pattern in priced and times > 0
        for n, k in pattern.items():
            left[n] -= k * times
    assert not left.any() and len(priced) <= np.count_nonzero(histogram)
    assert sum(times for _, times in plan) <= 1.003 * (histogram @ np.arange(2049)) / 2048 + 1


def best_fit(lengths, capacity):
    """Sequences that best fit decreasing needs."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(4))
def test_plans_need_no_more_sequences_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(256, 1 + (rng.exponential(60, 900) if seed % 2 else rng.uniform(60, 140, 900)).astype(int))
    histogram = np.bincount(lengths, minlength=257)
    plan = best_plan(histogram, 256)
    used = np.zeros(257, np.int64)
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 256
        for n, k in pattern.items():
            used[n] += k * times
    assert (used == histogram).all() and sum(n for _, n in plan) <= best_fit(lengths.tolist(), 256)


def triples(rng):
    """Lengths of 1,300 sequences of three pieces each, without a gap."""
    two = rng.integers(100, 200, (1300, 2))
    return np.concatenate([two.ravel(), 512 - two.sum(1)])


@pytest.mark.parametrize(
    "lengths, over",
    [
        (lambda rng: rng.integers(100, 251, 4000), 1.012),
        (lambda rng: rng.integers(150, 301, 4000), 1.03),
        (triples, 1.004),
        (lambda rng: np.clip(rng.lognormal(5, 1, 2000), 1, 512).astype(int), 1.01),
    ],
)
def test_plans_keep_near_the_bound_of_the_weights(lengths, over):
    histogram = np.bincount(lengths(np.random.default_rng(0)), minlength=513)
    plan, bound = bounded_plan(histogram, 512)
    used = np.zeros(513, np.int64)
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 512
        for n, k in pattern.items():
            used[n] += k * times
    assert (used == histogram).all()
    assert bound >= -(-(histogram @ np.arange(513)) // 512)
    assert bound <= sum(n for _, n in plan) <= over * bound


def test_bound_is_above_the_total_length_where_pieces_do_not_fit_together():
    histogram = np.bincount([60] * 900 + [30] * 100, minlength=101)
    plan, bound = bounded_plan(histogram, 100)
    assert bound == sum(n for _, n in plan) == 900  # their tokens fill 570 sequences


def test_words_are_encoded_as_the_library_does():
    mine, theirs = WordEncoder(WORD), tokenizers.Tokenizer.from_file(WORD)
    many = texts()
    for _ in range(2):  # the second time from memory
        ids, bounds = mine.encode(pa.array(many))
        for i, text in enumerate(many):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids
