import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from cohortloom.llm import alignment
from cohortloom.llm.alignment import Pieces, align_corpus, lockstep

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, libraries):
    from cohortloom.llm.merges import byte_letters

    a_model, b_model = libraries
    letter = {c: i for i, c in enumerate(byte_letters())}
    docs, count = [], Counter()
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False) if text else None
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(map(letter.__getitem__, x)) for x in a.tokens] if a else []
        names = [b_model.id_to_piece(x) for x in b]
        b_bytes = [bytes([int(x[3:5], 16)]) if b_model.is_byte(k) else x.replace("▁", " ").encode() for k, x in zip(b, names)]
        a_ids = a.ids if a else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            a_ids, b, a_bytes, b_bytes = [], [], [], []
        spans = []
        for tokens in (a_bytes, b_bytes):
            ends = np.cumsum([len(x) for x in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links = [(x, y) for x, (s, e) in zip(a_ids, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, sp) if low <= s and e <= cut) for ids, sp in ((a_ids, spans[0]), (b, spans[1]))))
            low = cut
        count.update(links)
        docs.append((i, len(a_ids), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (i, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), g and hashlib.sha256(g.encode()).hexdigest())
        for i, na, nb, ng, links, g in docs
    ]


def texts(rng):
    parts = ["hello", "World", "naïve", "日本語", "…", "\n", "\t", "  ", "   ", " ", "1234567", "<|endoftext|>", "<s>", "ﬁ", " ", "don't", "𝔘𝔫", "​", "ha" * 9, "</s>"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40)))


def test_alignment_against_both_libraries(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", 8)
    monkeypatch.setattr(alignment, "BLOCK", 1 << 10)
    rng = random.Random(3)
    rows = [(i, texts(rng)) for i in range(120)] + [(i, " ".join(rng.choice(["the", "cat", "Sat", "ünder", "it"]) for _ in range(300))) for i in range(120, 130)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "  a  "), (205, "x"), (205, "x"), (None, "y z")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, block int").repartition(3)
    got = sorted(map(tuple, align_corpus(docs, A, B).collect()), key=str)
    assert got == sorted(brute(rows, libraries), key=str)
    assert [r[1] for r in got if r[0] == 203] == [0]
    assert align_corpus(docs.limit(0), A, B).count() == 0


def test_words_of_the_piece_model_one_by_one(spark, libraries):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    rows += ["a  b", " a ", "x\n y  ", "é" * 400, "word " * 3000]
    raw = [(" " + t).encode() for t in rows]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    ids, first = Pieces(B).ids(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [ids[x:y].tolist() for x, y in zip(first, first[1:])] == libraries[1].encode(rows)


def test_lanes_give_what_one_lane_gives(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (np.unique(np.append(rng.integers(1, 3000, 900), 3000)) for _ in range(2))
    first = (np.array([0, len(a)]), np.array([0, len(b)]))
    whole = lockstep(a, b, *first)
    monkeypatch.setattr(alignment, "LANE", 5)
    assert all(np.array_equal(x, y) for x, y in zip(whole, lockstep(a, b, *first)))
    assert len(whole[0]) == len(a) + len(b) - len(whole[2])
    assert pa.array(whole[2]).equals(pa.array(np.searchsorted(a, np.intersect1d(a, b))))
