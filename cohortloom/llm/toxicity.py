"""Toxicity by a weighted finite-state grammar over clauses.

A first transducer turns the words of a clause into classes: insult (weighted by its stem),
threat, target, negation, report, other. The machines for targets, negations and reports
are composed: each reads what the one before has written, and marks insults and threats as
aimed, negated or reported. One composition reads a clause from its start, another, of
targets and reports that follow, reads the result from its end. A document's score comes
from the marked insults and threats of all its clauses, by a logistic model over the
logarithms of their weights' sums.

Insult stems are learned: word beginnings that mark labelled toxic texts and hardly ever
stand in labelled clean ones as often, chosen greedily so that each adds texts that the others miss.
Targets, negations, reports and threats are closed classes and listed below.

Null and empty texts have no clause and get the model's base score. A row without a label
is only scored; repeated rows get equal scores. Where no toxic or no clean label is known,
every score is the labels' mean (0 without labels). Whole texts are read, of any length.
Empty tables give empty results; ties between stems go to the longest, then the last in
order. Extra columns are ignored by ``toxicity`` and kept by ``score``, whose result column
must not be one of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

# Closed word classes in English, French, German and Spanish.
TARGET = set(
    "you your yours yourself he him his she her they them their tu te toi ton ta vous votre vos "
    "il elle ils elles du dich dir dein deine ihr euch er sie usted ustedes tus ellos ellas".split()
)
NEGATION = set(
    "not never no none nobody isn't aren't wasn't don't doesn't didn't pas jamais aucun aucune "
    "nicht nie niemals kein keine nunca jamás ningún ninguna".split()
)
REPORT = set(
    "said says wrote claimed called reported quoted dit disait écrit affirmé sagte schrieb "
    "behauptete dijo escribió afirmó".split()
)
THREAT = set(
    "kill hurt destroy beat die murder tuer frapper mourir töten schlagen sterben matar golpear "
    "morir".split()
)
OTHER, INSULT = "other", "insult"
CLASS_OF = (
    dict.fromkeys(TARGET, "target") | dict.fromkeys(NEGATION, "negation")
    | dict.fromkeys(REPORT, "report") | dict.fromkeys(THREAT, "threat")
)
CLASSES = ("other", "insult", "threat", "target", "negation", "report")

CLAUSE = re.compile(r"[^.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: French words that lose their last letter before a vowel; a word of its own follows.
ELISION = re.compile(r"\b([cdjlmnst]|qu)['’](?=[^\W\d_]{2})")
#: Lengths of word beginnings that may become stems.
STEM = range(3, 15)
#: Words after which a negation or a report no longer holds.
REACH = 6


def clear(text: str) -> str:
    """``text`` in small letters, elided words apart from what follows them."""
    return ELISION.sub(r"\1 ", text.lower())


class Transducer:
    """Reads a symbol, moves to a state and writes a symbol: ``step[state][symbol]``.

    A symbol is a word's class with the marks that machines before have put on it, as in
    ``insult+aimed``. What a state has no step for, it passes on as it would the bare class.
    """

    def __init__(self, step: list[dict[str, tuple[int, str]]]):
        self.step = step

    def read(self, state: int, symbol: str) -> tuple[int, str]:
        row = self.step[state]
        if symbol in row:
            return row[symbol]
        word_class, _, marks = symbol.partition("+")
        after, out = row[word_class]
        return after, out + "+" + marks if marks else out

    def __matmul__(self, after: Transducer) -> Transducer:
        """The composition: ``after`` reads what this machine writes. States are pairs."""
        index, todo, step = {(0, 0): 0}, [(0, 0)], []
        while len(step) < len(todo):
            a, b = todo[len(step)]
            row = {}
            for symbol in self.step[a]:
                x, between = self.step[a][symbol]
                y, out = after.read(b, between)
                if (x, y) not in index:
                    index[x, y] = len(todo)
                    todo.append((x, y))
                row[symbol] = index[x, y], out
            step.append(row)
        return Transducer(step)


def context(word_class: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats if a word of the class stood within ``reach`` words."""
    rows = []
    for left in range(reach + 1):
        after = max(0, left - 1)
        rows.append(
            {c: (reach if c == word_class else after, f"{c}+{mark}" if left and c in (INSULT, "threat") else c) for c in CLASSES}
        )
    return Transducer(rows)


def grammar() -> tuple[Transducer, Transducer]:
    """What reads a clause from its start, and what then reads the result from its end."""
    forth = context("target", "aimed", REACH) @ context("negation", "negated", REACH) @ context("report", "reported", REACH)
    back = context("target", "aimed", REACH) @ context("report", "reported", REACH)
    return forth, back


def context_of(symbol: str) -> str:
    """What a clause says about an insult or a threat."""
    return next((m for m in ("negated", "reported", "aimed") if m in symbol), "plain")


def marked(machine: tuple[Transducer, Transducer], classes: list[str]) -> list[str]:
    """The symbols of a clause after both readings."""
    forth, back = machine
    out, state = [], 0
    for c in classes:
        state, symbol = forth.step[state][c]
        out.append(symbol)
    state = 0
    for i in range(len(out) - 1, -1, -1):
        state, out[i] = back.read(state, out[i])
    return out


class Scorer:
    """Features of a text: what the grammar emits, weighted by the stems that matched."""

    NAMES = (
        "plain", "aimed", "negated", "reported", "most", "clauses", "distinct", "density",
        "plain_threat", "aimed_threat", "negated_threat", "reported_threat",
    )

    def __init__(self, stems: dict[str, float]):
        self.stems, self.machine = stems, grammar()
        self.lengths = sorted({len(s) for s in stems})
        listed = "|".join(sorted(map(re.escape, stems), key=len, reverse=True))
        threats = "|".join(sorted(THREAT, key=len, reverse=True))
        self.find = re.compile(rf"\b(?:{listed}|(?:{threats})\b)" if stems else rf"\b(?:{threats})\b")

    def weight(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in self.lengths), default=0.0)

    def features(self, text: str) -> list[float]:
        out = dict.fromkeys(self.NAMES, 0.0)
        text = clear(text)
        seen: dict[str, float] = {}
        at = 0
        while hit := self.find.search(text, at):
            start = max(text.rfind(c, 0, hit.start()) for c in ".!?;\n") + 1
            end = CLAUSE.match(text, hit.start()).end()
            at, insults = end, False
            words = WORD.findall(text, start, end)
            weights = [self.weight(w) for w in words]
            classes = [INSULT if x else CLASS_OF.get(w, OTHER) for w, x in zip(words, weights)]
            for word, weight, symbol in zip(words, weights, marked(self.machine, classes)):
                if weight:
                    out[context_of(symbol)] += weight
                    out["most"] = max(out["most"], weight)
                    seen[word] = weight
                    insults = True
                if CLASS_OF.get(word) == "threat":  # a word may be an insult and a threat
                    out[context_of(symbol) + "_threat"] += 1
            out["clauses"] += insults
        out["distinct"] = sum(seen.values())
        out["density"] = 600 * out["distinct"] / max(300, len(text))  # over a hundred words or so
        return [math.log1p(v) for v in out.values()]


def choose_stems(found: list[tuple[str, int, list[int]]], toxic: int, clean: int, most: int = 400) -> dict[str, float]:
    """Stems and weights from (beginning, clean texts with it, toxic texts with it).

    Each round takes the beginning whose toxic texts are least covered, a text's share
    halving with each stem that it has; against it counts three times what its rate among
    clean texts would make of the toxic ones. Among equals the longest is taken. A stem must be rarer by chance than the beginnings are many.
    """
    least = max(3.0, (math.log(max(2, len(found))) + 1) / math.log((toxic + clean + 1) / toxic))
    against = 3 * toxic / clean
    share = dict.fromkeys({d for *_, docs in found for d in docs}, 1.0)
    left, out = {s: (c, docs) for s, c, docs in found}, {}
    while left and len(out) < most:
        gain = {s: sum(share[d] for d in docs) - against * c for s, (c, docs) in left.items()}
        best = max(gain, key=lambda s: (round(gain[s], 6), len(s), s))
        if gain[best] < least:
            break
        c, docs = left[best]
        # Extensions add nothing, nor does a beginning that stands in hardly more texts.
        out[best] = math.log((len(docs) + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        for d in docs:
            share[d] /= 2
        left = {
            s: x for s, x in left.items()
            if gain[s] >= least and not s.startswith(best) and not (best.startswith(s) and 2 * len(x[1]) < 3 * len(docs))
        }
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small quadratic penalty; the last weight is the base."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], decay * len(x))
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most_stems: int = 400) -> tuple[dict[str, float], np.ndarray]:
    """Stems and model from labelled rows.

    ``sample`` bounds the labelled texts that are learned from: those whose ids have the
    lowest hashes. Word beginnings are counted over them by Spark; what reaches the driver
    is bounded by the sample. ``most_stems`` bounds the model's size, not what is scored.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(id_remainder("doc_id", 3) != 1)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = known.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "toxic")

    def rows_of(stems: list[str], n: list[int], ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(n, pa.int64()), ids], names=["stem", "n", "doc"])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter = Counter()
        for batch in batches:
            stems, ids = [], []
            for i, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = set(WORD.findall(clear(text or "")))
                own = {w[:n] for w in words for n in STEM if n <= len(w)}
                if toxic:
                    stems += own
                    ids += [i] * len(own)
                else:
                    clean.update(own)
            yield rows_of(stems, [0] * len(ids), pa.array(ids, pa.int64()))
        keys = list(clean)
        yield rows_of(keys, [clean[k] for k in keys], pa.nulls(len(keys), pa.int64()))

    found = (
        rows.select(F.col("doc_id").cast("long"), "text", "toxic")
        .mapInArrow(beginnings, "stem string, n long, doc long")
        .groupBy("stem").agg(F.sum("n").alias("clean"), F.collect_set("doc").alias("docs"))
        .where("size(docs) >= 3 AND 3 * size(docs) > clean")
        .collect()
    )
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), sum(n for k, n in counts.items() if k != 1)
    if not toxic or not clean:
        base = 30.0 if toxic else -30.0
        return {}, np.array([0.0] * len(Scorer.NAMES) + [base])
    stems = choose_stems([(r[0], r[1], r[2]) for r in found], toxic, clean, most_stems)
    scorer = Scorer(stems)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [scorer.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()
    x, y = np.array([r[0] for r in got]), np.array([float(r[1] == 1) for r in got])
    return stems, fit_logistic(x, y)


def score(docs: DataFrame, stems: dict[str, float], weights: np.ndarray, out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out_col``, from 0 to 1."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    scorer = Scorer(stems)

    @pandas_udf(DoubleType())
    def of_text(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([scorer.features(t or "") for t in texts]).reshape(len(texts), len(Scorer.NAMES))
        z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
        return pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumn(out_col, of_text(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every row."""
    stems, weights = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), stems, weights)
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
