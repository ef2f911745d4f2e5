"""A hidden Markov language model over word classes, trained by Baum-Welch.

A word's class is a hash of its last bytes, a fixed number of classes. States emit classes,
and a class emits its words by their smoothed training counts, so the states' tables have a
fixed size while the word counts grow with the corpus and stay in a table. In each round
every partition adds up expected counts by the forward-backward recursion, Spark sums them,
and the new model goes out again. A text's likelihood is exact: the scaled forward recursion
over its classes, times its words' shares of their classes.

Word counts come back to documents in chunks: a chunk lists its distinct words once, and a
join on the words' 64-bit hashes returns their counts. Null texts count as empty: the end
token alone. Repeated rows are counted and scored as they stand. Texts of any length are
read whole. Without training rows every count is 0 and the model is its start; an empty
table gives an empty result. Nothing depends on ties; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, save
from .words import WordHasher, mixed, slices

CLASSES = 1024
END = CLASSES
PIECE = 256


class Model:
    """Start, transition and emission probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, shares: np.ndarray, seed: int = 7) -> Model:
        """Sticky states that emit the classes' overall shares, each tilted at random."""
        emit = shares * np.exp(0.6 * np.random.default_rng(seed).standard_normal((states, len(shares))))
        emit[:, END] = shares[END]
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        start, move, emit = start + 0.1, move + 0.1, emit + 5 * shares
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def likelihoods(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each sequence's probability; ``classes`` holds them one after another."""
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        sizes, emit = lengths[order], np.ascontiguousarray(self.emit.T)
        out, alpha = np.zeros(len(lengths)), None
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        for t, n in enumerate(live):
            alpha = np.tile(self.start, (n, 1)) if alpha is None else alpha[:n] @ self.move
            alpha = alpha * emit[classes[begins[:n] + t]]
            scale = alpha.sum(1, keepdims=True)
            alpha /= scale
            out[:n] += np.log10(scale[:, 0])
        back = np.empty_like(out)
        back[order] = out
        return back

    def expected(self, classes: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts over padded pieces (pieces x PIECE); ``width`` is their length."""
        order = np.argsort(-width, kind="stable")
        classes, width = classes[order], width[order]
        n, steps = classes.shape
        k, emit, ones = len(self.start), np.ascontiguousarray(self.emit.T), np.ones(len(self.start))
        live = np.searchsorted(-width, -np.arange(1, steps + 1), side="right")  # pieces longer than t
        alphas, scales = np.empty((steps, n, k)), np.empty((steps, n, 1))
        emits = emit[classes.T]  # steps x pieces x states
        for t, m in enumerate(live):
            a = (alphas[t - 1, :m] @ self.move if t else self.start) * emits[t, :m]
            scales[t, :m, 0] = a @ ones
            alphas[t, :m] = a / scales[t, :m]
        beta, move = np.ones((n, k)), np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            m = live[t]
            ahead = emits[t, :m] * beta[:m] / scales[t, :m]
            emits[t, :m] = alphas[t, :m] * beta[:m]  # no longer needed as emissions
            emits[t, m:] = 0
            if t:
                move += alphas[t - 1, :m].T @ ahead
                beta[:m] = ahead @ self.move.T
        start = emits[0].sum(0)
        flat = classes.T.ravel()
        counts = np.stack([np.bincount(flat, emits[:, :, s].ravel(), CLASSES + 1) for s in range(k)])
        return start, move * self.move, counts


def pieces_of(classes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: texts cut into pieces of PIECE tokens, padded, 1000 at a time."""
    begins = np.cumsum(lengths) - lengths
    starts = np.concatenate([np.arange(b, b + n, PIECE) for b, n in zip(begins, lengths)]) if len(lengths) else np.zeros(0, np.int64)
    ends = np.repeat(begins + lengths, -(-lengths // PIECE))
    padded = np.concatenate([classes, np.zeros(PIECE, classes.dtype)])
    for at in range(0, len(starts), 1000):
        s = starts[at : at + 1000]
        yield padded[s[:, None] + np.arange(PIECE)], np.minimum(ends[at : at + 1000] - s, PIECE)


CHUNK = "chunk long, held binary, lengths binary, classes binary, of_word binary, word binary, times binary, distinct binary"


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Texts as class numbers and word counts, documents of about ``size`` bytes a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make, number = WordHasher(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, size):
                h, starts, tails = make.with_tails(part.column(1))
                hashes, first, of = np.unique(h, return_index=True, return_inverse=True)
                hashes = hashes.view(np.int64)
                class_of = (mixed(tails[first].view(np.uint64)) % np.uint64(CLASSES)).astype(np.uint16)
                words = np.diff(starts)
                lengths = words + 1
                classes = np.full(lengths.sum(), END, np.uint16)
                inside = np.ones(len(classes), np.bool_)
                inside[np.cumsum(lengths) - 1] = False
                classes[inside] = class_of[of]
                owner, wide = np.repeat(np.arange(part.num_rows), words), max(1, len(hashes))
                own, times = np.unique(owner * wide + of, return_counts=True)
                distinct = np.bincount(own // wide, minlength=part.num_rows)
                held = np.array(part.column(2).to_pylist(), np.bool_)
                trained = np.bincount(of[~held[owner]], minlength=len(hashes))
                raw = [held, lengths, classes, class_of, (own % wide).astype(np.uint32), times.astype(np.uint32), distinct.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        *[pa.array([x.tobytes()], pa.binary()) for x in raw],
                        pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                        pa.array([hashes], pa.list_(pa.int64())),
                        pa.array([trained.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([class_of.astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    names=[x.split()[0] for x in CHUNK.split(", ")] + ["ids", "hashes", "trained", "class_of"],
                )
                number += 1

    out = CHUNK + f", ids array<{kind}>, hashes array<long>, trained array<long>, class_of array<int>"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, out)


def _summed(parts: DataFrame) -> list[np.ndarray]:
    """Sum arrays that come in pieces: two levels, so that no group grows with the tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "counts": [total.tobytes()]})

    kind = "part int, salt int, counts binary"
    rows = parts.groupBy("part", "salt").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind).collect()
    return [np.frombuffer(r[2]) for r in sorted(rows, key=lambda r: r[0])]


def train(chunks: DataFrame, shares: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch over the chunks' training rows; the model is of fixed size."""
    model = Model.first(states, shares)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES + 1))]
        for batch in batches:
            for held, lengths, classes in zip(*(c.to_pylist() for c in batch.columns)):
                keep, lengths = ~np.frombuffer(held, np.bool_), np.frombuffer(lengths, np.int64)
                classes = np.frombuffer(classes, np.uint16).astype(np.int64)[np.repeat(keep, lengths)]
                for piece, width in pieces_of(classes, lengths[keep]):
                    for t, x in zip(total, model.expected(piece, width)):
                        t += x
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(range(3), pa.int32()),
                "salt": pa.array([salt] * 3, pa.int32()),
                "counts": [np.ascontiguousarray(t).tobytes() for t in total],
            }
        )

    for _ in range(rounds):
        got = _summed(chunks.select("held", "lengths", "classes").mapInArrow(expect, "part int, salt int, counts binary"))
        if not got:
            break
        start, move, emit = got
        model = Model.of_counts(start, move.reshape(states, states), emit.reshape(states, -1), shares)
    return model


def score_texts(docs: DataFrame, states: int = 6, rounds: int = 5, chunk: int = 6 << 20) -> DataFrame:
    """Train on the rows whose id's crc32 is not 2 modulo 7, and score every row."""
    marked = docs.select("doc_id", "text").withColumn("held_out", id_remainder("doc_id", 7) == 2)
    chunks = save(_chunks(marked, chunk), "chunks")
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("hashes", "trained", "class_of")).alias("place", "w")).select(
        "chunk", F.col("place").cast("int").alias("place"), F.col("w.hashes").alias("h"), F.col("w.trained").alias("n"), F.col("w.class_of").alias("class")
    )
    word = Window.partitionBy("h")
    counted = save(
        listed.withColumn("c", F.sum("n").over(word))
        .withColumn("first", F.row_number().over(word.orderBy("chunk", "place")) == 1)
        .select("chunk", "place", "c", "class", "first", "n"),
        "counts",
    )
    per_class = counted.groupBy("class").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("first") & (F.col("c") > 0), 1).otherwise(0)).alias("v")
    ).collect()  # CLASSES rows at most
    ends = marked.where("NOT held_out").count()
    n_class, v_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for row in per_class:
        n_class[row[0]], v_class[row[0]] = row[1], row[2]
    train_tokens, vocabulary = int(n_class.sum()) + ends, int(v_class.sum()) + (ends > 0)
    smoothed = np.append(n_class[:CLASSES], ends) + 1.0
    model = train(chunks, smoothed / smoothed.sum(), states, rounds)
    share_of = np.log10(n_class + v_class + 1)
    share_of[END] = 0.0
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for at in range(batch.num_rows):
                raw = lambda name, kind: np.frombuffer(of[name][at].as_py(), kind)
                lengths, classes = raw("lengths", np.int64), raw("classes", np.uint16).astype(np.int64)
                found = of["found"][at].values  # arrays as they are: a chunk has many words
                c = np.zeros(0 if found is None else len(found))
                if found is not None:
                    c[found.field("place").to_numpy()] = found.field("c").to_numpy()
                words, times = raw("word", np.uint32), raw("times", np.uint32)
                owner = np.repeat(np.arange(len(lengths)), raw("distinct", np.int64))
                logs = np.bincount(owner, times * np.log10(c[words] + 1), len(lengths))
                known = np.bincount(owner, times * (c[words] > 0), len(lengths)).astype(np.int64) + (ends > 0)
                base = logs + np.log10(ends + 1) - lengths * np.log10(train_tokens + vocabulary + 1)
                shares = np.add.reduceat(share_of[classes], np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        of["ids"][at].values,
                        pa.array(raw("held", np.bool_)),
                        pa.array(lengths), pa.array(known),
                        pa.array(np.full(len(lengths), train_tokens, np.int64)),
                        pa.array(base), pa.array(model.likelihoods(classes, lengths) + logs - shares),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    found = counted.groupBy("chunk").agg(F.collect_list(F.struct("place", "c")).alias("found"))
    columns = ["ids", "held", "lengths", "classes", "word", "times", "distinct"]
    joined = chunks.select("chunk", *columns).join(found, "chunk", "left").select(*columns, "found")
    return joined.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
