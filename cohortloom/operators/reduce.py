"""Feature reduction: pairwise naive Bayes accuracy behind an entropy gate."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import numbered


def split_sizes(least_group: int, share: float) -> tuple[int, int]:
    """(training, test) samples per group in a balanced hold-out."""
    test = int(least_group * share)
    if test < 2 and least_group > 5:
        test = 2
    return least_group - test, test


def balanced_split(samples: DataFrame, group: str, key: str, share: float, seed: int | None = None) -> DataFrame:
    """``part``: train, test or unused, as many of each group; by hash of the key, or in
    key order where no seed is given."""
    least = samples.groupBy(group).count().agg(F.min("count")).first()[0] or 0
    train, test = split_sizes(least, share)
    order = F.col(key) if seed is None else F.xxhash64(F.col(key), F.lit(seed))
    ranked = numbered(samples, [group], [order, F.col(key)], "_n")
    part = F.when(F.col("_n") <= train, "train").when(F.col("_n") <= train + test, "test").otherwise("unused")
    return ranked.withColumn("part", part).drop("_n")


def naive_bayes_accuracy(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Percent of test samples that a Gaussian naive Bayes on one feature gets right, for
    every row of x at once; y is 0 or 1."""
    scores = []
    for c in (0, 1):
        own = x[:, train[y[train] == c]]
        mean, var = own.mean(1, keepdims=True), own.var(1, keepdims=True) + 1e-10
        scores.append(-0.5 * np.log(var) - (x[:, test] - mean) ** 2 / (2 * var))
    return 100 * ((scores[1] > scores[0]) == (y[test] == 1)).mean(1)


def pairwise_accuracy(x: np.ndarray, groups: np.ndarray, share: float = 0.25, rounds: int = 100, sd: float = 0.5, seed: int = 1) -> np.ndarray:
    """Mean accuracy of each row of ``x`` for each pair of groups, by repeated hold-out.

    A row is done once over 10 rounds its standard error is below ``sd``; splits are the
    same for all rows, so rows are worked on together and leave as they are done.
    """
    names = np.unique(groups)
    least = min((groups == g).sum() for g in names)
    train_n, test_n = split_sizes(int(least), share)
    out = []
    for g, h in combinations(names, 2):
        rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{g}|{h}".encode()).hexdigest()[:8], 16))
        y = (groups == h).astype(int)
        total, square = np.zeros(len(x)), np.zeros(len(x))
        done, live = np.zeros(len(x)), np.arange(len(x))
        for r in range(1, rounds + 1):
            train, test = [], []
            for c in (g, h):
                p = rng.permutation(np.nonzero(groups == c)[0])
                train.append(p[:train_n])
                test.append(p[train_n : train_n + test_n])
            acc = naive_bayes_accuracy(x[live], y, np.concatenate(train), np.concatenate(test))
            total[live] += acc
            square[live] += acc * acc
            done[live] = r
            if r > 10:
                var = np.maximum(0, square[live] - total[live] ** 2 / r) / (r - 1)
                live = live[np.sqrt(var / r) >= sd]
                if not len(live):
                    break
        out.append(total / np.maximum(1, done))
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def bayes_predictions(x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, classes: int) -> np.ndarray:
    """The class, of any number, that a Gaussian naive Bayes on one feature gives the test
    samples, for every row of x at once."""
    best, out = None, None
    for c in range(classes):
        own = x[:, train[y[train] == c]]
        mean, var = own.mean(1, keepdims=True), own.var(1, keepdims=True) + 1e-10
        score = -0.5 * np.log(var) - (x[:, test] - mean) ** 2 / (2 * var)
        if best is None:
            best, out = score, np.zeros(score.shape, int)
        else:
            out = np.where(score > best, c, out)
            best = np.maximum(score, best)
    return out


def multiclass_accuracy(
    x: np.ndarray, groups: np.ndarray, share: float = 0.25, rounds: int = 100, sd: float = 0.5, seed: int = 1, window: int = 10
) -> np.ndarray:
    """One accuracy a row of ``x`` over all groups at once, by repeated balanced hold-out.

    After each round the mean of all accuracies so far is noted. Once more than ``window``
    means stand, a row is done if they deviate by less than ``sd``; the oldest is then
    forgotten. What comes back is the mean of those that still stand. Rows share their
    splits and leave the batch as they are done.
    """
    names, y = np.unique(groups, return_inverse=True)
    if not len(names):
        return np.zeros((len(x), 0))
    train_n, test_n = split_sizes(int(np.bincount(y).min()), share)
    rng = np.random.default_rng(int(hashlib.md5(f"{seed}|all".encode()).hexdigest()[:8], 16))
    live, total, out = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x))
    means = np.zeros((len(x), 0))
    for r in range(1, rounds + 1):
        dealt = [rng.permutation(np.nonzero(y == c)[0])[: train_n + test_n] for c in range(len(names))]
        train, test = (np.concatenate([p[s] for p in dealt]) for s in (slice(train_n), slice(train_n, None)))
        if not len(test) or not len(live):
            break
        hits = bayes_predictions(x[live], y, train, test, len(names)) == y[test]
        total[live] += 100 * hits.mean(1)
        means = np.column_stack([means, total[live] / r])
        done = np.zeros(len(live), bool)
        if means.shape[1] > window:
            done = means.std(1, ddof=1) < sd
            means = means[:, 1:]
        out[live] = means.mean(1)
        live, means = live[~done], means[~done]
    return out[:, None]


Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairwise_score(rows: DataFrame, groups: list[str], scorer: Scorer = pairwise_accuracy) -> DataFrame:
    """``acc`` for rows (kmer, counts): one value a pair of groups g < h.

    ``groups`` has the group of each place of the array. Any function of (rows x samples,
    groups) will do as ``scorer``.
    """
    of = np.array(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                acc = scorer(np.stack(pdf["counts"].to_numpy()).astype(float), of)
                yield pdf.assign(acc=list(acc))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, acc array<double>")


def row_entropy(x: np.ndarray) -> np.ndarray:
    total = x.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = x / total
        return np.where(total[:, 0] > 0, -np.nansum(np.where(p > 0, p * np.log2(p), 0), axis=1), np.nan)


class EntropyGate:
    """The threshold that follows the least entropy of kept rows: lowered or raised each
    time 30, 60, 90, ... more rows have been kept."""

    def __init__(self, down: float = 0.25, up: float = 0.05):
        self.down, self.up, self.threshold = down, up, 0.0
        self.least, self.since, self.every = 1e6, 0, 30

    def kept(self, entropy: float) -> None:
        self.least, self.since = min(self.least, entropy), self.since + 1
        if self.since < self.every:
            return
        step = self.least * self.down
        if self.threshold == 0:
            self.threshold = self.least - 2 * step
        elif self.least - step < self.threshold:
            self.threshold -= step
        else:
            self.threshold += self.least * self.up
        self.least, self.since, self.every = 1e6, 0, self.every + 30


def reduce_adaptive(rows: DataFrame, groups: list[str], least_accuracy: float = 65.0, down: float = 0.25, up: float = 0.05, size: int = 1 << 18) -> DataFrame:
    """Rows (kmer, counts) that pass the gate and tell some pair of groups apart.

    The gate is a state of one k-mer range, read in k-mer order: ranges have ``size`` k-mers,
    each scanned on its own, so the threshold adapts within each and as many tasks work as
    there are ranges. The result depends on ``size``, and not on how the input is partitioned.
    """
    of = np.array(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, at_range = EntropyGate(down, up), None
        for pdf in batches:
            cuts = sorted({*range(0, len(pdf), 500), *np.nonzero(pdf["_range"].diff().fillna(0).to_numpy())[0].tolist(), len(pdf)})
            for at, end in zip(cuts, cuts[1:]):
                part = pdf.iloc[at:end].reset_index(drop=True)
                if part["_range"][0] != at_range:
                    gate, at_range = EntropyGate(down, up), part["_range"][0]
                x = np.stack(part["counts"].to_numpy()).astype(float)
                h = row_entropy(x)
                maybe = np.nonzero(h >= gate.threshold - gate.threshold * gate.down)[0]
                acc = np.full((len(part), len(np.unique(of)) * (len(np.unique(of)) - 1) // 2), np.nan)
                acc[maybe] = pairwise_accuracy(x[maybe], of)
                keep, thresholds = [], []
                for i in range(len(part)):
                    good = h[i] >= gate.threshold
                    if good and np.isnan(acc[i]).any():
                        acc[i] = pairwise_accuracy(x[i : i + 1], of)[0]
                    if good and (acc[i] >= least_accuracy).any():
                        gate.kept(h[i])
                        keep.append(i)
                        thresholds.append(gate.threshold)
                yield pd.DataFrame({
                    "kmer": part["kmer"].iloc[keep].to_numpy(), "acc": [acc[i] for i in keep],
                    "entropy": h[keep], "entropy_threshold": np.array(thresholds, float),
                })

    ranked = numbered(rows.select("kmer", "counts").withColumn("_all", F.lit(0)), ["_all"], [F.col("kmer")], "_n")
    ranges = max(1, -(-rows.count() // size))
    dealt = ranked.select("kmer", "counts", F.floor((F.col("_n") - 1) / size).cast("int").alias("_range"))
    return dealt.repartition(ranges, "_range").sortWithinPartitions("_range", "kmer").mapInPandas(
        run, "kmer string, acc array<double>, entropy double, entropy_threshold double"
    )


def accurate(scored: DataFrame, least: float = 65.0) -> DataFrame:
    return scored.where(F.exists("acc", lambda a: a >= least))


def rescaled_scores(scored: DataFrame, column: str = "acc") -> DataFrame:
    """Each comparison's scores over its greatest one, to 100; long: (kmer, comparison, score)."""
    long = scored.select("kmer", F.posexplode(column).alias("comparison", "raw"))
    top = long.groupBy("comparison").agg(F.max("raw").alias("_top"))
    return long.join(top, "comparison").select("kmer", "comparison", "raw", F.try_divide(F.col("raw") * 100, F.col("_top")).alias("score"))
