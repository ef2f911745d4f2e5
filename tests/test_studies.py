"""Model studies and neighbour joins against plain loops."""

import math
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import models, neighbours, reduce, scoring, trees
from cohortloom.operators import density


@pytest.mark.parametrize(("block", "pivots", "mirrored"), [(512, 2, False), (3, 2, False), (4, 1, True), (5, 3, True)])
def test_radius_join_against_all_pairs(spark, block, pivots, mirrored):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) * 0.05 + 1, np.zeros((2, 3)), -np.ones((2, 3))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, x array<double>").repartition(3)
    want = []
    for i, j in combinations(range(len(x)), 2):
        d = np.linalg.norm(x[i] - x[j])
        d = min(d, np.linalg.norm(x[i] + x[j])) if mirrored else d
        if d <= 0.6:
            want.append((i, j))
    got = neighbours.radius_join(points, 0.6, pivots, mirrored, block)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert neighbours.radius_join(points.limit(0), 0.6).count() == 0
    with pytest.raises(ValueError):
        neighbours.radius_join(points, 0.0)


def shuffled(spark, run):
    """Bytes written to shuffles while ``run`` runs."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    run()
    return written() - before


def test_radius_join_moves_a_vector_once(spark):
    """With 20 blocks a vector went to 20 tasks, and each time to disk."""
    x = np.random.default_rng(5).normal(size=(2000, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = []
    assert shuffled(spark, lambda: found.append(neighbours.radius_join(points, 2.0, block=100).count())) < 4 * x.nbytes
    square = (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    assert found == [int((square[np.triu_indices(2000, 1)] <= 4).sum())]


def test_radius_join_at_the_edge_of_rounding(spark):
    """Points far from the origin, where single precision can't tell distances, and exact ties."""
    x = [[1e6 + i * 0.25, -1e6] for i in range(40)] + [[1e6, -1e6], [float("nan"), 0.0], [float("inf"), 0.0]]
    points = spark.createDataFrame([(str(i), v) for i, v in enumerate(x)], "id string, x array<double>")
    want = sorted(tuple(sorted((str(i), str(j)))) for i, j in combinations(range(41), 2) if abs(x[i][0] - x[j][0]) <= 0.5)
    assert sorted((r["a"], r["b"]) for r in neighbours.radius_join(points, 0.5, block=16).collect()) == want


def test_radius_join_within_groups(spark):
    rng = np.random.default_rng(6)
    x, of = rng.normal(size=(120, 2)), [None if k % 7 == 0 else "abc"[k % 3] for k in range(120)]
    points = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, of))], "id long, x array<double>, g string")
    want = sorted((i, j) for i, j in combinations(range(120), 2) if of[i] == of[j] and np.linalg.norm(x[i] - x[j]) <= 0.4)
    assert sorted((r["a"], r["b"]) for r in neighbours.radius_join(points, 0.4, block=9, by="g").collect()) == want


def test_dbscan_against_a_loop(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(25, 2)) * 0.2, rng.normal(size=(25, 2)) * 0.2 + 3, rng.uniform(-4, 6, size=(20, 2))])
    near = [{j for j in range(len(x)) if j != i and np.linalg.norm(x[i] - x[j]) <= 0.3} for i in range(len(x))]
    cores = {i for i in range(len(x)) if len(near[i]) + 1 >= 4}
    cluster = {}
    for c in sorted(cores):
        todo = [c]
        while todo:
            i = todo.pop()
            if i not in cluster:
                cluster[i] = c
                todo += [j for j in near[i] if j in cores]
    want = {i: cluster.get(i, min((cluster[j] for j in near[i] if j in cores), default=None)) for i in range(len(x))}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert {r["id"]: r["cluster"] for r in models.dbscan(points, 0.3, 4).collect()} == want
    assert None in want.values() and len(set(want.values())) > 2


def _clusters(x, radius, least):
    """DBSCAN by a loop: cluster by place, None for noise."""
    near = [set(np.nonzero(np.linalg.norm(x - v, axis=1) <= radius)[0]) - {i} for i, v in enumerate(x)]
    cores, cluster = {i for i in range(len(x)) if len(near[i]) + 1 >= least}, {}
    for c in sorted(cores):
        todo = [c]
        while todo:
            i = todo.pop()
            if i not in cluster:
                cluster[i] = c
                todo += [j for j in near[i] if j in cores]
    return {i: cluster.get(i, min((cluster[j] for j in near[i] if j in cores), default=None)) for i in range(len(x))}


def test_dbscan_writes_no_pairs(spark):
    """A cluster in which all points are near each other, which gave two million pairs to disk."""
    x = np.random.default_rng(7).normal(size=(2000, 2)) * 0.01
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = []
    assert shuffled(spark, lambda: found.extend(models.dbscan(points, 1.0, 4).collect())) < 2_000_000
    assert {r["cluster"] for r in found} == {0} and len(found) == 2000


@pytest.mark.parametrize(("least", "radius"), [(1, 0.2), (3, 0.25), (6, 0.4), (300, 1.5)])
def test_dbscan_across_blocks(spark, monkeypatch, least, radius):
    """Small blocks, so that counts, links and borders go from one to another; a chain, copies,
    a cluster, noise, and vectors that are null."""
    rng = np.random.default_rng(least)
    chain = np.stack([np.arange(60) * 0.19, np.full(60, 9.0)], 1)
    x = np.vstack([rng.normal(size=(40, 2)), chain, np.ones((12, 2)) * 4, rng.uniform(-8, 8, size=(60, 2))])[rng.permutation(172)]
    want = _clusters(x, radius, least) | {500: 500 if least == 1 else None}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, x array<double>")
    monkeypatch.setattr(density, "in_blocks", lambda p, r: neighbours.in_blocks(p, r, block=24))
    assert {r["id"]: r["cluster"] for r in density.dbscan(points, radius, least).collect()} == want


def test_reduction_against_the_target(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 20))
    x = np.vstack([base[rng.integers(0, 6)] * rng.choice([-1, 1]) + rng.normal(size=20) * rng.choice([0.05, 0.4]) for _ in range(40)] + [np.ones(20)])
    y = np.repeat([0.0, 1.0], 10)
    corr = lambda a, b: 0.0 if a.std() == 0 or b.std() == 0 else abs(np.corrcoef(a, b)[0, 1])
    own = [corr(v, y) for v in x]
    follows, kept = list(range(len(x))), [True] * len(x)
    for i, j in combinations(range(len(x)), 2):
        if corr(x[i], x[j]) >= 0.8:
            loser, winner = (j, i) if own[i] > own[j] else (i, j)
            kept[loser], follows[loser] = False, follows[winner]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    got = {r["id"]: (r["kept"], r["follows"], round(r["target_r"], 9)) for r in neighbours.reduce_correlated(rows, F.array(*map(F.lit, y.tolist())), 0.8).collect()}
    assert got == {i: (kept[i], follows[i], round(own[i], 9)) for i in range(len(x))}
    assert 1 < sum(kept) < len(x)


@pytest.mark.parametrize("sd", [0.2, 3.0])
def test_repeated_hold_out_of_many_classes_against_a_loop(sd):
    rng = np.random.default_rng(6)
    groups = np.repeat(["a", "b", "c", "d"], [7, 9, 8, 12])
    x = rng.normal(size=(12, len(groups))) + np.outer(rng.uniform(0, 3, 12), np.unique(groups, return_inverse=True)[1])
    got = reduce.multiclass_accuracy(x, groups, rounds=40, sd=sd)
    y, (train_n, test_n) = np.unique(groups, return_inverse=True)[1], reduce.split_sizes(7, 0.25)
    import hashlib

    for row, value in zip(x, got[:, 0]):
        draw = np.random.default_rng(int(hashlib.md5(b"1|all").hexdigest()[:8], 16))
        found, means = [], []
        for _ in range(40):
            dealt = [draw.permutation(np.nonzero(y == c)[0])[: train_n + test_n] for c in range(4)]
            hits = 0
            for c, own in enumerate(dealt):
                for t in own[train_n:]:
                    score = []
                    for k in range(4):
                        v = row[dealt[k][:train_n]]
                        score.append(-0.5 * math.log(v.var() + 1e-10) - (row[t] - v.mean()) ** 2 / (2 * (v.var() + 1e-10)))
                    hits += int(np.argmax(score)) == c
            found.append(100 * hits / (4 * test_n))
            means.append(np.mean(found))
            if len(means) > 10:
                stop = np.std(means, ddof=1) < sd
                means.pop(0)
                if stop:
                    break
        assert value == pytest.approx(np.mean(means))


def test_models_as_rows_a_bag_and_overflow(spark):
    models_ = spark.createDataFrame(
        [
            ("s", 0, "x", "f", 2.0, None, None), ("s", 0, "y", "f", -1.0, None, None), ("s", 0, "x", None, 0.5, None, None),
            ("s", 1, "x", "g", 0.0, 1.0, 2.0), ("s", 1, "y", "g", 0.0, -1.0, 0.5), ("s", 1, "y", None, 0.25, None, None),
            ("t", 0, "x", "f", 1e308, None, None), ("t", 0, "y", "f", 1e308, None, None), ("t", 0, "z", "f", 0.0, None, None),
        ],
        "study string, model int, class string, feature string, slope double, center double, spread double",
    )
    values = spark.createDataFrame([("p", "f", 1.5), ("p", "g", -0.5), ("q", "g", 0.5), ("p", "unknown", 9.0), ("r", "f", 1e9)], "sample string, feature string, value double")
    got = {(r["sample"], r["study"], r["class"]): (r["probability"], r["predicted"]) for r in scoring.predictions(models_, values, values).collect()}

    def softmax(scores):
        e = [math.exp(v - max(scores)) for v in scores]
        return [v / sum(e) for v in e]

    density = lambda v, m, s: -0.5 * (math.log(s) + (v - m) ** 2 / s)
    for sample, f, g in (("p", 1.5, -0.5), ("q", 0.0, 0.5)):
        first = softmax([0.5 + 2 * f, -f])
        second = softmax([density(g, 1, 2), 0.25 + density(g, -1, 0.5)])
        want = [(u + v) / 2 for u, v in zip(first, second)]
        assert [got[sample, "s", c][0] for c in "xy"] == pytest.approx(want)
        assert [got[sample, "s", c][1] for c in "xy"] == [want[0] > want[1], want[1] >= want[0]]
    # Scores beyond all numbers: the last class of the greatest score has it all.
    assert [got["r", "t", c] for c in "xyz"] == [(0.0, False), (1.0, True), (0.0, False)]


def test_roc_area_against_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(rng.integers(0, 2)), float(rng.integers(0, 6))) for g in "ab" for _ in range(60)] + [("c", 1, 0.5)]
    got = {r["g"]: r["area"] for r in scoring.roc_area(spark.createDataFrame(rows, "g string, label long, score double"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, y, s in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
    assert got["c"] is None


def brute_forest(x, y, features, trees_, tries, depth, seed, forest):
    """Every tree's splits by recursion, and each row's leaf and bag."""
    u = lambda *parts: zlib.crc32("|".join(map(str, parts)).encode()) / 2**32
    n = {c: y.count(c) for c in set(y)}
    balance = {c: len(y) / (len(n) * n[c]) for c in n}
    splits, places = {}, {}

    def grow(tree, node, rows, bag, level):
        best = None
        inside = [i for i in rows if bag[i]]
        for t in range(tries if level < depth else 0):
            f = features[int(u(seed, forest, tree, node, t, "f") * len(features))]
            low, high = min(x[i][f] for i in inside), max(x[i][f] for i in inside)
            if low == high:
                continue
            cut = low + u(seed, forest, tree, node, t, "c") * (high - low)
            total = [dict.fromkeys(n, 0.0), dict.fromkeys(n, 0.0)]
            for i in inside:
                total[x[i][f] > cut][y[i]] += bag[i] * balance[y[i]]
            square = lambda d: sum(v * v for v in d.values()) / sum(d.values()) if sum(d.values()) else 0
            gain = round(square(total[0]) + square(total[1]) - square({c: total[0][c] + total[1][c] for c in n}), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, cut)
        if best is None:
            places.update({(tree, i): (node, bag[i]) for i in rows})
            return
        splits[tree, node] = best
        for side in (0, 1):
            grow(tree, 2 * node + side, [i for i in rows if (x[i][best[1]] > best[2]) == side], bag, level + 1)

    for tree in range(trees_):
        bag = [sum(u(seed, forest, tree, i) >= c for c in trees.BAG) for i in range(len(x))]
        grow(tree, 1, list(range(len(x))), bag, 0)
    return splits, places, balance


def test_forest_and_votes_out_of_the_bag_against_recursion(spark):
    rng = np.random.default_rng(9)
    y = [int(v) for v in rng.integers(0, 3, 60)]
    x = (rng.normal(size=(60, 5)) + np.outer(y, [1.5, 0, 0.7, 0, 0])).tolist()
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, x))], "id long, label int, x array<double>").repartition(3)
    splits, places = trees.grow(rows, {"w": [0, 2, 4], "v": [1, 3]}, 4, 3, 3, seed=5)
    kept = places.cache()
    for forest, features in (("w", [0, 2, 4]), ("v", [1, 3])):
        want, leaf, balance = brute_forest(x, y, features, 4, 3, 3, 5, forest)
        got = {(r["tree"], r["node"]): (r["gain"], r["feature"], r["cut"]) for r in splits.where(F.col("forest") == forest).collect()}
        assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
        at = {(r["tree"], r["id"]): (r["node"], r["bag"]) for r in kept.where(F.col("forest") == forest).collect()}
        assert at == leaf
        votes = {}
        for i in range(60):
            for tree in range(4):
                node, bag = leaf[tree, i]
                if not bag:
                    share = dict.fromkeys(range(3), 0.0)
                    for j in range(60):
                        if leaf[tree, j][0] == node:
                            share[y[j]] += leaf[tree, j][1] * balance[y[j]]
                    for c in share:
                        votes.setdefault(i, dict.fromkeys(range(3), 0.0))[c] += share[c] / sum(share.values())
        best = {i: min(v, key=lambda c: (-round(v[c], 9), c)) for i, v in votes.items()}
        assert {r["id"]: r["predicted"] for r in trees.out_of_bag(kept.where(F.col("forest") == forest)).collect()} == best
    shares = {}
    for (tree, _), (gain, f, _c) in brute_forest(x, y, [0, 2, 4], 4, 3, 3, 5, "w")[0].items():
        shares.setdefault(tree, {}).setdefault(f, 0.0)
        shares[tree][f] += gain
    got = {r["feature"]: r["importance"] for r in trees.importances(splits.where("forest = 'w'"), 4).collect()}
    assert got == pytest.approx({f: sum(s.get(f, 0) / sum(s.values()) for s in shares.values()) / 4 for f in got})
    kept.unpersist()
    assert [r["features"] for r in trees.accuracy_by_features(rows, 4, 5, 3, 3).orderBy("features").collect()] == [2, 3, 4]


def test_every_kind_of_classifier_tells_apart_what_is_apart(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4)) * 0.3 + np.eye(4)[y] * 3
    rows = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))], "vec_id long, label int, embedding array<double>")
    got = {r["kind"]: r["accuracy"] for r in models.classifier_zoo(rows.where("vec_id < 110"), rows.where("vec_id >= 110")).collect()}
    assert set(got) == set(models.CLASSIFIERS) and min(got.values()) > 90


def test_a_second_map_of_samples(spark):
    cells = [(f"s{i}", n, float(10 * (i % 2 == n % 2) + n / 10)) for i in range(6) for n in range(4) if (i, n) != (5, 3)]
    got = {r["sample"]: r["node"] for r in models.second_map(spark.createDataFrame(cells, "sample string, node int, total double"), 2, 1).collect()}
    assert got["s0"] == got["s2"] == got["s4"] != got["s1"] == got["s3"] == got["s5"]
