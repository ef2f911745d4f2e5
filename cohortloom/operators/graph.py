"""The overlap graph of k-mers: edges, trimming, components and assembled sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .neighbours import correlated_pairs


def overlap_edges(nodes: DataFrame, k: int, reach: int = 1, most: int = 4) -> DataFrame:
    """(src, dst, shift): the end of one k-mer is the start of another.

    The smallest shift with any partner counts for a k-mer; where that has ``most``
    partners or more, itself included, it has no edges. One equi-join a shift.
    """
    found = None
    for shift in range(1, reach + 1):
        left = nodes.select(F.col("kmer").alias("src"), F.substring("kmer", shift + 1, k - shift).alias("part"))
        right = nodes.select(F.col("kmer").alias("dst"), F.substring("kmer", 1, k - shift).alias("part"))
        step = left.join(right, "part").select("src", "dst", F.lit(shift).alias("shift"))
        found = step if found is None else found.unionByName(step)
    at = found.groupBy("src", "shift").agg(F.count("*").alias("partners"))
    first = at.groupBy("src").agg(F.min_by("partners", "shift").alias("partners"), F.min("shift").alias("shift"))
    return (
        found.join(first.where(F.col("partners") < most).select("src", "shift"), ["src", "shift"])
        .where("src <> dst").select("src", "dst", "shift")
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("kmer"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("kmer"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("kmer").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("kmer").join(edges.select(F.col("dst").alias("kmer")), "kmer", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(kmer, component): the component's smallest k-mer, over weak links.

    Every round a k-mer takes the least label among its neighbours, and so does the k-mer
    that its own label names: whole trees of labels hook on to smaller ones, not only their
    rims. Then it jumps to that label's label, so that rounds grow with the logarithm of a
    chain. Labels only fall and stay within their component.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        near = labels.join(around, "a").select("a", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        hooks = near.groupBy(F.col("old").alias("a")).agg(F.min("label").alias("hook"))
        hooked = near.join(hooks, "a", "left").select("a", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = stored(hooked, "hooked")
        further = hooked.select(F.col("a").alias("label"), F.col("label").alias("further"))
        following = stored(
            hooked.join(further, "label", "left").select("a", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        done = not following.where("label <> old").take(1)
        dropped(labels, hooked)
        if done:
            break
        labels = following
    dropped(both)
    return following.select(F.col("a").alias("kmer"), F.col("label").alias("component"))


def component_types(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """linear or complex (a degree over 1), circular where nothing is a root; with sizes."""
    of = parts.join(degrees(edges), "kmer").groupBy("component").agg(
        F.count("*").alias("n_nodes"),
        F.max(F.greatest("out_degree", "in_degree")).alias("degree"),
        F.min("in_degree").alias("least_in"),
    )
    kind = F.when(F.col("degree") > 1, "complex").otherwise("linear")
    return of.select("component", "n_nodes", F.when(F.col("least_in") > 0, F.concat(kind, F.lit("_circular"))).otherwise(kind).alias("graph_type"))


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("graph_type").agg(F.count("*").alias("n_graphs"), F.sum("n_nodes").alias("n_nodes"))


def _to_drop(branches: list[str], onward: dict[str, list[str]], best: dict[str, float]) -> list[str]:
    """Of a node's branches those of one or two nodes, and of those that branch again all
    but the one of the greatest score, the first in order among equals."""
    drop, kept, top = [], None, 0.0
    for b in branches:
        following = onward.get(b, [])
        if not following:
            drop.append(b)
        elif len(following) == 1:
            if not onward.get(following[0]):
                drop.append(b)
        else:
            drop.append(b)
            if best[b] > top:
                kept, top = b, best[b]
    return [b for b in drop if b != kept]


def trimmed(succ: dict[str, list[str]], pred: dict[str, list[str]], best: dict[str, float]) -> None:
    """Drop side branches node by node in k-mer order, each node's edges out and then its
    edges in; what is dropped is gone for the nodes after it."""
    for node in sorted(best):
        for out, back in ((succ, pred), (pred, succ)):
            if len(out.get(node, [])) > 1:
                for b in _to_drop(out[node], out, best):
                    out[node].remove(b)
                    back[b].remove(node)


def closest(values: dict[str, np.ndarray], node: str, following: list[str]) -> str | None:
    """The branch whose scores are on average closest to the node's, if no more than 3 away
    and the next one is at least 5 further."""
    near = sorted(following, key=lambda b: float(np.abs(values[b] - values[node]).mean()))
    first, second = (float(np.abs(values[b] - values[node]).mean()) for b in near[:2])
    return near[0] if first <= 3 and second - first >= 5 else None


def assembled(rows: pd.DataFrame, links: pd.DataFrame, threshold: float, trim: bool = True) -> list[tuple[str, str, float, int]]:
    """(sequence, best k-mer, its score, nodes) walked from the roots of one component.

    A row is a k-mer (kmer, scores), or stands for a stretch of unbranched ones: then it has
    their letters (``text``), number (``n``), best k-mer and its score. Where the roots don't
    reach all nodes the walk goes on at the smallest first node of an unbranched stretch.
    An edge's shift is that of all edges of its source.
    """
    values = {k: np.asarray(v, float) for k, v in zip(rows["kmer"], rows["scores"])}
    score = {k: float(v.max()) for k, v in values.items()}
    name, size, letters = {}, {}, {}
    if "text" in rows:
        for k, text, n, best, top in zip(rows["kmer"], rows["text"], rows["n"], rows["best_kmer"], rows["best_score"]):
            if text is not None:
                name[k], size[k], letters[k], score[k] = best, int(n), text, float(top)
    if not score or max(score.values()) < threshold:
        return []
    succ: dict[str, list[str]] = {}
    pred: dict[str, list[str]] = {}
    for a, b, s in zip(links["src"], links["dst"], links["shift"]):
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
        letters.setdefault(a, a[: int(s)])
    for d in (succ, pred):
        for x in d.values():
            x.sort()
    heads = {n for n in score if len(pred.get(n, [])) != 1 or len(succ[pred[n][0]]) > 1}
    if trim:
        trimmed(succ, pred, score)
    todo = sorted(n for n in score if not pred.get(n)) or [max(score, key=lambda n: (score[n], n))]
    seen: set[str] = set()
    out = []
    while todo:
        root = todo.pop(0)
        if root in seen:
            continue
        parts, node, best, n = [], root, root, 0
        back = root
        for _ in range(3):
            if not pred.get(back) or pred[back][0] == root:
                break
            back = pred[back][0]
            parts.insert(0, letters[back])
        while True:
            n += size.get(node, 1)
            if score[node] > score[best]:
                best = node
            following = succ.get(node, [])
            if node in seen or not following:
                seen.add(node)
                break
            seen.add(node)
            chosen = following[0]
            if len(following) > 1:
                chosen = closest(values, node, following)
                todo += [b for b in following if b != chosen]
                if chosen is None:
                    break
            parts.append(letters[node])
            node = chosen
        if score[best] >= threshold:
            out.append(("".join(parts) + node, name.get(best, best), float(score[best]), n))
        if not todo:
            todo = sorted(heads - seen)[:1]
    return out


def chains(edges: DataFrame) -> DataFrame:
    """(kmer, head, pos) of k-mers that follow another on an unbranched chain: its first
    k-mer and the number of steps from there.

    List ranking by doubling: every k-mer knows one before it and how far that is, and in
    each round takes over what that one knows, so rounds grow with the logarithm of the
    longest chain. ``edges`` must have no circle without branches (see ``cut_circles``).
    """
    outs = edges.groupBy("src").agg(F.count("*").alias("_o")).where("_o = 1").select("src")
    ins = edges.groupBy("dst").agg(F.count("*").alias("_i")).where("_i = 1").select("dst")
    plain = edges.join(outs, "src", "left_semi").join(ins, "dst", "left_semi")
    known = stored(plain.select(F.col("dst").alias("kmer"), F.col("src").alias("head"), F.lit(1).cast("long").alias("pos")), "chains")
    while True:
        before = known.select(F.col("kmer").alias("head"), F.col("head").alias("further"), F.col("pos").alias("more"))
        moved = known.join(before, "head", "left")
        following = stored(
            moved.select("kmer", F.coalesce("further", "head").alias("head"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.col("further").isNotNull().alias("moved")),
            "chains",
        )
        dropped(known)
        known = following
        if not known.where("moved").take(1):
            return known.select("kmer", "head", "pos")


#: K-mers at either end of a chain that trimming and branch choice look at.
ENDS = 3


def contracted(nodes: DataFrame, edges: DataFrame, parts: DataFrame, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The graph with the inner k-mers of each unbranched chain as one row, named by the
    first of them: rows (part, kmer, scores, text, n, best_kmer, best_score), whose last four
    are null for plain k-mers, and links (of, src, dst, shift).

    Letters are put together by blocks of a chain, and blocks by chain.
    """
    ranked = chains(edges)
    placed = parts.join(ranked, "kmer", "left").select(
        F.col("component").alias("part"), "kmer", F.coalesce("head", "kmer").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos")
    )
    sizes = placed.groupBy("head").agg((F.max("pos") + 1).alias("m"))
    inner = (F.col("pos") >= ENDS) & (F.col("pos") < F.col("m") - ENDS)
    placed = stored(placed.join(sizes, "head").join(nodes, "kmer").withColumn("inner", inner), "placed")
    steps = edges.select(F.col("src").alias("kmer"), F.col("shift"))
    within = placed.where("inner").join(steps, "kmer")
    top = F.struct(F.array_max("scores").alias("score"), (-F.col("pos")).alias("first"), "kmer")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), "")
    pieces = within.withColumn("at", F.col("pos")).withColumn("letters", F.expr("substring(kmer, 1, shift)"))
    pieces = pieces.groupBy("part", "head", F.floor(F.col("pos") / block).alias("b")).agg(
        joined("letters").alias("text"), F.count("*").alias("n"), F.max(top).alias("top"), F.min_by(F.struct("kmer", "scores"), "pos").alias("first")
    )
    merged = pieces.withColumn("at", F.col("b")).groupBy("part", "head").agg(
        joined("text").alias("text"), F.sum("n").alias("n"), F.max("top").alias("top"), F.min_by("first", "b").alias("first")
    )
    one = merged.select("part", "first.kmer", "first.scores", "text", "n", F.col("top.kmer").alias("best_kmer"), F.col("top.score").alias("best_score"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("n", "long"), ("best_kmer", "string"), ("best_score", "double"))]
    rows = placed.where("NOT inner").select("part", "kmer", "scores", *none).unionByName(one)
    ends = placed.select("part", "kmer", "head", "inner")
    named = merged.select(F.col("head"), F.col("first.kmer").alias("name"))
    source = ends.select("part", F.col("kmer").alias("src"), "head", F.col("inner").alias("src_in"))
    target = ends.select(F.col("kmer").alias("dst"), F.col("inner").alias("dst_in"), F.col("head").alias("dst_head"))
    met = edges.join(source, "src").join(target, "dst").where("NOT (src_in AND dst_in)")
    links = met.join(named, "head", "left").select(
        F.col("part").alias("of"), F.when(F.col("src_in"), F.col("name")).otherwise(F.col("src")).alias("src"), "dst", "shift"
    )
    return rows, links


def assemble(nodes: DataFrame, edges: DataFrame, parts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Sequences longer than k + 3 of every component.

    ``nodes`` (kmer, scores array<double>, one a comparison). Chains without branches are
    put together by Spark (see ``contracted``); only branch k-mers, their neighbours and a
    row a chain come to the walk, which depends on order and takes a component at a time.
    """
    rows, links = contracted(nodes, edges, parts)

    def walk(key: tuple, own: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["component", "sequence", "best_kmer", "best_score", "n_nodes"])
        found = [(own["part"].iloc[0], *x) for x in assembled(own, between, threshold) if len(x[0]) > k + 3]
        return pd.DataFrame(found, columns=["component", "sequence", "best_kmer", "best_score", "n_nodes"])

    return rows.groupBy("part").cogroup(links.groupBy("of")).applyInPandas(
        walk, "component string, sequence string, best_kmer string, best_score double, n_nodes long"
    )


def seeds(nodes: DataFrame, parts: DataFrame, threshold: float, first: int = 11) -> DataFrame:
    """(component, seed, comparison, score): the components that a greedy choice of seeds
    reaches, each with the k-mer that it starts from.

    K-mers are taken comparison by comparison, the best score first (ties: the smaller
    k-mer). One that lies in no component so far opens its own, and a comparison stops
    at the first such k-mer below ``threshold`` that isn't among its ``first`` ones. As
    scores fall, that is: a component is reached through the first comparison in which one
    of its k-mers is among the ``first`` or has the threshold, by the best such k-mer.
    """
    long = nodes.select("kmer", F.posexplode("scores").alias("comparison", "score"))
    width = nodes.select(F.max(F.size("scores"))).first()[0] or 0
    best = None
    for i in range(width):  # a comparison each
        top = nodes.select("kmer", F.lit(i).alias("comparison"), F.col("scores")[i].alias("score")).orderBy(F.desc("score"), "kmer").limit(first)
        best = top if best is None else best.unionByName(top)
    met = long.where(F.col("score") >= threshold)
    met = met.unionByName(best).distinct() if best is not None else met
    order = F.struct("comparison", (-F.col("score")).alias("less"), "kmer")
    return met.join(parts, "kmer").groupBy("component").agg(F.min(order).alias("o")).select(
        "component", F.col("o.kmer").alias("seed"), F.col("o.comparison").alias("comparison"), (-F.col("o.less")).alias("score")
    )


def cut_circles(edges: DataFrame, parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges of chosen components (component, seed), without those into the seed of a
    component that has no root."""
    of = edges.join(parts.withColumnRenamed("kmer", "src"), "src").join(chosen.select("component", "seed"), "component")
    roots_of = parts.join(edges.select(F.col("dst").alias("kmer")), "kmer", "left_anti").select("component").distinct()
    rooted = roots_of.withColumn("_rooted", F.lit(True))
    kept = of.join(rooted, "component", "left").where(F.col("_rooted") | (F.col("dst") != F.col("seed")))
    return kept.select("src", "dst", "shift")


def best_per_component(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    return parts.join(nodes, "kmer").groupBy("component").agg(
        F.max_by("kmer", F.struct("score", "kmer")).alias("best_kmer"), F.max("score").alias("best_score")
    )


def correlated_losers(counts: DataFrame, ceiling: float) -> DataFrame:
    """K-mers that a stronger one of the same gene is correlated with beyond ``ceiling``; of
    equal ones the first in order goes. K-mers without a gene are compared with each other.

    ``counts`` (kmer, gene, score, x array<double>). Pairs come from a radius join within
    genes, which splits a gene of any size.
    """
    pairs = correlated_pairs(counts.select(F.col("kmer").alias("id"), "gene", "x"), ceiling, signed=True, by="gene").where(F.col("r") > ceiling)
    side = lambda n: counts.select(F.col("kmer").alias(n), F.col("score").alias("s" + n))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.select(F.when(F.col("sa") > F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("kmer")).distinct()


def pearson(x, y):  # noqa: ANN001, ANN201
    """Pearson correlation of two arrays."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size(x)
    sx, sy = total(x), total(y)
    sxy = total(F.zip_with(x, y, lambda a, b: a * b))
    sxx, syy = total(F.transform(x, lambda a: a * a)), total(F.transform(y, lambda a: a * a))
    return F.try_divide(n * sxy - sx * sy, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))
