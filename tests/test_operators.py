import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import stats
from cohortloom.operators import annotation, browse, graph, intervals, models, reduce, running, similarity
from cohortloom.sources import files
from cohortloom.streaming.ingest import ingest_counts


def nodes_of(spark, kmers):
    return spark.createDataFrame([(k, float(i + 80)) for i, k in enumerate(kmers)], "kmer string, score double")


def test_linear_chain_assembles(spark):
    text = "ACGTTGCAAT"
    k = 5
    nodes = nodes_of(spark, [text[i : i + k] for i in range(len(text) - k + 1)])
    edges = graph.overlap_edges(nodes, k)
    assert edges.count() == 5
    parts = graph.components(edges)
    assert parts.select("component").distinct().count() == 1
    got = graph.assemble(nodes.select("kmer", F.array("score").alias("scores")), edges, parts, k, 50.0).collect()
    assert [r["sequence"] for r in got] == [text]
    assert graph.component_types(parts, edges).first()["graph_type"] == "linear"


def test_circle_has_no_root(spark):
    circle = "ACGTTGCA"
    kmers = [(circle + circle)[i : i + 5] for i in range(len(circle))]
    nodes = nodes_of(spark, kmers)
    edges = graph.overlap_edges(nodes, 5)
    assert graph.roots(nodes, edges).count() == 0
    assert graph.component_types(graph.components(edges), edges).first()["graph_type"] == "linear_circular"


def test_four_partners_are_no_edges(spark):
    nodes = nodes_of(spark, ["ACGT", "CGTA", "CGTC", "CGTG", "CGTT"])
    assert graph.overlap_edges(nodes, 4).where("src = 'ACGT'").count() == 0


def walked(spark, nodes, reach, most, threshold, whole):
    """Sequences of a graph: the walk over all its k-mers, or that over contracted chains."""
    k = len(nodes[0][0])
    rows = spark.createDataFrame(nodes, "kmer string, scores array<double>")
    edges = graph.overlap_edges(rows, k, reach=reach, most=most)
    parts = graph.components(edges)
    chosen = graph.seeds(rows, parts, threshold)
    edges = graph.cut_circles(edges, parts, chosen)
    parts = parts.join(chosen, "component", "left_semi")
    if not whole:
        return sorted(map(tuple, graph.assemble(rows, edges, parts, k, threshold).collect()))
    own, between = rows.join(parts, "kmer").toPandas(), edges.toPandas()
    out = []
    for c, group in own.groupby("component"):
        links = between[between["src"].isin(set(group["kmer"]))]
        out += [(c, *x) for x in graph.assembled(group, links, threshold) if len(x[0]) > k + 3]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_contracted_chains_give_the_walk_of_all_kmers(spark, seed):
    rng = np.random.default_rng(seed)
    letters = lambda n: "".join(rng.choice(list("ACGT"), n))
    k, trunk = 10, letters(400)
    texts = [trunk, trunk[:100] + letters(60), letters(40) + trunk[200:240] + letters(50), trunk[300:330] + letters(2), letters(90)]
    circle = letters(60)
    texts += [circle + circle[: k - 1], trunk[350:] + trunk[:20], letters(25) + trunk[150:170]]
    kmers = sorted({t[i : i + k] for t in texts for i in range(len(t) - k + 1)})
    nodes = [(x, [float(v) for v in rng.integers(40, 99, 2)]) for x in kmers]
    got = walked(spark, nodes, 1, 4, 60.0, False)
    assert got == walked(spark, nodes, 1, 4, 60.0, True)
    assert max(len(r[1]) for r in got) > 60


def test_a_long_chain_is_put_together_in_blocks(spark):
    rng = np.random.default_rng(5)
    text, k = "".join(rng.choice(list("ACGT"), 20_000)), 17
    nodes = [(text[i : i + k], [float(i % 97)]) for i in range(len(text) - k + 1)]
    rows = spark.createDataFrame(nodes, "kmer string, scores array<double>")
    edges = graph.overlap_edges(rows, k)
    parts = graph.components(edges)
    few, links = graph.contracted(rows, edges, parts)
    assert few.count() == 7 and links.count() == 6
    got = graph.assemble(rows, edges, parts, k, 50.0).collect()
    assert [(r["sequence"], r["best_kmer"], r["best_score"], r["n_nodes"]) for r in got] == [(text, text[96 : 96 + k], 96.0, len(nodes))]


def brute_seeds(nodes, part, threshold):
    seen, out = set(), []
    for c in range(len(nodes[0][1])):
        for i, (kmer, scores) in enumerate(sorted(nodes, key=lambda x: (-x[1][c], x[0]))):
            if kmer in part and part[kmer] not in seen:
                if i > 10 and scores[c] < threshold:
                    break
                seen.add(part[kmer])
                out.append((part[kmer], kmer, c, scores[c]))
    return sorted(out)


@pytest.mark.parametrize("threshold", [40.0, 70.0, 97.0])
def test_seeds_against_the_greedy_loop(spark, threshold):
    rng = np.random.default_rng(6)
    kmers = sorted({"".join(rng.choice(list("ACGT"), 6)) for _ in range(400)})
    nodes = [(x, [float(v) for v in rng.integers(0, 99, 3)]) for x in kmers]
    rows = spark.createDataFrame(nodes, "kmer string, scores array<double>")
    parts = graph.components(graph.overlap_edges(rows, 6))
    want = brute_seeds(nodes, {r["kmer"]: r["component"] for r in parts.collect()}, threshold)
    assert sorted(map(tuple, graph.seeds(rows, parts, threshold).collect())) == want


def brute_graph(kmers, reach, most):
    edges, k = [], len(kmers[0])
    for a in kmers:
        for shift in range(1, reach + 1):
            partners = [b for b in kmers if b.startswith(a[shift:])]
            if partners:
                if len(partners) < most:
                    edges += [(a, b, shift) for b in partners if b != a]
                break
    root = {x: x for e in edges for x in e[:2]}
    for _ in kmers:
        for a, b, _s in edges:
            root[a] = root[b] = min(root[a], root[b])
    return edges, root


def test_the_whole_graph_against_brute_force(spark):
    rng = np.random.default_rng(8)
    kmers = sorted({"".join(rng.choice(list("ACGT"), 5)) for _ in range(160)})
    nodes = nodes_of(spark, kmers)
    edges = graph.overlap_edges(nodes, 5, reach=2)
    want, root = brute_graph(kmers, 2, 4)
    assert sorted(tuple(r) for r in edges.select("src", "dst", "shift").collect()) == sorted(want)
    parts = graph.components(edges)
    assert {r["kmer"]: r["component"] for r in parts.collect()} == root
    types = {r["component"]: (r["n_nodes"], r["graph_type"]) for r in graph.component_types(parts, edges).collect()}
    for c in set(root.values()):
        own = {x for x, r in root.items() if r == c}
        out = {x: sum(a == x for a, _, _s in want) for x in own}
        into = {x: sum(b == x for _, b, _s in want) for x in own}
        kind = "complex" if max([*out.values(), *into.values()]) > 1 else "linear"
        assert types[c] == (len(own), kind + "_circular" * (min(into.values()) > 0))
    best = {r["component"]: (r["best_kmer"], r["best_score"]) for r in graph.best_per_component(parts, nodes).collect()}
    score = {r["kmer"]: r["score"] for r in nodes.collect()}
    assert best == {c: max(((x, score[x]) for x, r in root.items() if r == c), key=lambda x: (x[1], x[0])) for c in set(root.values())}


def test_branches_by_mean_difference():
    values = {k: np.array(v, float) for k, v in {"a": [50, 60], "b": [51, 62], "c": [40, 90], "d": [50, 70]}.items()}
    assert graph.closest(values, "a", ["b", "c"]) == "b"
    assert graph.closest(values, "a", ["b", "d"]) is None and graph.closest(values, "a", ["c", "d"]) is None


def test_running_values_across_ranges(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = {(r["g"], r["i"]): r["n"] for r in running.numbered(df, ["g"], [F.col("x"), F.col("i")], "n").collect()}
    for g in "ab":
        order = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[g, i] for _, i in order] == list(range(1, len(order) + 1))


def test_statistics_of_two_groups(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([5.0],), ([1.0, 4.0],), ([],), ([4.0, 1.0, 2.0, 3.0, 5.0, 6.0],)], "x array<double>")
    got = [r[0] for r in df.select(stats.quartiles(F.col("x"))).collect()]
    assert got == [[2.0, 3.0, 3.0], [5.0] * 3, [1.0, 2.5, 4.0], [0.0] * 3, [3.0, 4.0, 6.0]]
    two = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (8.0, 2.0)], "a double, b double")
    assert [r[0] for r in two.select(stats.max_fold(F.col("a"), F.col("b"))).collect()] == [0.0, float("inf"), 4.0]


def test_nearest_node_of_a_map_in_chunks(spark):
    rng = np.random.default_rng(4)
    w, v = rng.integers(0, 4, (23, 3)).astype(float), rng.integers(0, 4, (40, 3)).astype(float)
    nodes = spark.createDataFrame([(i + 5, x.tolist()) for i, x in enumerate(w)], "node int, weights array<double>")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    away = np.sqrt(((v[:, None] - w[None]) ** 2).sum(2)).round(9)
    want = {i: (int(d.argmin()) + 5, float(d.min())) for i, d in enumerate(away)}
    for chunk in (4, 100):
        assert {r["vec_id"]: (r["node"], r["distance"]) for r in similarity.nearest_node(nodes, vectors, chunk).collect()} == want
    assert similarity.nearest_node(nodes.limit(0), vectors).where("node IS NULL").count() == 40


def test_similarity_of_columns_against_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"k{k}", f"s{s}", 0.1 * (k % 7), int(rng.integers(1, 6))) for k in range(60) for s in range(5) if rng.random() < 0.5]
    want = {}
    for k, s1, share, b1 in rows:
        for k2, s2, _, b2 in rows:
            if k == k2 and s1 < s2 and abs(b1 - b2) <= 1:
                want[s1, s2] = want.get((s1, s2), 0) + (2 if b1 == b2 else 1) * (1 - share)
    binned = spark.createDataFrame(rows, "kmer string, sample string, share double, bin long").repartition(3)
    got = {(r["s1"], r["s2"]): r["similarity"] for r in similarity.sample_similarity(binned, block=7).collect()}
    assert got == pytest.approx(want)
    matrix = {r["sample"]: r["values"] for r in similarity.square_matrix(similarity.sample_similarity(binned), [f"s{i}" for i in range(5)]).collect()}
    assert all(matrix[f"s{i}"][i] == 0 and matrix[f"s{i}"][j] == pytest.approx(want[f"s{min(i, j)}", f"s{max(i, j)}"]) for i in range(5) for j in range(5) if i != j)


@pytest.mark.parametrize("closed", [False, True])
def test_intervals_of_very_different_lengths(spark, closed):
    rng = np.random.default_rng(9)
    make = lambda n: [("c", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 200_000, n), rng.choice([0, 1, 5, 20, 300, 9_000, 150_000], n, p=[0.05, 0.2, 0.3, 0.3, 0.1, 0.03, 0.02])))]
    a, b = make(250), make(250)
    meets = (lambda x, y: x[1] <= y[2] and y[1] <= x[2]) if closed else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    kind = "chrom string, start long, end long, {} long"
    frames = [spark.createDataFrame(rows, kind.format(i)) for rows, i in ((a, "a_id"), (b, "b_id"))]
    assert len(intervals._levels(*frames)) > 1
    got = sorted((r["a_id"], r["b_id"]) for r in intervals.overlap_join(*frames, closed=closed).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if meets(x, y))


def test_a_gene_of_any_size_and_kmers_without_one(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(4, 12))
    rows = [(f"k{i:02d}", [None, "g", "h"][i % 3], float(rng.integers(0, 9)), (base[rng.integers(0, 4)] * rng.choice([-1, 1]) + 0.2 * rng.normal(size=12)).tolist()) for i in range(45)]
    want = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[1] == y[1] and np.corrcoef(x[3], y[3])[0, 1] > 0.8:
                want.add(y[0] if x[2] > y[2] else x[0])
    counts = spark.createDataFrame(rows, "kmer string, gene string, score double, x array<double>")
    assert {r["kmer"] for r in graph.correlated_losers(counts, 0.8).collect()} == want and want


def test_positions_on_either_strand(spark):
    kmers = spark.createDataFrame([("q", "CGT"), ("q", "TTT")], "name string, kmer string")
    block = "array<struct<start:bigint,end:bigint>>"
    rows = [("q", "1", "+", "AACGTA", [(0, 3), (3, 6)], [(10, 13), (50, 53)]), ("q", "2", "-", "AACGTA", [(0, 6)], [(70, 76)])]
    al = spark.createDataFrame(rows, f"name string, chrom string, strand string, seq string, q_blocks {block}, t_blocks {block}")
    got = {(r["kmer"], r["chrom"]): [tuple(b) for b in r["blocks"]] for r in annotation.kmer_positions(kmers, al, 3).collect()}
    assert got == {("CGT", "1"): [(12, 13), (50, 52)], ("CGT", "2"): [(71, 74)]}


def test_folds_are_balanced(spark):
    df = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    rows = models.balanced_folds(df, "label", "key", 0.25, 3).groupBy("fold", "label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in rows if r["fold"] == 2 and r["part"] != "unused"} == {
        (0, "train"): 7, (0, "test"): 2, (1, "train"): 7, (1, "test"): 2
    }


def test_a_long_comment_above_a_matrix(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("".join(f"# {i}\n" for i in range(20)) + "\ts1\ts2\ngroup\ta\tb\nAC\t1\t2\n")
    assert [tuple(r) for r in files.matrix_header(spark, str(path)).collect()] == [(0, "s1", "a"), (1, "s2", "b")]


def test_sinks_can_be_read_again(spark, tmp_path):
    header = spark.createDataFrame([(0, "s1", "a", "f1", 7, 31, 1e6), (1, "s2", "b", "f2", 9, 31, 1e6)], "ordinal int, sample string, grp string, count_file string, total_count long, k_len long, rescale_factor double")
    files.write_header_json(header, str(tmp_path / "h.json"))
    assert sorted((r["ordinal"], r["sample"], r["total_count"]) for r in files.header_json(spark, str(tmp_path / "h.json")).collect()) == [(0, "s1", 7), (1, "s2", 9)]
    scored = spark.createDataFrame([("AC", [70.12345, 50.0])], "kmer string, acc array<double>")
    files.write_reduced(scored, ["a_x_b", "a_x_c"], {"rescale": 1}, str(tmp_path / "r"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(lines) == sorted(['#{"kept": 1, "rescale": 1}', "kmer\ta_x_b\ta_x_c", "AC\t70.123\t50.000"])


def test_weaker_branch_goes():
    succ = {"a": ["b", "c"], "b": ["d", "e"], "c": ["f", "g"], "d": [], "e": []}
    pred = {"b": ["a"], "c": ["a"], "d": ["b"], "e": ["b"], "f": ["c"], "g": ["c"]}
    graph.trimmed(succ, pred, dict(a=1, b=9, c=2, d=1, e=1, f=1, g=1))
    assert succ["a"] == ["b"]


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_against_brute_force(spark, closed):
    rng = np.random.default_rng(5)
    make = lambda n, name: [("c%d" % (i % 2), int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 9000, n), rng.integers(0, 2500, n)))]
    a, b = make(60, "a"), make(70, "b")
    kind = "chrom string, start long, end long, {} long"
    got = intervals.overlap_join(spark.createDataFrame(a, kind.format("a_id")), spark.createDataFrame(b, kind.format("b_id")), closed=closed)
    meets = (lambda x, y: x[1] <= y[2] and y[1] <= x[2]) if closed else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and meets(x, y))
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == want


def test_union_of_intervals(spark):
    rows = [("c", 1, 3), ("c", 3, 5), ("c", 7, 9), ("c", 2, 4), ("d", 1, 2)]
    got = intervals.merged(spark.createDataFrame(rows, "chrom string, start long, end long"), ["chrom"]).collect()
    assert sorted((r["chrom"], r["start"], r["end"]) for r in got) == [("c", 1, 5), ("c", 7, 9), ("d", 1, 2)]


def test_split_sizes():
    assert reduce.split_sizes(5, 0.25) == (4, 1)
    assert reduce.split_sizes(6, 0.25) == (4, 2)
    assert reduce.split_sizes(12, 0.25) == (9, 3)


def test_accuracy_tells_groups_apart():
    rng = np.random.default_rng(0)
    groups = np.array(["a"] * 10 + ["b"] * 10)
    apart = np.concatenate([rng.normal(0, 1, 10), rng.normal(50, 1, 10)])
    same = rng.normal(0, 1, 20)
    acc = reduce.pairwise_accuracy(np.stack([apart, same]), groups)[:, 0]
    assert acc[0] == 100 and acc[1] < 80


def test_entropy_gate_moves_after_thirty_rows():
    gate = reduce.EntropyGate()
    for _ in range(29):
        gate.kept(2.0)
    assert gate.threshold == 0
    gate.kept(2.0)
    assert gate.threshold == 1.0 and gate.every == 60


def test_browse_filters_and_pages(spark):
    rows = spark.createDataFrame([(f"k{i:02}", [float(i), 50.0], ["gene" if i % 2 else "intron"]) for i in range(20)], "kmer string, values array<double>, events array<string>")
    request = browse.Request(events=["gene"], least_score=60, order="values_0", ascending=False, page_size=3)
    assert browse.filtered(rows, request).count() == 0
    request.least_score = 11
    assert [r["kmer"] for r in browse.page(rows, request).collect()] == ["k19", "k17", "k15"]
    assert tuple(browse.page_totals(rows, request).first()) == (20, 10)


def test_folds_without_a_number_come_last(spark):
    rows = spark.createDataFrame([("a", [1.5]), ("b", [float("inf")]), ("c", [-4.0]), ("d", [float("nan")]), ("e", None), ("f", [float("-inf")])], "kmer string, fold array<double>")
    for up, first in ((True, ["c", "a"]), (False, ["a", "c"])):
        got = [r["kmer"] for r in browse.ordered(rows, browse.Request(order="fold_0", ascending=up)).collect()]
        assert got == [*first, "b", "d", "e", "f"]


def test_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("AAAA\t3\nAAAC 5\n")
    (tmp_path / "create.tsv").write_text(f"{tmp_path}/c.tsv\ts1\tg1\n")
    assert {tuple(r) for r in files.create_matrix(spark, str(tmp_path / "create.tsv")).collect()} == {("s1", "g1", "AAAA", 3), ("s1", "g1", "AAAC", 5)}
    (tmp_path / "m.tsv").write_text("\ts1\ts2\ngroup\ta\tb\nAAAA\t1\tx\nAAAC\t2.5\t3\n")
    assert {r[0]: r[1] for r in files.text_matrix(spark, str(tmp_path / "m.tsv")).collect()} == {"AAAA": [1.0, 0.0], "AAAC": [2.5, 3.0]}
    assert [tuple(r) for r in files.matrix_header(spark, str(tmp_path / "m.tsv")).collect()] == [(0, "s1", "a"), (1, "s2", "b")]
    (tmp_path / "r.fa").write_text(">x\nACG\nTT\n>y\nGG\n")
    assert [r["seq"] for r in files.reads(spark, str(tmp_path / "r.fa")).collect()] == ["ACGTT", "GG"]


def test_sam_blocks(spark, tmp_path):
    line = lambda n, cigar: f"{n}\t0\tchr1\t11\t60\t{cigar}\t*\t0\t0\tACGT\t*"
    (tmp_path / "x.sam").write_text("@HD\n" + "\n".join([line("a", "5M2D3M"), line("b", "4M1I4M"), line("c", "3S5M"), line("d", "4M100N4M")]) + "\n")
    got = {r["name"]: [(b["start"], b["end"]) for b in r["t_blocks"]] for r in files.sam(spark, str(tmp_path / "x.sam")).collect()}
    assert got == {"a": [(10, 15), (17, 20)], "b": [(10, 14), (14, 18)], "c": [(10, 15)], "d": [(10, 14), (114, 118)]}


def test_gtf(spark, tmp_path):
    (tmp_path / "x.gtf").write_text('#c\nchr1\th\texon\t11\t20\t.\t+\t.\tgene_id "g1"; gene_name "N"; transcript_id "t1"; exon_id "e1";\n')
    r = files.gtf(spark, str(tmp_path / "x.gtf")).first()
    assert (r["start"], r["end"], r["gene_id"], r["exon_id"]) == (10, 20, "g1", "e1")


def test_samples_arrive_one_by_one(spark, tmp_path):
    for name in ("s1", "s2"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "c.tsv").write_text("AAAA\t3\n")
        ingest_counts(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t")).groupBy("sample").count().collect()
    assert {tuple(r) for r in got} == {("s1", 1), ("s2", 1)}


def test_accuracy_measures(spark):
    rows = spark.createDataFrame([(0.0, 0.0)] * 3 + [(0.0, 1.0)] + [(1.0, 1.0)] * 2, "label double, prediction double")
    r = models.accuracy(rows).first()
    assert round(r["accuracy"], 4) == 83.3333 and r["balanced_accuracy"] == 87.5
    assert models.confusion(rows).count() == 3
