"""Sources and sinks against plain readers."""

import gzip
import json
import re
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cohortloom.sources import files


def lines_of(path):
    return [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


def test_parts_in_global_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    kmers = sorted({"".join(rng.choice(list("ACGT"), 7)) for _ in range(400)})
    rows = spark.createDataFrame([(k, [float(i), i / 2]) for i, k in enumerate(kmers)], "kmer string, counts array<double>").repartition(7)
    out = str(tmp_path / "m")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several parts even for a few rows
    try:
        files.write_matrix(rows, [("s1", "a"), ("s2", "b")], out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list(Path(out).glob("part-*"))) > 1
    assert lines_of(out) == ["\ts1\ts2", "group\ta\tb"] + [f"{k}\t{float(i)}\t{i / 2}" for i, k in enumerate(kmers)]
    assert [tuple(r) for r in files.matrix_header(spark, out).collect()] == [(0, "s1", "a"), (1, "s2", "b")]
    assert {r[0]: r[1] for r in files.text_matrix(spark, out).collect()} == {k: [float(i), i / 2] for i, k in enumerate(kmers)}
    assert [r["value"] for r in files.read_in_order(spark, out).orderBy("line").collect()] == lines_of(out)


def test_export_in_the_order_shown(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 2, [0.5, None]), ("k2", None, [1.5, 2.0]), ("k3", 9, None), ("k4", 2, [7.0, 8.0])], "kmer string, n long, v array<double>").repartition(3)
    out = str(tmp_path / "e")
    files.export_rows(rows, [(F.col("n"), False), (F.col("kmer"), True)], ["kmer", "v", "n"], out)
    assert lines_of(out) == ["kmer\tv_0\tv_1\tn", "k3\t\t\t9", "k1\t0.5\t\t2", "k4\t7.0\t8.0\t2", "k2\t1.5\t2.0\t"]


def test_reports_with_all_their_files(spark, tmp_path):
    scored = spark.createDataFrame([("CA", [51.0, 70.25], 0.5, 0.25), ("AC", [66.6666, 1.0], 1.0, 0.0)], "kmer string, acc array<double>, entropy double, entropy_threshold double")
    out = str(tmp_path / "r")
    files.write_reduced(scored, ["a_x_b", "a_x_c"], {"k": 2}, out, entropy=True)
    assert lines_of(out) == ['#{"k": 2, "kept": 2}', "kmer\ta_x_b\ta_x_c\tentropy\tentropy_threshold", "AC\t66.667\t1.000\t1.000\t0.000", "CA\t51.000\t70.250\t0.500\t0.250"]
    assert files.matrix_info(spark, out) == json.loads(lines_of(out + ".json")[0]) == {"k": 2, "kept": 2}
    assert {r[0]: r[1] for r in files.text_matrix(spark, out).where("kmer <> 'kmer'").collect()}["CA"] == [51.0, 70.25, 0.5, 0.25]
    sequences = spark.createDataFrame([("seq_0", "ACGT", [1.0])], "name string, sequence string, scores array<double>")
    aligned = spark.createDataFrame([("c1", "seq_0", "+", [(5, 9)])], "chrom string, name string, strand string, t_blocks array<struct<start: long, end: long>>")
    best = spark.createDataFrame([("ACG", [1.0, 2.0])], "kmer string, counts array<double>")
    out = str(tmp_path / "a")
    files.write_aggregated(sequences, aligned, out, best, [("s1", "a"), ("s2", "b")], {"threshold": 60})
    assert lines_of(out + ".sequences.bed") == ["c1\t5\t9\tseq_0\t0\t+"]
    assert lines_of(out + ".kmers.matrix")[2:] == ["ACG\t1.0\t2.0"]
    assert json.loads(lines_of(out + ".info.json")[0]) == {"threshold": 60, "final_kmers": 1}
    assert lines_of(out + ".tsv") == ["name\tsequence", "seq_0\tACGT"]


def test_count_files_of_equal_name_and_a_manifest(spark, tmp_path):
    for d, n in (("x", 3), ("y", 5)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "c.tsv").write_text(f"AAAA\t{n}\n")
    table = tmp_path / "create.tsv"
    table.write_text(f"{tmp_path}/x/c.tsv\ts1\tg1\n{tmp_path}/y/c.tsv\ts2\tg1\n{tmp_path}/y/c.tsv\ts3\tg2\n")
    got = sorted(map(tuple, files.create_matrix(spark, str(table)).collect()))
    assert got == [("s1", "g1", "AAAA", 3), ("s2", "g1", "AAAA", 5), ("s3", "g2", "AAAA", 5)]
    (tmp_path / "manifest.tsv").write_text("#name\tgroup\tfiles\ns1\tg1\ta.fq;b.fq\ns2\tg2\tc.fq\n")
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "manifest.tsv")).collect())) == [("s1", "g1", "a.fq"), ("s1", "g1", "b.fq"), ("s2", "g2", "c.fq")]


def test_reads_across_splits(spark, tmp_path):
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("ACGT"), n))
    seqs = [letters(int(n)) for n in rng.integers(1, 60, 300)]
    # Quality lines that look like the start of a record.
    fq = "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))
    fa = "".join(f">r{i} >x\n" + "\n".join(s[j : j + 17] for j in range(0, len(s), 17)) + "\n" for i, s in enumerate(seqs))
    (tmp_path / "a.fastq").write_text(fq)
    (tmp_path / "b.fa").write_text(fa)
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(fq)
    (tmp_path / "d").write_text(fa)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.reads(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        got = {}
        for r in rows.collect():
            got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["seq"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(seqs) for k in ("a.fastq", "b.fa", "c.fq.gz", "d")}


def brute_sam(pos, cigar, md, seq):
    """A walk letter by letter."""
    tokens = re.findall(r"\d+|\^[A-Z]+|[A-Z]", md)
    letters = []  # per letter of M and D: None, or what MD says
    for t in tokens:
        if t.isdigit():
            letters += [None] * int(t)
        else:
            letters += [t] if t[0] != "^" else [t] + [""] * (len(t) - 2)
    t, q, m, out = pos, 0, 0, []
    for n, op in re.findall(r"(\d+)([MIDNS])", cigar):
        n = int(n)
        if op == "M":
            out += [("mutation", t + i, t + i + 1, q + i, q + i + 1, f"{letters[m + i]}>{seq[q + i]}") for i in range(n) if letters[m + i]]
        elif op in "IS":
            out.append(("insertion" if op == "I" else "clipping", t, t + 1, q, q + n, seq[q : q + n]))
        elif op == "D":
            out.append(("deletion", t, t + n, q, q + 1, letters[m]))
        t, q, m = t + n * (op in "MDN"), q + n * (op in "MIS"), m + n * (op in "MD")
    return out


def test_cigar_and_md_walked_as_one(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("ACGT"), n))
    lines, want = ["@HD\tVN:1.0"], {}
    for i in range(60):
        ops = [("S", 3)] if rng.random() < 0.5 else []
        for _ in range(rng.integers(1, 5)):
            ops += [("M", int(rng.integers(3, 12))), (str(rng.choice(list("IDN"))), int(rng.integers(1, 4)))]
        ops += [("M", int(rng.integers(3, 12)))] + ([("S", 2)] if rng.random() < 0.5 else [])
        md, run = "", 0
        for op, n in ops:
            if op == "M":
                for _ in range(n):
                    if rng.random() < 0.2:
                        md, run = md + f"{run}{letters(1)}", 0
                    else:
                        run += 1
            elif op == "D":
                md, run = md + f"{run}^{letters(n)}", 0
        md += str(run)
        cigar, seq = "".join(f"{n}{op}" for op, n in ops), letters(sum(n for op, n in ops if op in "MIS"))
        lines.append(f"seq_{i}\t{16 * (i % 2)}\tc1\t{100 + i}\t60\t{cigar}\t*\t0\t0\t{seq}\t*\tNM:i:1\tMD:Z:{md}")
        want[f"seq_{i}"] = brute_sam(99 + i, cigar, md, seq)
    lines.append("seq_99\t0\tc1\t5\t60\t4M2D3M\t*\t0\t0\tACGTACG\t*")
    want["seq_99"] = [("deletion", 8, 10, 4, 5, "")]
    got = files.sam_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r["name"]: [tuple(s) for s in r["signatures"]] for r in got} == want
    last = next(r for r in got if r["name"] == "seq_99")
    assert ([tuple(b) for b in last["t_blocks"]], [tuple(b) for b in last["q_blocks"]]) == ([(4, 8), (10, 13)], [(0, 4), (4, 7)])


def test_long_alignments_walked_once(spark):
    """Some thousand operations and changed letters, which took time with the square of their number."""
    rng, lines, want = np.random.default_rng(8), [], []
    for i in range(30):
        n = int(rng.integers(2000, 2500))
        cigar = "".join(f"{k}M1{op}" for k, op in zip(rng.integers(2, 9, n), rng.choice(list("IN"), n))) + "5M"
        letters = sum(int(x) for x, op in re.findall(r"(\d+)(.)", cigar) if op in "MI")
        seq, matched = "".join(rng.choice(list("ACGT"), letters)), sum(int(x) for x in re.findall(r"(\d+)M", cigar))
        md = "2A" * (matched // 3) + str(matched % 3)
        lines.append((f"r{i}\t0\tc1\t{100 + i}\t60\t{cigar}\t*\t0\t0\t{seq}\t*\tMD:Z:{md}",))
        want += [(f"r{i}", "c1", *x) for x in brute_sam(99 + i, cigar, md, seq)]
    frame = spark.createDataFrame(lines, "value string").repartition(1)
    files.sam_lines(frame.limit(1)).count()
    began = time.perf_counter()
    got = files.sam_lines(frame).select("name", "chrom", F.explode("signatures").alias("x")).select("name", "chrom", "x.*").collect()
    assert time.perf_counter() - began < 20
    assert sorted(map(tuple, got)) == sorted(want)


def test_signatures_row_by_row(spark):
    """Letters beyond ASCII, a sequence that is not there, no MD, odd MD; the same as in the nested form."""
    cells = [("3S5M1I2M", "ACGTÄßGTACG", "\tMD:Z:2T4"), ("4M2D3M", "ACGTACG", ""), ("4M2D3M", "ACGTACG", "\tMD:Z:4^GG1C1"), ("2I4M", "*", "\tMD:Z:0A3"),
             ("*", "*", "\tMD:Z:7"), ("3M1P2M2H", "ACGTA", "\tMD:Z:0C0G3"), ("3M2D2M", "ACGTA", "\tMD:Z:3^AC0T1"), ("5=1X3M", "ACGTACGTA", "\tMD:Z:5G3")]
    lines = [(f"s{i}\t{16 * (i % 2)}\tc{i % 3}\t{i}\t60\t{c}\t*\t0\t0\t{seq}\t*{md}",) for i, (c, seq, md) in enumerate(cells)] + [("s99\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*",)]
    frame = spark.createDataFrame(lines, "value string")
    nested = files.sam_lines(frame).select("name", "chrom", F.explode("signatures").alias("x")).select("name", "chrom", "x.*").collect()
    got = sorted(map(tuple, files.sam_signatures(frame).collect()))
    assert got == sorted(map(tuple, nested))
    assert ("s0", "c0", "insertion", 4, 5, 8, 9, "A") in got and ("s0", "c0", "mutation", 1, 2, 5, 6, "T>ß") in got
    assert ("s2", "c2", "deletion", 5, 7, 4, 5, "^GG") in got and ("s3", "c0", "insertion", 2, 3, 0, 2, "*") in got and ("s3", "c0", "mutation", 2, 3, 2, 3, "A>") in got
    assert ("s6", "c0", "deletion", 8, 10, 3, 4, "^AC") in got and ("s6", "c0", "mutation", 10, 11, 3, 4, "T>T") in got
    assert files.sam_lines(frame).count() == 8


def test_pslx_runs_and_gaps(spark):
    psl = "\t".join(["18", *["0"] * 7, "-", "seq_4", "20", "0", "20", "c2", "900", "100", "150", "4", "5,5,5,3,", "0,5,10,17,", "100,108,140,145,", "ACGTA,ccccc,GGGGG,AAA,", "ATTTA,CCCCC,GGTGT,AAA,"])
    row = files.pslx_lines(spark.createDataFrame([("match\tmis",), (psl,)], "value string")).first()
    assert [tuple(s) for s in row["signatures"]] == [
        ("mutation", 101, 103, 1, 3, "TT>CG"), ("mutation", 142, 143, 12, 13, "T>G"), ("mutation", 144, 145, 14, 15, "T>G"),
        ("deletion", 105, 108, 5, 5, "^3nt"), ("insertion", 145, 145, 15, 17, "+2nt"),
    ]
    hits = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("a", 7, "z"), ("b", 1, "w")], "name string, match long, chrom string")
    assert sorted(r["chrom"] for r in files.best_hits(hits).collect()) == ["w", "y", "z"]
