"""Text files of the domain: manifests, counts, matrices, alignments, annotations."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import walk


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, grp, file): name, group and ``;``-separated files; ``#`` starts a comment."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="name string, grp string, files string")
    return rows.select("name", "grp", F.explode(F.split("files", ";")).alias("file"))


def count_file(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, raw_count) of ``kmer<white space>count`` lines; order is not relied on."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("kmer"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("raw_count"))


def _plain_path(path: str) -> str:
    """A path without scheme and host, as files of one store are told apart."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def create_matrix(spark: SparkSession, table: str) -> DataFrame:
    """(sample, grp, kmer, raw_count) of all files that a 3-column table names."""
    rows = spark.read.csv(table, sep="\t", schema="file string, name string, grp string, more string").collect()  # a header
    if any(r[3] is not None or r[2] is None for r in rows):
        raise ValueError("the table needs exactly three columns: file, name, group")
    names = spark.createDataFrame([(_plain_path(r[0]), r[1], r[2]) for r in rows], "_file string, sample string, grp string")
    parts = F.split(F.trim("value"), r"\s+")
    # A file may serve several samples, and is read once.
    lines = spark.read.text(sorted({r[0] for r in rows})).where("trim(value) <> ''").select(
        F.regexp_replace(F.url_decode("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").alias("_file"),
        parts[0].alias("kmer"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("raw_count"),
    )
    return lines.join(F.broadcast(names), "_file").select("sample", "grp", "kmer", "raw_count")  # a row a sample


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, counts) of a tab-separated matrix; cells that aren't numbers count as 0.

    Lines that start with ``#``, a tab or the word group are its header.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|\t|group\t)") & (F.col("value") != ""))
    cells = F.split("value", "\t")
    number = lambda c: F.nanvl(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return lines.select(cells[0].alias("kmer"), F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), number).alias("counts"))


def matrix_header(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, sample, grp) from the lines above a matrix, in whichever part they are; names
    col_i where it has none."""
    lines = spark.read.text(path)
    head = {k: lines.where(F.startswith("value", F.lit(k))).take(1) for k in ("\t", "group\t")}
    names = head["\t"][0][0].split("\t")[1:] if head["\t"] else []
    groups = head["group\t"][0][0].split("\t")[1:] if head["group\t"] else [""] * len(names)
    names = names or [f"col_{i}" for i in range(len(groups))]
    return spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(zip(names, groups))], "ordinal int, sample string, grp string")


def matrix_info(spark: SparkSession, path: str) -> dict:
    """The JSON object of a matrix's or report's ``#`` line; empty without one."""
    found = spark.read.text(path).where("startswith(value, '#{')").take(1)
    return json.loads(found[0][0][1:]) if found else {}


def write_lines(lines: DataFrame, order: list[tuple[Column, bool]], path: str, head: list[str] | None = None) -> None:
    """The column ``value`` of ``lines`` below the ``head`` lines, in order across all parts: parts
    are numbered by ranges of the order, so that read by name they are one sorted file.
    ``order`` has keys and whether they ascend; nulls come last."""
    spark = lines.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    body = lines.select(F.lit(1).alias("_top"), F.lit(0).alias("_line"), *[c.alias(k) for (c, _), k in zip(order, keys)], "value")
    rows = spark.createDataFrame(list(enumerate(head or [])), "_line int, value string").withColumn("_top", F.lit(0))
    by = [F.asc_nulls_last(k) if up else F.desc_nulls_last(k) for (_, up), k in zip(order, keys)]
    body.unionByName(rows, allowMissingColumns=True).orderBy("_top", "_line", *by).select("value").write.text(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a folder of text parts, numbered from 0 through all parts by name.

    Lines are numbered within a split of a file as Spark reads it, and splits follow from
    their sizes, a row each.
    """
    at = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), "value"
    )
    return _numbered(at, []).select("line", "value")


def _numbered(at: DataFrame, by: list[str]) -> DataFrame:
    """``line``: the number of each line (file, start of its split, i) from 0, through all splits
    in order, or those of each ``by``."""
    splits = at.groupBy("file", "start").agg(F.min("i").alias("_least"), F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return at.join(before, ["file", "start"]).withColumn("line", F.col("_before") + F.col("i") - F.col("_least"))


def export_rows(rows: DataFrame, order: list[tuple[Column, bool]], columns: list[str], path: str) -> None:
    """``rows`` as tab-separated lines below their names, in the order shown; arrays as
    columns of their own, named by place."""
    names, cells = [], []
    for c in columns:
        if isinstance(rows.schema[c].dataType, ArrayType):
            width = rows.select(F.max(F.size(c))).first()[0] or 0
            names += [f"{c}_{i}" for i in range(width)]
            cells += [F.get(c, F.lit(i)) for i in range(width)]
        else:
            names.append(c)
            cells.append(F.col(c))
    value = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    write_lines(rows.withColumn("value", value), order, path, ["\t".join(names)])


def write_matrix(rows: DataFrame, header: list[tuple[str, str]], path: str) -> None:
    """Rows (kmer, counts) below a line of names and a line of groups, by k-mer."""
    body = rows.select("kmer", F.concat_ws("\t", "kmer", F.transform("counts", lambda c: c.cast("string"))).alias("value"))
    top = ["\t".join(["", *(n for n, _ in header)]), "\t".join(["group", *(g for _, g in header)])]
    write_lines(body, [(F.col("kmer"), True)], path, top)


def header_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample from a matrix's JSON header; ``key_len`` is an old name of k_len."""
    raw = spark.read.json(path, multiLine=True)
    k = F.coalesce(*[F.col(c) for c in ("k_len", "key_len") if c in raw.columns])
    names = ["count_files", "groups", "names", "total_counts"]
    zipped = F.arrays_zip(*[n for n in names if n in raw.columns])
    rows = raw.select(k.alias("k_len"), "rescale_factor", F.posexplode(zipped).alias("ordinal", "s"))
    return rows.select("ordinal", F.col("s.names").alias("sample"), F.col("s.groups").alias("grp"), F.col("s.count_files").alias("count_file"), F.col("s.total_counts").alias("total_count"), "k_len", "rescale_factor")


def write_header_json(header: DataFrame, path: str) -> None:
    """``header_json``'s rows as one JSON object of arrays in sample order."""
    of = F.array_sort(F.collect_list(F.struct("ordinal", "sample", "grp", "count_file", "total_count")))
    one = header.groupBy("k_len", "rescale_factor").agg(of.alias("s"))
    columns = {"count_files": "count_file", "groups": "grp", "names": "sample", "total_counts": "total_count"}
    one.select("k_len", "rescale_factor", *[F.col("s")[c].alias(k) for k, c in columns.items()]).coalesce(1).write.json(path)


def write_reduced(scored: DataFrame, comparisons: list[str], info: dict, path: str, entropy: bool = False) -> None:
    """Accuracies (kmer, acc) with 3 decimals, by k-mer, below a line of JSON and a line of
    names; ``entropy`` adds those columns of ``reduce_adaptive``. The JSON, with the number of
    kept k-mers, also stands alone in ``path``.json."""
    spark = scored.sparkSession
    told = {**info, "kept": scored.count()}
    more = ["entropy", "entropy_threshold"] if entropy else []
    three = lambda v: F.format_string("%.3f", v)
    cells = [F.transform("acc", three), *[three(F.col(c)) for c in more]]
    body = scored.select("kmer", F.concat_ws("\t", "kmer", *cells).alias("value"))
    line = json.dumps(told, sort_keys=True)
    write_lines(body, [(F.col("kmer"), True)], path, ["#" + line, "\t".join(["kmer", *comparisons, *more])])
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path + ".json")


def write_aggregated(
    sequences: DataFrame, alignments: DataFrame, path: str, winners: DataFrame | None = None, header: list[tuple[str, str]] | None = None, info: dict | None = None
) -> None:
    """Assembled sequences as JSON and TSV, their alignments' blocks as ``.sequences.bed``,
    the ``winners``' counts (kmer, counts) as ``.kmers.matrix`` and what is known of the run as
    ``.info.json``, with the number of winners."""
    spark = sequences.sparkSession
    sequences.write.json(path + ".json")
    flat = [c for c, t in sequences.dtypes if not t.startswith(("array", "struct", "map"))]
    export_rows(sequences, [(F.col(flat[0]), True)], flat, path + ".tsv")
    bed(alignments).write.text(path + ".sequences.bed")
    told = dict(info or {})
    if winners is not None:
        write_matrix(winners, header or [], path + ".kmers.matrix")
        told["final_kmers"] = winners.count()
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.text(path + ".info.json")


def gtf(spark: SparkSession, path: str, feature: str = "exon") -> DataFrame:
    """Exons with their gene and transcript; half-open starts."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
    named = lambda key: F.nullif(F.regexp_extract("attributes", key + r' "([^"]*)"', 1), F.lit(""))
    return rows.where(F.col("feature") == feature).select(
        "chrom", (F.col("start") - 1).alias("start"), "end", "strand",
        *[named(k).alias(k) for k in ("gene_id", "gene_name", "transcript_id", "exon_id")],
    )


SIGNATURE = "array<struct<kind: string, t_start: bigint, t_end: bigint, q_start: bigint, q_end: bigint, info: string>>"


def _signature(kind: str | Column, t_start: Column, t_end: Column, q_start: Column, q_end: Column, info: Column) -> Column:
    named = zip(("t_start", "t_end", "q_start", "q_end"), (t_start, t_end, q_start, q_end))
    return F.struct(F.lit(kind).alias("kind"), *[c.cast("long").alias(n) for n, c in named], info.alias("info"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped alignments of SAM files, see ``sam_lines``."""
    return sam_lines(spark.read.text(path))


def sam_lines(lines: DataFrame) -> DataFrame:
    """Mapped alignments of lines (value) with their target and query blocks, half-open from
    0, and signatures: changed letters, insertions, deletions and clipped ends.

    CIGAR and MD are walked as one, see ``walk.walked``. Without MD there are no changed
    letters, and deletions have no letters.
    """
    block = "array<struct<start:bigint,end:bigint>>"
    schema = f"name string, chrom string, strand string, match bigint, t_blocks {block}, q_blocks {block}, seq string, cigar string, signatures {SIGNATURE}"
    return _sam_rows(lines).mapInArrow(walk.nested, schema)


def sam_signatures(lines: DataFrame) -> DataFrame:
    """(name, chrom, kind, t_start, t_end, q_start, q_end, info): a row for each signature of
    ``sam_lines``."""
    rows = _sam_rows(lines).select("name", "chrom", "pos", "cigar", "seq", "md")
    return rows.mapInArrow(walk.flat, "name string, chrom string, kind string, t_start bigint, t_end bigint, q_start bigint, q_end bigint, info string")


def _sam_rows(lines: DataFrame) -> DataFrame:
    cells = F.split("value", "\t")
    strand = F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")
    return lines.where("NOT startswith(value, '@')").select(
        cells[0].alias("name"), cells[1].cast("long").alias("flag"), cells[2].alias("chrom"),
        (cells[3].cast("long") - 1).alias("pos"), cells[4].cast("long").alias("match"), cells[5].alias("cigar"), cells[9].alias("seq"),
        F.regexp_extract("value", "\tMD:Z:([^\t]*)", 1).alias("md"),
    ).where(F.col("flag").bitwiseAND(4) == 0).select("name", "chrom", strand.alias("strand"), "match", "pos", "seq", "cigar", "md")


def pslx(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of PSLX files, see ``pslx_lines``."""
    return pslx_lines(spark.read.text(path))


def pslx_lines(lines: DataFrame) -> DataFrame:
    """Alignments of lines (value) with target and query blocks, half-open, and signatures: runs
    of changed letters, and gaps of at most 10 letters between blocks, in the target a
    deletion, in the query an insertion."""
    cells = F.split("value", "\t")
    numbers = lambda i: F.transform(F.filter(F.split(cells[i], ","), lambda x: x != ""), lambda x: x.cast("long"))
    letters = lambda i: F.split(F.upper(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))), ",")
    rows = lines.where(F.col("value").rlike(r"^\d+\t")).select(
        cells[0].cast("long").alias("match"), cells[8].alias("strand"), cells[9].alias("name"), cells[13].alias("chrom"),
        numbers(18).alias("sizes"), numbers(19).alias("q"), numbers(20).alias("t"), letters(21).alias("q_seq"), letters(22).alias("t_seq"),
    )
    blocks = lambda start: F.zip_with(start, "sizes", lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))
    rows = rows.select("name", "chrom", "strand", "match", blocks("t").alias("t_blocks"), blocks("q").alias("q_blocks"), "q_seq", "t_seq")

    def runs(i: Column) -> Column:
        """Runs of places where the i-th block's letters differ, as (first, length)."""
        mine, theirs = F.get("q_seq", i), F.get("t_seq", i)
        n = F.least(F.length(mine), F.length(theirs))
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        differ = F.filter(every, lambda j: F.substr(mine, j, F.lit(1)) != F.substr(theirs, j, F.lit(1)))
        opens = F.filter(differ, lambda j: ~F.array_contains(differ, j - 1))
        closes = F.filter(differ, lambda j: ~F.array_contains(differ, j + 1))
        return F.zip_with(opens, closes, lambda a, b: F.struct((a - 1).alias("at"), (b - a + 1).alias("n")))

    def changed(i: Column) -> Column:
        t, q = F.get("t_blocks", i)["start"], F.get("q_blocks", i)["start"]
        part = lambda c, r: F.substr(F.get(c, i), r["at"] + 1, r["n"])
        return F.transform(runs(i), lambda r: _signature(
            "mutation", t + r["at"], t + r["at"] + r["n"], q + r["at"], q + r["at"] + r["n"], F.concat(part("t_seq", r), F.lit(">"), part("q_seq", r))
        ))

    def gap(i: Column) -> Column:
        t, q = F.get("t_blocks", i - 1)["end"], F.get("q_blocks", i - 1)["end"]
        t_next, q_next = F.get("t_blocks", i)["start"], F.get("q_blocks", i)["start"]
        told = lambda mark, n: F.concat(F.lit(mark), n.cast("string"), F.lit("nt"))
        return (
            F.when((q == q_next) & (t_next - t <= 10), F.array(_signature("deletion", t, t_next, q, q_next, told("^", t_next - t))))
            .when((q != q_next) & (q_next - q <= 10), F.array(_signature("insertion", t, t_next, q, q_next, told("+", q_next - q))))
            .otherwise(F.array().cast(SIGNATURE))
        )

    count = F.size("t_blocks")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    between = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    found = F.concat(F.flatten(F.transform(places, changed)).cast(SIGNATURE), F.flatten(F.transform(between, gap)).cast(SIGNATURE))
    return rows.select("name", "chrom", "strand", "match", "t_blocks", "q_blocks", found.alias("signatures"))


def best_hits(alignments: DataFrame) -> DataFrame:
    """Of each query the alignments of greatest match; ties stay."""
    from pyspark.sql import Window

    top = F.max("match").over(Window.partitionBy("name"))
    return alignments.withColumn("_top", top).where("match = _top").drop("_top")


def bed(alignments: DataFrame) -> DataFrame:
    """One BED line a target block."""
    rows = alignments.select("chrom", "name", "strand", F.explode("t_blocks").alias("b"))
    return rows.select(F.concat_ws("\t", "chrom", F.col("b.start"), F.col("b.end"), "name", F.lit("0"), "strand").alias("value"))


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, seq) of FASTA files, whose records may wrap. A record is what stands between two
    lines that start with >, so files are split wherever Spark likes."""
    rows = spark.read.text(paths, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select("file", body.alias("seq")).where("seq <> ''")


def fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, seq) of FASTQ files, of four lines a record: the second of each four lines of a
    file. Lines are numbered within a file's splits and then across them, a row a split, so
    that files of any size are read in parallel; compressed ones are one split each."""
    at = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), "value"
    )
    return _numbered(at, ["file"]).where("line % 4 = 1").select("file", F.trim(F.col("value")).alias("seq")).where("seq <> ''")


def reads(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq) of FASTA and FASTQ files, told apart by their names, or where these say
    nothing by their first letter."""
    named = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a row a file
    kinds: dict[bool, list[str]] = {True: [], False: []}
    for file in named:
        known = re.search(r"\.(fa|fasta|fna|fq|fastq)(\.gz|\.bz2|\.zst)?$", file.lower())
        if known:
            first = known[1] in ("fa", "fasta", "fna")
        else:
            first = spark.read.text(file).where("value <> ''").limit(1).where("startswith(value, '>')").take(1) != []
        kinds[first].append(file)
    parts = [read(spark, files) for read, files in ((fasta, kinds[True]), (fastq, kinds[False])) if files]
    if not parts:
        return spark.createDataFrame([], "file string, seq string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
