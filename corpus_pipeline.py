"""A corpus from raw documents: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import discard, free_name, has_rows, read, save, tokenizer_file
from cohortloom.llm.jaccard import near_duplicates
from cohortloom.llm.packing import pack
from cohortloom.llm.queries import surrogate_key
from cohortloom.llm.suffix_dedup import COUNTS, PASSAGE_WORDS, remove_repeats
from cohortloom.llm.surrogates import replace_entities
from cohortloom.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores below 0.7. Null and empty texts stay."""
    stems, weights = train(docs, read(spark, sf_dir, "labels"))
    mark = free_name(docs, "score")
    return score(docs, stems, weights, mark).where(F.col(mark) < 0.7).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of linked ones; repeated rows once. Rows are told
    apart by id and text: those of the same id, and those without one, which come after all
    others, are rows of their own. Null and empty texts are linked with nothing and stay."""
    row = free_name(docs, "row")
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.col("text").isNull())
    named = docs.withColumn(row, key)
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text")).where("doc_id = component_id")
    leaders = save(found.groupBy(F.col("doc_id").alias(row)).count(), "leaders")
    kept = named.join(leaders, row, "left_semi")
    if has_rows(leaders.where("count > 1")):  # only then are the texts dealt out once more
        kept = kept.dropDuplicates([row])
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, of 400 bytes or of over 50 words; a character cut
    in two goes with them. Null texts stay null, and n_chars follows the text."""
    out = tuple(free_name(docs, c) for c in COUNTS)
    done = remove_repeats(docs, as_text=True, out=out, words=PASSAGE_WORDS)
    text = F.when(F.col(out[2]) == 0, F.col("text")).otherwise(F.col(out[0]))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def hide_entities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with keyed surrogates in place of personal data; null texts stay null, and
    n_chars follows the text."""
    done = replace_entities(docs, surrogate_key(spark), out_col=free_name(docs, "entities"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a null text is the end id alone."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", one_of_near_copies),
    ("suffixes", cut_repeats),
    ("surrogates", hide_entities),
    ("packing", packed),
]

#: Models, components and packings are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # nothing reads it any more
        docs = before = made
    return docs
