"""The queries of this subpackage: one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_corpus
from .bm25 import top_k
from .byte_bpe import encode_decode
from .common import read, tokenizer_file
from .debruijn import remove_repeated_words
from .hidden_markov import score_texts
from .jaccard import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs, planted, run_report
from .quality_rules import host_quality
from .sharding import shard_documents, text_hub
from .suffix_dedup import PASSAGE_WORDS, PASSAGES, remove_repeats
from .surrogates import replace_entities
from .toxicity import toxicity


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), text_hub())


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 100 = 0"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return done.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs, words=PASSAGE_WORDS, cut_words=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *PASSAGES)


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op7_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Where a deployment puts its secret key; the key for tests serves where it is unset.
KEY_SETTING, TEST_KEY = "spark.cohortloom.surrogateKey", "a key for tests"


def surrogate_key(spark: SparkSession) -> bytes:
    return (spark.conf.get(KEY_SETTING, None) or TEST_KEY).encode()


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = replace_entities(docs, surrogate_key(spark))
    listed = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["start"].alias("start"), e["stop"].alias("stop"), e["surrogate"].alias("surrogate")))
    return done.select("doc_id", F.size("entities").alias("n_entities"), listed.alias("entities"), "text")


def op9_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op11_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return align_corpus(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_words(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
