"""Functions of sequences and k-mers, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"


def _pieces(seq: Column, k: int, take) -> Column:
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    return F.when(F.length(seq) >= k, F.transform(starts, take)).otherwise(F.array().cast("array<string>"))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order; none where it is shorter than k."""
    return _pieces(seq, k, lambda i: F.substring(seq, i, F.lit(k)))


def distinct_kmers(seq: Column, k: int) -> Column:
    return F.array_sort(F.array_distinct(kmers(seq, k)))


def is_dna(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ACGT]+$")


def reverse_complement(seq: Column) -> Column:
    """Null where a letter is none of A, C, G, T."""
    return F.when(seq.rlike("^[ACGT]*$"), F.reverse(F.translate(seq, "ACGT", "TGCA")))


def kmer_to_int(kmer: Column) -> Column:
    """The k-mer as a number to base 4 (k up to 31)."""
    digits = F.split(F.translate(kmer, LETTERS, "0123"), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 4 + F.coalesce(d.try_cast("long"), F.lit(0)))


def int_to_kmer(number: Column, k: int) -> Column:
    places = F.array(*[F.lit(4**i).cast("long") for i in range(k - 1, -1, -1)])
    letter = lambda p: F.substring(F.lit(LETTERS), (F.floor(number / p) % 4 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(places, letter), "")


def complexity(kmer: Column) -> Column:
    """Changes between neighbouring letters, over the length."""
    changes = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(kmer), F.lit(2))),
        lambda i: F.substring(kmer, i, F.lit(1)) != F.substring(kmer, i - 1, F.lit(1)),
    )
    return F.when(F.length(kmer) > 0, F.when(F.length(kmer) < 2, 0.0).otherwise(F.size(changes) / F.length(kmer)))


def overlap_shift(a: Column, b: Column, k: int) -> Column:
    """The smallest shift of at least 1 at which the end of a is the start of b, else 0."""
    hits = [F.when(F.substring(a, s + 1, k - s) == F.substring(b, 1, k - s), s) for s in range(1, k)]
    return F.coalesce(*hits, F.lit(0))


def dna_of_text(text: Column) -> Column:
    """Latin letters dealt to the four bases, everything else a break: a stand-in for reads."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    dealt = "".join(LETTERS[i % 4] for i in range(26))
    return F.regexp_replace(F.translate(F.lower(text), alphabet, dealt), "[^ACGT]+", "N")


def metadata_map(tags: Column) -> Column:
    """``key:value;key:value`` as a map; a bare value is the Group, no value is NA."""
    def entry(x: Column) -> Column:
        bare = F.instr(x, ":") == 0
        key = F.when(bare, "Group").otherwise(F.substring_index(x, ":", 1))
        value = F.when(bare, x).otherwise(F.regexp_replace(x, "^[^:]*:", ""))
        return F.struct(key.alias("key"), F.when(F.trim(value) == "", "NA").otherwise(F.trim(value)).alias("value"))

    parts = F.filter(F.split(tags, ";"), lambda x: F.trim(x) != "")
    return F.map_from_entries(F.transform(parts, entry))
