"""Nucleotide and k-mer algebra as plain Column expressions, so that Catalyst sees through them.

Bases are the letters A, C, G, T; A pairs with T and C with G. Strings of one length sort as their 2-bit codes do. The four-group of a k-mer holds identity
(I), reversal (R), complement (C) and both (CR).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
TRANSFORMS = ("I", "R", "C", "CR")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_base(c: Column | str) -> Column:
    return col(c).rlike("^[ACGTacgt]$")


def base_code(c: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case; anything else counts as A."""
    return F.greatest(F.instr(F.lit(BASES), F.upper(col(c))) - 1, F.lit(0))


def code_base(code: Column | str) -> Column:
    return F.substr(F.lit(BASES), col(code) + 1, F.lit(1))


def complement(s: Column | str) -> Column:
    return F.translate(col(s), "ACGT", "TGCA")


def reverse(s: Column | str) -> Column:
    return F.reverse(col(s))


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(complement(s))


def apply_transform(kmer: Column | str, t: Column | str) -> Column:
    k, t = col(kmer), col(t)
    return F.when(t == "R", reverse(k)).when(t == "C", complement(k)).when(t == "CR", reverse_complement(k)).otherwise(k)


def transform_code(t: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, TRANSFORMS)), col(t)).cast("int") - 1


def multiply(g: Column | str, h: Column | str) -> Column:
    """Product in the four-group: the exclusive or of the codes; every element is its own inverse."""
    return F.get(F.array(*map(F.lit, TRANSFORMS)), transform_code(g).bitwiseXOR(transform_code(h)))


def images(kmer: Column | str) -> Column:
    k = col(kmer)
    return F.array(k, reverse(k), complement(k), reverse_complement(k))


def canonical_v4(kmer: Column | str) -> Column:
    k = col(kmer)
    return F.least(k, reverse(k), complement(k), reverse_complement(k))


def canonical_transform(kmer: Column | str) -> Column:
    """The first of I, R, C, CR that yields the canonical form."""
    k = col(kmer)
    least = canonical_v4(k)
    return F.when(k == least, "I").when(reverse(k) == least, "R").when(complement(k) == least, "C").otherwise("CR")


def valid_transforms(kmer: Column | str) -> Column:
    """All transforms that yield the canonical form."""
    k = col(kmer)
    return F.filter(F.array(*map(F.lit, TRANSFORMS)), lambda t: apply_transform(k, t) == canonical_v4(k))


def canonical_rc(kmer: Column | str) -> Column:
    """The two-way form: the lesser of a k-mer and its reverse complement."""
    k = col(kmer)
    return F.least(k, reverse_complement(k))


def orbit_size(kmer: Column | str) -> Column:
    return F.size(F.array_distinct(images(kmer)))


def is_palindrome(kmer: Column | str) -> Column:
    return col(kmer) == reverse_complement(kmer)


def is_reverse_palindrome(kmer: Column | str) -> Column:
    return col(kmer) == reverse(kmer)


def kmers(seq: Column | str, k: int) -> Column:
    """All substrings of k letters, in order; an empty array for a shorter sequence."""
    s = col(seq)
    n = F.length(s) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def pure_kmers(seq: Column | str, k: int) -> Column:
    """The k-mers without a letter other than A, C, G, T."""
    return F.filter(kmers(seq, k), lambda x: ~x.rlike("[^ACGT]"))


def minimizer(seq: Column | str, k: int) -> Column:
    """The least two-way canonical k-mer; null if there is none."""
    return F.array_min(F.transform(pure_kmers(seq, k), canonical_rc))


def gc_content(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(col(seq), "[^GC]", "")) / F.nullif(F.length(F.regexp_replace(col(seq), "[^ACGT]", "")), F.lit(0))


def edit_class(predicted: Column | str, actual: Column | str) -> Column:
    """match, transition (the complement) or transversion (any other base)."""
    p, a = col(predicted), col(actual)
    return F.when(p == a, "match").when(complement(p) == a, "transition").otherwise("transversion")


def register_sql(spark: SparkSession) -> None:
    """The same algebra for SQL users, as temporary SQL functions that are inlined into the plan."""
    for name, body in {
        "dna_complement": "translate(s, 'ACGT', 'TGCA')",
        "dna_revcomp": "reverse(translate(s, 'ACGT', 'TGCA'))",
        "dna_canonical_v4": "least(s, reverse(s), translate(s, 'ACGT', 'TGCA'), reverse(translate(s, 'ACGT', 'TGCA')))",
        "dna_canonical_rc": "least(s, reverse(translate(s, 'ACGT', 'TGCA')))",
    }.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns string return {body}")
