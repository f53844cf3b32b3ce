"""Spectra and context statistics over k-mers. Counts are combined before the shuffle; the keys are at most 4^k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna


def explode_kmers(reads: DataFrame, k: int, *keep: str, seq: str = "seq") -> DataFrame:
    """keep, pos (from 0) and kmer, for every k-mer of A, C, G, T."""
    rows = reads.select(*keep, F.posexplode(dna.kmers(seq, k)).alias("pos", "kmer"))
    return rows.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("pos", F.col("pos").cast("bigint"))


def spectrum(reads: DataFrame, k: int, form: str = "raw", seq: str = "seq") -> DataFrame:
    """kmer, n; form: raw, v4 (four-group canonical) or rc (two-way canonical). Canonical forms are taken of the distinct k-mers only."""
    raw = explode_kmers(reads, k, seq=seq).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    if form == "raw":
        return raw
    canonical = dna.canonical_v4("kmer") if form == "v4" else dna.canonical_rc("kmer")
    return raw.groupBy(canonical.alias("kmer")).agg(F.sum("n").alias("n"))


def context_counts(reads: DataFrame, order: int, pooled: bool = True, complement_base: bool = True, seq: str = "seq") -> DataFrame:
    """ctx, base, n: how often a base follows `order` bases; pooled by the context's canonical form, the base complemented with it if the transform is C or CR."""
    raw = explode_kmers(reads, order + 1, seq=seq).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    ctx, base = F.substring("kmer", 1, order), F.substring("kmer", order + 1, 1)
    rows = raw.select(ctx.alias("ctx"), base.alias("base"), "n")
    if pooled:
        with_complement = F.when(dna.canonical_transform("ctx").isin("C", "CR"), dna.complement("base")).otherwise(F.col("base"))
        rows = rows.select(dna.canonical_v4("ctx").alias("ctx"), (with_complement if complement_base else F.col("base")).alias("base"), "n")
    return rows.groupBy("ctx", "base").agg(F.sum("n").alias("n"))


def evict(counts: DataFrame, threshold: int) -> DataFrame:
    """The contexts whose total is over the threshold."""
    total = counts.groupBy("ctx").agg(F.sum("n").alias("total")).where(F.col("total") > threshold)
    return counts.join(total, "ctx")


def context_entropy(counts: DataFrame) -> DataFrame:
    """total and bits (rounded to 4 places) of each context under its own frequencies."""
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy("ctx")))
    p = F.col("n") / F.col("total")
    return total.groupBy("ctx").agg(F.max("total").alias("total"), F.round(F.sum(-p * F.log2(p)), 4).alias("bits"))


def most_confident(reads: DataFrame, orders: range, seq: str = "seq") -> DataFrame:
    """For each order the context and base of the highest add-one probability, first by name among equals, and the order's bucket (at most 7)."""
    found = None
    for order in orders:
        counts = context_counts(reads, order, seq=seq).withColumn("total", F.sum("n").over(Window.partitionBy("ctx")))
        best = counts.select(F.lit(order).alias("k"), F.struct((-F.round((F.col("n") + 1) / (F.col("total") + 4), 6)).alias("p"), "ctx", "base").alias("s"))
        one = best.groupBy("k").agg(F.min("s").alias("s")).select(F.col("k").cast("bigint"), F.col("s.ctx"), F.col("s.base"), (-F.col("s.p")).alias("p"), F.least(F.lit(7), F.floor(F.col("k") / 2)).cast("bigint").alias("bucket"))
        found = one if found is None else found.unionByName(one)
    return found
