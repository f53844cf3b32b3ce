"""Reads as a stream: Parquet files of reads, as they come into a folder, counted in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "read_id bigint, identifier string, seq string, qual string"


def stream_reads(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of reads in a folder, as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_spectrum(stream: DataFrame, k: int) -> DataFrame:
    """The k-mer spectrum so far; the state has a row a k-mer."""
    from ..functions.dna import canonical_v4, pure_kmers

    return stream.select(F.explode(pure_kmers("seq", k)).alias("kmer")).groupBy(canonical_v4("kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
