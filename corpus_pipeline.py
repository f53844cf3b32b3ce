"""A corpus from raw documents to packed sequences: language, exact copies, near copies, repeated passages, packing.

Every stage gets all rows that the one before kept, written as Parquet in the shared folder that the session names in spark.checkpoint.dir. What a stage
wrote is deleted when the next one is done; the last stage's table is the result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import broadcast_if_small, cut, drop_folder, passing_tables, shared_folder
from strandlake.llm.exact_dedup import WHITE, exact_dedup
from strandlake.llm.language_id import keep_identified
from strandlake.llm.ngram_jaccard import ngram_jaccard_join
from strandlake.llm.packing import best_fit_pack, cut_pieces
from strandlake.llm.suffix_dedup import suffix_dedup

#: The tokenizer and the thresholds are beyond SQL; tests/llm/test_pipeline.py compares each stage with plain Python on its own input.
ORACLE_SQL = None


def without(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs less the ids none of whose rows is kept. The ids that go are the fewer; rows without an id stay."""
    gone = cut(verdict.groupBy("doc_id").agg(F.max("kept").alias("any")).where(~F.col("any")).select("doc_id"))
    n = gone.count()
    named = docs.where("doc_id is not null").join(broadcast_if_small(gone, n, 24), "doc_id", "left_anti")  # rows without an id would meet in one task
    return named.unionByName(docs.where("doc_id is null"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language: no letter in them, or no language with half of the probability."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest original, then the smallest id; of rows repeated under one id, one."""
    verdict = exact_dedup(docs)
    found = without(docs, verdict)
    repeated = cut(verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    n = repeated.count()
    if not n:
        return found
    once = found.join(broadcast_if_small(repeated, n, 24), "doc_id", "left_anti")
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, ""), 256)
    kept = verdict.where("kept").select("doc_id", F.col("text_sha256").alias("_digest"))
    more = found.join(broadcast_if_small(repeated, n, 24), "doc_id", "left_semi").withColumn("_digest", digest).join(kept, ["doc_id", "_digest"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(F.char_length("text").desc_nulls_last(), *[F.col(c) for c in docs.columns]))
    return once.unionByName(more.withColumn("_first", first).where("_first = 1").select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that similarities of 0.8 or more connect."""
    return without(docs, ngram_jaccard_join(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings of 100 bytes out of the texts, all but their first; a document left without text stays, empty."""
    found = suffix_dedup(docs).drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048: a row for each piece."""
    return best_fit_pack(cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_duplicates", near), ("suffix_dedup", passages), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{i}-{name}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            drop_folder(spark, before)
        before = here
    return docs
