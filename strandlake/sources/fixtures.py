"""Reads and contigs derived from the driver's tables, which hold no sequences of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, identifier, seq, qual: a read of 20 to 64 bases for each order; about one base in 16 is N. Identifiers hold all delimiters, some 400 words often, others once, and numbers of 19 digits."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as read_id",
        "concat('RUN', cast(o_custkey % 400 as string), ':', cast(o_custkey % 4 + 1 as string), ':', cast(1000 + o_orderkey % 97 as string), ':', cast(o_orderkey as string), "
        "case o_orderkey % 5 when 0 then '#0/1' when 1 then concat('.x-', cast(1000000000000000000 + o_orderkey % 7 as string)) when 2 then ' y_02' when 3 then '|z@3' else concat(chr(9), 'lane', cast(o_orderkey as string)) end) as identifier",
        "substring(translate(concat(md5(concat('s', cast(o_orderkey as string))), md5(concat('t', cast(o_orderkey as string)))), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, cast(20 + o_orderkey % 45 as int)) as seq",
        "substring(translate(concat(md5(concat('q', cast(o_orderkey as string))), md5(concat('r', cast(o_orderkey as string)))), '0123456789abcdef', 'IIIIIIIIFFFF::,#'), 1, cast(20 + o_orderkey % 45 as int)) as qual",
    )


READS_SQL = """reads as (
  select o_orderkey as read_id,
         concat('RUN', cast(o_custkey % 400 as varchar), ':', cast(o_custkey % 4 + 1 as varchar), ':', cast(1000 + o_orderkey % 97 as varchar), ':', cast(o_orderkey as varchar),
                case o_orderkey % 5 when 0 then '#0/1' when 1 then concat('.x-', cast(1000000000000000000 + o_orderkey % 7 as varchar)) when 2 then ' y_02' when 3 then '|z@3' else concat(chr(9), 'lane', cast(o_orderkey as varchar)) end) as identifier,
         substring(translate(concat(md5(concat('s', cast(o_orderkey as varchar))), md5(concat('t', cast(o_orderkey as varchar)))), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 20 + o_orderkey % 45) as seq,
         substring(translate(concat(md5(concat('q', cast(o_orderkey as varchar))), md5(concat('r', cast(o_orderkey as varchar)))), '0123456789abcdef', 'IIIIIIIIFFFF::,#'), 1, 20 + o_orderkey % 45) as qual
  from orders)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s: the letters A, C, G, T and N of each document, with its repeats."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "regexp_replace(upper(text), '[^ACGTN]', '') as s")


CONTIGS_SQL = "contigs as (select doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') as s from documents)"
