"""Command line: python -m strandlake compress|decompress|stats|validate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.codec import MODES, Options, archive, archive_fasta, decode_blocks, decode_fasta, report_text
from .sources import fasta, fastq


def is_fastq(path: str) -> bool:
    return path.lower().endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz"))


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandlake", description="Archives of FASTA and FASTQ records as Parquet tables of coded blocks.")
    commands = parser.add_subparsers(dest="command", required=True)
    compress = commands.add_parser("compress", help="FASTA or FASTQ (by the name) to an archive")
    compress.add_argument("-k", "--order", type=int, default=Options.order, help="bases before a base that its context holds, 2 to 20")
    compress.add_argument("--block-size", type=int, default=Options.block_size, help="records of a block, 100 to 1000000")
    compress.add_argument("--mode", choices=MODES, default=Options.mode)
    compress.add_argument("--fastq", action="store_true", help="the input is FASTQ, whatever its name")
    compress.add_argument("--stats", action="store_true", help="print sizes and ratios")
    expand = commands.add_parser("decompress", help="an archive to text files")
    expand.add_argument("--fastq", action="store_true", help="write FASTQ")
    for p in (compress, expand):
        p.add_argument("input")
        p.add_argument("output")
    for name in ("stats", "validate"):
        commands.add_parser(name).add_argument("input")
    return parser.parse_args(argv)


def compressed(spark: SparkSession, path: str, options: Options, is_reads: bool) -> DataFrame:
    if is_reads:
        rows = fastq.read_fastq(spark, path)
        return archive(rows.select("record_no", "identifier", F.col("sequence").alias("seq"), F.col("quality").alias("qual"), "plus_line"), options=options)
    rows = fasta.read_fasta(spark, path)
    return archive_fasta(rows.withColumn("sequence", fasta.own_letters("sequence", "ambiguous")), options)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    given = arguments(argv)
    try:
        options = Options(given.mode, given.order, given.block_size) if given.command == "compress" else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    if given.command == "compress":
        compressed(spark, given.input, options, given.fastq or is_fastq(given.input)).write.mode("errorifexists").parquet(given.output)
        if given.stats:
            print(report_text(spark.read.parquet(given.output)))
    elif given.command == "decompress":
        stored = spark.read.parquet(given.input)
        if given.fastq or is_fastq(given.output):
            rows = decode_blocks(stored)
            fastq.write_fastq(rows.select("record_no", "identifier", F.col("seq").alias("sequence"), F.col("qual").alias("quality"), "plus_line"), given.output)
        else:
            fasta.write_fasta(decode_fasta(stored).withColumn("ambiguous", F.array().cast(f"array<{fasta.RUN}>")), given.output)
    elif given.command == "stats":
        print(report_text(spark.read.parquet(given.input)))
    else:
        bad = fastq.validate_fastq(spark, given.input).orderBy("record_no").limit(1).collect()
        print(bad[0]["problem"] if bad else "valid")
        return int(bool(bad))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
