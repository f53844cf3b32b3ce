"""FASTQ text: strict four-line records, read from splittable text and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import col


def is_valid(seq: Column | str, qual: Column | str) -> Column:
    return (F.length(col(seq)) > 0) & (F.length(col(seq)) == F.length(col(qual)))


def to_text(identifier: Column | str, seq: Column | str, plus_line: Column | str, qual: Column | str) -> Column:
    return F.concat(F.lit("@"), col(identifier), F.lit("\n"), col(seq), F.lit("\n+"), col(plus_line), F.lit("\n"), col(qual))


#: Splits whose counts are broadcast; with more of them the counts are joined by key.
MOST_SPLITS = 200_000


def few(sizes: DataFrame) -> DataFrame:
    """Marks a table of a row a split for broadcast if it has few rows."""
    kept = sizes.persist()
    return F.broadcast(kept) if kept.count() <= MOST_SPLITS else kept


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and value of a file's lines. A line's number is its rank in its partition plus the lines of the partitions before: counts are
    added up, the text is read where it lies. Files are in order of name."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_id"))
    chunk = ["_file", "_start"]
    sizes = lines.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*chunk).orderBy("_id")) - 1
    return lines.withColumn("_rank", rank).join(few(before), chunk).select((F.col("_rank") + F.col("_before")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def _records(lines: DataFrame) -> DataFrame:
    rows = lines.groupBy(F.floor(F.col("line_no") / 4).alias("record_no")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("line_no") % 4).cast("int").alias("k"), "value"))).alias("m"))
    part = [F.try_element_at("m", F.lit(i)) for i in range(4)]
    return rows.select("record_no", *[p.alias(f"l{i}") for i, p in enumerate(part)])


def _problem() -> Column:
    def at(i: int) -> Column:
        return F.col("record_no") * 4 + i + 1

    return (
        F.when(~F.coalesce(F.col("l0").startswith("@"), F.lit(False)), F.concat(F.lit("line "), at(0), F.lit(": a record must start with @")))
        .when(F.col("l1").isNull() | F.col("l2").isNull() | F.col("l3").isNull(), F.concat(F.lit("line "), at(1), F.lit(": the record is cut off")))
        .when(~F.col("l2").startswith("+"), F.concat(F.lit("line "), at(2), F.lit(": the third line must start with +")))
        .when(F.length("l1") != F.length("l3"), F.concat(F.lit("line "), at(3), F.lit(": "), F.length("l1"), F.lit(" bases but "), F.length("l3"), F.lit(" qualities")))
    )


def validate_fastq(spark: SparkSession, path: str) -> DataFrame:
    """record_no and problem of every bad record; a blank line anywhere is one, an empty file has none."""
    return _records(numbered_lines(spark, path)).select("record_no", _problem().alias("problem")).where("problem is not null")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """record_no, identifier, sequence, plus_line, quality; the first bad record met is an error. Carriage returns at line ends go."""
    checked = _records(numbered_lines(spark, path)).withColumn("problem", _problem())
    good = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")).otherwise(F.substr("l0", F.lit(2)))
    return checked.select("record_no", good.alias("identifier"), F.col("l1").alias("sequence"), F.substr("l2", F.lit(2)).alias("plus_line"), F.col("l3").alias("quality"))


def count_fastq(spark: SparkSession, path: str) -> int:
    return read_fastq(spark, path).agg(F.count("identifier")).first()[0]


def write_fastq(reads: DataFrame, path: str) -> None:
    """Text files in order of record_no."""
    rows = reads.repartitionByRange("record_no").sortWithinPartitions("record_no")
    rows.select(to_text("identifier", "sequence", "plus_line", "quality").alias("value")).write.text(path)
