"""FASTA text: records of a header line and sequence lines, read a record a row and written back.

A record's text is handled as bytes in NumPy, in time linear in it; letters other than bases are kept as runs, of which a genome has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import col
from ..operators.runs import running_start
from .fastq import few

RUN = "struct<pos: bigint, len: bigint, ch: string>"
_BASES = np.zeros(1 << 8, bool)
_BASES[list(b"ACGT")] = True


def parse(record: str) -> tuple[str, str, list[tuple[int, int, str]]]:
    """header, sequence and ambiguous runs (pos, len, ch) of a record's text without its > : blank lines and carriage returns of the sequence don't count, acgt become upper
    case, and every other letter becomes an A and is kept as it was."""
    header, _, body = record.partition("\n")
    whole = body.replace("\r", "").replace("\n", "").translate(_UPPER)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    odd = ~_BASES[np.minimum(codes, 255)] | (codes > 255)
    if not odd.any():
        return header, whole, []
    at = np.flatnonzero(odd)
    first = np.concatenate([[True], (np.diff(at) != 1) | (codes[at[1:]] != codes[at[:-1]])])
    begin = at[first]
    sizes = np.diff(np.append(np.flatnonzero(first), len(at)))
    runs = [(p, n, chr(c)) for p, n, c in zip(begin.tolist(), sizes.tolist(), codes[begin].tolist(), strict=True)]
    return header, np.where(odd, 65, codes).astype("<u4").tobytes().decode("utf-32-le"), runs


_UPPER = str.maketrans("acgt", "ACGT")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int64()), ("ch", pa.string())]))
    for batch in batches:
        for i in range(batch.num_rows):  # one at a time: a record may be a chromosome
            header, sequence, runs = parse(batch.column(3)[i].as_py())
            ambiguous = pa.array([[{"pos": p, "len": n, "ch": c} for p, n, c in runs]], kind)
            yield pa.record_batch([*(batch.column(j).slice(i, 1) for j in range(3)), pa.array([header]), pa.array([sequence]), ambiguous], ["_file", "_start", "_at", "header", "sequence", "ambiguous"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_no, header, sequence, ambiguous (runs); records without a sequence are left out, a sequence before any header gets an empty one."""
    rows = spark.read.text(path, lineSep="\n>").select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_id"))
    body = F.when(F.col("value").startswith(">"), F.substr("value", F.lit(2))).when((F.col("_start") == 0) & ~F.col("value").startswith(">") & (F.col("_at") == 1), F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_id"))).withColumn("_body", body)
    # a record counts if a line after its header has more than line ends
    counted = placed.where(F.regexp_replace("_body", r"^[^\n]*\n?", "").rlike(r"[^\r\n]"))
    sizes = counted.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    kind = "_file string, _start bigint, _at int, header string, sequence string, ambiguous array<" + RUN + ">"
    found = counted.select("_file", "_start", "_at", "_body").mapInArrow(_parsed, kind)
    rank = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at")) - 1
    return found.withColumn("_rank", rank).join(few(before), ["_file", "_start"]).select((F.col("_rank") + F.col("_before")).alias("record_no"), "header", "sequence", "ambiguous")


def own_letters(sequence: Column | str, ambiguous: Column | str) -> Column:
    """The sequence with its ambiguous letters: the stretches between the runs and the runs, joined once."""
    whole, runs = col(sequence), col(ambiguous)
    end = F.array(F.struct((F.length(whole) + 0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("len"), F.lit("").alias("ch")))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("len"), F.lit("").alias("ch")))
    between = F.zip_with(F.concat(start, runs), F.concat(runs, end), lambda a, b: F.concat(F.repeat(a["ch"], a["len"].cast("int")), F.substr(whole, (a["pos"] + a["len"] + 1).cast("int"), (b["pos"] - a["pos"] - a["len"]).cast("int"))))
    return F.when(F.size(runs) > 0, F.array_join(between, "")).otherwise(whole)


def to_text(header: Column | str, sequence: Column | str, ambiguous: Column | str, width: int = 80) -> Column:
    whole = F.regexp_replace(own_letters(sequence, ambiguous), f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), col(header), F.lit("\n"), whole)


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    rows = records.repartitionByRange("record_no").sortWithinPartitions("record_no")
    rows.select(to_text("header", "sequence", "ambiguous", width).alias("value")).write.text(path)


def sequence_only(records: DataFrame) -> DataFrame:
    """record_no, start, sequence: the records' place in the concatenation of all sequences, in which other letters are A. It is never one string."""
    sized = records.select("record_no", "sequence").withColumn("_size", F.length("sequence").cast("bigint"))
    return running_start(sized, "_size", "record_no", "start").select("record_no", "start", "sequence")
