"""Blocks of records, the order of reads by minimizer within them, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna


def fixed_blocks(df: DataFrame, record: str, size: int) -> DataFrame:
    return df.withColumn("block_id", F.floor(F.col(record) / size).cast("bigint"))


def bounded_blocks(df: DataFrame, record: str, length: str, most_records: int = 10_000, most_bases: int = 2_000_000, chunk: int | None = None) -> DataFrame:
    """block_id under both limits: a block is closed before the read after the one that reached either.

    The rule is sequential: without a chunk one task scans two numbers a read (nothing else of the reads passes through it). With one, blocks also end after every `chunk`
    successive numbers of `record`, a whole number: chunks are then scanned side by side, and a block's id is its chunk above 2**32 and its place there.
    """
    lengths = df.select(F.col(record).alias("r"), F.col(length).cast("bigint").alias("n"), (F.floor(F.col(record) / chunk) if chunk else F.lit(0)).cast("bigint").alias("c"))
    lengths = (lengths.repartition("c") if chunk else lengths.repartition(1)).sortWithinPartitions("c", "r")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = records = bases = 0
        here = None
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, (n, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if c != here:
                    here, block, records, bases = c, c << 32, 0, 0
                if records >= most_records or bases >= most_bases:
                    block, records, bases = block + 1, 0, 0
                out[i] = block
                records, bases = records + 1, bases + (n or 0)
            yield pa.record_batch([batch.column(0), pa.array(out)], ["r", "block_id"])

    kind = df.schema[record].dataType.simpleString()
    return df.join(lengths.mapInArrow(scan, f"r {kind}, block_id bigint").withColumnRenamed("r", record), record)


def minimizer_order(df: DataFrame, record: str, block: str = "block_id", seq: str = "seq") -> DataFrame:
    """sorted_pos (from 0) of each read in its block by its least 15-mer, then 7-mer (none: last), then by record; orig_idx its place before."""
    marked = df.withColumns({"m15": dna.minimizer(seq, 15), "m7": dna.minimizer(seq, 7)})
    by_minimizer = Window.partitionBy(block).orderBy(F.asc_nulls_last("m15"), F.asc_nulls_last("m7"), record)
    place = lambda w: (F.row_number().over(w) - 1).cast("bigint")
    return marked.withColumns({"sorted_pos": place(by_minimizer), "orig_idx": place(Window.partitionBy(block).orderBy(record))})


def restore_order(ordered: DataFrame, block: str = "block_id") -> DataFrame:
    return ordered.repartition(block).sortWithinPartitions(block, "orig_idx")


def zip_streams(*streams: DataFrame, on: tuple[str, ...] = ("block_id", "pos")) -> DataFrame:
    """Streams of one column each, by place; a place that a stream lacks gets the empty string."""
    out = streams[0]
    for s in streams[1:]:
        out = out.join(s, list(on), "full")
    return out.na.fill("", [c for c in out.columns if c not in on])
