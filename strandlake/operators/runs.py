"""Run-length, delta and segment transforms, forward and back. Runs within a record are array work in its row; no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def char_runs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, run_no, pos, len, ch: one row a run; runs never cross records."""
    rows = df.select(*keep, F.posexplode(text.run_structs(column)).alias("run_no", "r"))
    return rows.select(*keep, F.col("run_no").cast("bigint").alias("run_no"), "r.pos", "r.len", "r.ch")


def ambiguous_runs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The runs of letters other than A, C, G, T."""
    return char_runs(df, column, *keep).where(~F.col("ch").rlike("[ACGT]")).drop("run_no")


def strip_ambiguous(df: DataFrame, column: str) -> DataFrame:
    """column with A in place of other letters, and their runs beside it in `runs`."""
    runs = F.filter(text.run_structs(column), lambda r: ~r["ch"].rlike("[ACGT]"))
    return df.withColumns({"runs": runs, column: F.regexp_replace(column, "[^ACGT]", "A")})


def restore_ambiguous(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.overlay(column, "runs")).drop("runs")


def run_gaps(runs: DataFrame, *keys: str) -> DataFrame:
    """gap: the distance from the end of the run before, or from 0."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return runs.withColumn("gap", F.col("pos") - F.coalesce(F.lag(F.col("pos") + F.col("len")).over(w), F.lit(0)))


def delta(df: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    """delta: the difference from the row before (from 0 at the first)."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def undo_delta(df: DataFrame, order: str, *partition: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum("delta").over(w))


def boundaries(df: DataFrame, length: str, order: str, *partition: str) -> DataFrame:
    """first and last (exclusive) of each record in its partition's concatenation."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(w), F.lit(0))
    return df.withColumns({"first": start, "last": start + F.col(length)})


def running_start(df: DataFrame, length: str, order: str, name: str, span: int = 1 << 16) -> DataFrame:
    """name: the sum of the lengths before each row in order of `order`, a whole number. Stretches of `span` numbers are summed first, so that one task adds up only these."""
    rows = df.withColumn("_span", F.floor(F.col(order) / span))
    sums = rows.groupBy("_span").agg(F.sum(length).alias("_sum"))
    before = sums.select("_span", F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(before, "_span").withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_inside", "_before", "_span")


def extensions(runs: DataFrame) -> DataFrame:
    """ext_no, ext: a run longer than 1 writes len - 2 in pieces of at most 31, a full piece being followed by another."""
    rest = F.col("len") - 2
    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(rest / 31)), lambda i: F.least(F.lit(31).cast("bigint"), rest - i * 31))
    rows = runs.where("len > 1")
    return rows.select(*rows.columns, F.posexplode(pieces).alias("ext_no", "ext"))
