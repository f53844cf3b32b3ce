"""Exact dedup by a tree merge of sorted digest runs; built-in functions only.

Every input partition forms a run: its distinct digests, each with the best identifier and a count. Runs are merged
`fan_in` at a time in binomial rounds (a run's number loses log2(fan_in) bits a round), each round a sort-merge of the runs that meet,
until one run is left. The winners then go down the same tree. Nowhere does a task see more rows of a digest than it has runs to merge
or, at the leaves, rows in one partition, so that a group of any size stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: White space that doesn't count: space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are so after deleting WHITE; a null text counts as empty, so all null, empty and blank texts are one
    group. A digest is trusted only together with the length and a second, independent hash of the text (the
    verification at every level). Of equal texts the row with the most code points stays, then the smallest id; a null id
    comes last. Among repeated rows of the same id exactly one is kept. Other columns are ignored, whatever their names.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ["_digest", "_check", "_bytes"]
    base = cut(
        docs.select(F.col(id_col).alias("_id"), F.char_length(text).cast("long").alias("_chars"), F.regexp_replace(text, WHITE, "").alias("_norm")).select(
            "_id",
            "_chars",
            F.unhex(F.sha2("_norm", 256)).alias("_digest"),
            F.xxhash64("_norm").alias("_check"),
            F.octet_length("_norm").alias("_bytes"),
            F.spark_partition_id().alias("_run"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    best = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    runs = (base.agg(F.max("_run")).first()[0] or 0) + 1
    levels = [base.groupBy("_run", *key).agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_n"))]
    while runs > 1:
        merged = levels[-1].withColumn("_run", (F.col("_run") / fan_in).cast("int"))
        levels.append(merged.groupBy("_run", *key).agg(F.min("_best").alias("_best"), F.sum("_n").alias("_n")))
        runs = -(-runs // fan_in)
    found = levels[-1].where("_n > 1")
    for level in reversed(levels[:-1]):
        up = found.select(F.col("_run").alias("_up"), *key, "_best", "_n")
        found = level.drop("_best", "_n").withColumn("_up", (F.col("_run") / fan_in).cast("int")).join(up, ["_up", *key]).drop("_up")
    whole = base.join(found, ["_run", *key], "left")
    return whole.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        F.col("_chars").alias("n_chars"),
    )
