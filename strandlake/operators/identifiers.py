"""Identifiers as tokens: kinds, dictionary, deltas of numbers, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Entries of the dictionary at most; its size bounds what is broadcast.
DICTIONARY = 256


def tokenize(df: DataFrame, *keep: str, identifier: str = "identifier") -> DataFrame:
    """keep, tok_no (from 0), kind, text, num, width: num and width of numbers of 18 digits at most, else null."""
    rows = df.select(*keep, F.posexplode(text.tokens(identifier)).alias("tok_no", "text"))
    number = text.is_numeric("text")
    return rows.select(
        *keep,
        F.col("tok_no").cast("bigint").alias("tok_no"),
        text.token_kind("text").alias("kind"),
        "text",
        F.when(number, F.try_to_number("text", F.lit("9" * 18))).cast("bigint").alias("num"),
        F.when(number, F.length("text")).cast("bigint").alias("width"),
    )


def detokenize(tokens: DataFrame, *keys: str) -> DataFrame:
    whole = F.when(F.col("kind") == "NUMBER", text.format_number("num", F.col("width").cast("int"))).otherwise(F.col("text"))
    parts = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_no", whole.alias("t")))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("identifier"))


def dictionary(tokens: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """text, n, idx of the literals seen twice or more, by count times length, then by text."""
    counts = tokens.where("kind = 'LITERAL'").groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = counts.orderBy(F.desc(F.col("n") * F.length("text")), "text").limit(size)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc(F.col("n") * F.length("text")), "text")) - 1).cast("bigint"))


def encode(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """idx of each literal in the dictionary, null on a miss; the dictionary's size is bounded, so it is broadcast."""
    return tokens.join(F.broadcast(words.select("text", "idx")), "text", "left").withColumn("idx", F.when(F.col("kind") == "LITERAL", F.col("idx")))


def decode(encoded: DataFrame, words: DataFrame) -> DataFrame:
    found = encoded.drop("text").join(F.broadcast(words.select("idx", "text")), "idx")
    return found


def number_deltas(tokens: DataFrame, *partition: str, record: str) -> DataFrame:
    """delta against the number token before, whatever its column, where that is within a byte, the one before isn't 0 and the widths agree; else null."""
    w = Window.partitionBy(*partition).orderBy(record, "tok_no")
    numbers = tokens.where("kind = 'NUMBER'").withColumns({"_n": F.lag("num").over(w), "_w": F.lag("width").over(w)})
    fits = (F.col("_n") != 0) & (F.col("_w") == F.col("width")) & (F.col("num") - F.col("_n")).between(-128, 127)
    return numbers.withColumn("delta", F.when(fits, F.col("num") - F.col("_n"))).drop("_n", "_w")
