"""Line-first cleaning with built-in functions only: bad lines go first, then the texts that lost too much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """A line fails if one of these holds; integer arithmetic throughout. A line without a word neither fails nor counts.

    punctuation: of its characters outside white space, over `max_marks_percent` are marks of `marks`.
    navigation: at least `min_bars` words are a bare separator (| or a bullet or arrow), or over `max_bars_percent` of its words are.
    boilerplate: it matches `boilerplate` (cookie notices, legal and navigation phrases of web pages).
    A text is rejected if over `max_lost_percent` of its word characters stood in failed lines.
    """

    marks: str = "#*$%&|<>!^~=_{}[]\\"
    max_marks_percent: int = 10
    min_bars: int = 4
    max_bars_percent: int = 15
    boilerplate: str = (
        r"(?i)(accept (all )?cookies|we use cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript"
        r"|lorem ipsum|click here|read more|sign up (now|for)|subscribe to our|follow us on|share (this|on)|back to top|skip to (main )?content)"
    )
    max_lost_percent: int = 30


def _in_class(chars: str) -> str:
    return "".join("\\" + c if c in r"\[]^-&" else c for c in chars)


def _window(words: str, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(3)))


def _placed_windows(keys: str) -> Column:
    """The hashes of 3-word windows with their places, in order; null where no two are equal, which spares most texts the sort."""
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), placed)


def _repeat_words(placed: str) -> Column:
    """Words that stand in a window whose neighbour in the sorted order is equal. `placed` is a column, not an expression: it is read for each element."""

    def again(w: Column, j: Column) -> Column:
        same = [w["k"] == F.get(placed, at)["k"] for at in (j - 1, j + 1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

    places = F.flatten(F.transform(F.filter(placed, again), lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))
    return F.when(F.col(placed).isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(places))).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: <id_col>, the counts of the base rules, line counts, clean_text and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a word), n_bad_lines, lost_chars (word
    characters in failed lines), clean_text (the lines that passed, joined by a newline), kept. A null text counts as empty: no words, base_failed,
    clean_text "". Repeated rows and ids are judged each by itself; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.filter(F.split(text, WHITE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )

    split = split.withColumn("_keys", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: _window("_words", i))))
    split = split.withColumn("_placed", _placed_windows("_keys"))

    def chars(line: Column) -> Column:
        return F.char_length(F.regexp_replace(line, WHITE, ""))

    def measured(line: Column) -> Column:
        """What the rules ask of a line, each counted once."""
        own = F.filter(F.split(line, WHITE), lambda w: w != "")
        marks = F.char_length(F.regexp_replace(line, f"[^{_in_class(rules.marks)}]+", ""))
        return F.struct(line.alias("line"), own.alias("words"), marks.alias("marks"))

    def bad(x: Column) -> Column:
        bare = F.size(F.filter(x["words"], lambda w: w.isin("|", "»", "›", "•", "·", ">", "/")))
        return (
            (x["marks"] * 100 > F.char_length(F.array_join(x["words"], "")) * rules.max_marks_percent)
            | (bare >= rules.min_bars)
            | (bare * 100 > F.size(x["words"]) * rules.max_bars_percent)
            | x["line"].rlike(rules.boilerplate)
        )

    counted = split.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        chars(F.col("_text")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", f"[^{_in_class(SYMBOLS)}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_placed").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.transform(F.filter(F.transform("_lines", measured), lambda x: ~bad(x)), lambda x: x["line"]).alias("_good"),
    )
    judged = counted.select(
        "*",
        ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
        (F.col("n_lines") - F.size("_good")).alias("n_bad_lines"),
        (F.col("word_chars") - chars(F.array_join("_good", ""))).cast("long").alias("lost_chars"),
    )
    return judged.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_lines",
        "n_bad_lines",
        "lost_chars",
        F.array_join("_good", "\n").alias("clean_text"),
        (~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_percent)).alias("kept"),
    )
