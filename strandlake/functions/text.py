"""Identifiers and runs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col

#: The delimiters of identifiers, in the order of their codes.
DELIMITERS = ".:_/# \t@-|"
_CLASS = r"[.:_/# \t@\-|]"
_OTHER = r"[^.:_/# \t@\-|]"
MAX_DIGITS = 18


def is_delimiter(c: Column | str) -> Column:
    return col(c).rlike(f"^{_CLASS}$")


def is_numeric(s: Column | str) -> Column:
    return col(s).rlike("^[0-9]+$") & (F.length(col(s)) <= MAX_DIGITS)


def delimiter_code(c: Column | str) -> Column:
    return F.instr(F.lit(DELIMITERS), col(c)) - 1


def tokens(identifier: Column | str) -> Column:
    """Parts of an identifier: delimiters, and what stands between them."""
    return F.regexp_extract_all(col(identifier), F.lit(f"({_CLASS}|{_OTHER}+)"), F.lit(1))


def token_kind(t: Column | str) -> Column:
    return F.when(is_delimiter(t), "DELIMITER").when(is_numeric(t), "NUMBER").otherwise("LITERAL")


def parse_number(t: Column | str) -> Column:
    return F.when(is_numeric(t), col(t).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def format_number(n: Column | str, width: Column | str) -> Column:
    """Digits with zeros before them up to the width, never cut."""
    s = col(n).cast("string")
    return F.lpad(s, F.greatest(col(width), F.length(s)), F.lit("0"))


def runs(s: Column | str) -> Column:
    """The maximal runs of one character."""
    return F.regexp_extract_all(col(s), F.lit(r"((.)\2*)"), F.lit(1))


def run_structs(s: Column | str) -> Column:
    """(pos, len, ch) of the maximal runs, pos from 0. A run begins where a character differs from the one before; linear in the text."""
    chars = F.filter(F.split(col(s), ""), lambda c: c != "")
    placed = F.transform(chars, lambda c, i: F.struct(i.cast("bigint").alias("pos"), c.alias("ch")))
    begins = F.filter(F.zip_with(placed, F.concat(F.array(F.lit("")), chars), lambda x, before: F.when(x["ch"] != before, x)), lambda x: x.isNotNull())
    end = F.array(F.struct(F.length(col(s)).cast("bigint").alias("pos"), F.lit("").alias("ch")))
    next_ = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins), F.lit(1))), end)
    pairs = F.zip_with(begins, next_, lambda x, y: F.struct(x["pos"].alias("pos"), (y["pos"] - x["pos"]).alias("len"), x["ch"].alias("ch")))
    return F.filter(pairs, lambda r: r["ch"].isNotNull())


def expand(run_array: Column | str) -> Column:
    return F.array_join(F.transform(col(run_array), lambda r: F.repeat(r["ch"], r["len"].cast("int"))), "")


def overlay(s: Column | str, run_array: Column | str) -> Column:
    """s with each run (pos, len, ch) written over it."""
    return F.aggregate(col(run_array), col(s), lambda text, r: F.overlay(text, F.repeat(r["ch"], r["len"].cast("int")), (r["pos"] + 1).cast("int")))


def wrap(s: Column | str, width: int = 80) -> Column:
    return F.regexp_replace(col(s), f"(.{{{width}}})(?=.)", "$1\n")
