"""Integer codes, checks and probability arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col

#: Probabilities are fractions of this.
PROB_TOTAL = 1 << 16


def zigzag_encode(v: Column | str) -> Column:
    return F.shiftleft(col(v), 1).bitwiseXOR(F.shiftright(col(v), 63))


def zigzag_decode(z: Column | str) -> Column:
    return F.shiftrightunsigned(col(z), 1).bitwiseXOR(-(col(z).bitwiseAND(F.lit(1))))


def varint_size(v: Column | str) -> Column:
    """Bytes of a number of zero or more in base 128."""
    size = F.lit(9)
    for n in range(8, 0, -1):
        size = F.when(col(v) < (1 << 7 * n), F.lit(n)).otherwise(size)
    return size


def crc32(s: Column | str) -> Column:
    return F.crc32(col(s).cast("binary"))


def phred(c: Column | str) -> Column:
    return F.ascii(col(c)) - 33


def phred_char(q: Column | str) -> Column:
    return F.char(col(q) + 33)


def valid_quality(c: Column | str) -> Column:
    return F.ascii(col(c)).between(33, 126)


def position_bin(pos: Column | str, length: Column | str) -> Column:
    """0 to 7: the eighth of the read that a 0-based position lies in."""
    return F.least(F.lit(7), F.floor(col(pos) * 8 / col(length)))


def stretch(p: Column | str) -> Column:
    return F.ln(col(p) / (1 - col(p)))


def squash(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def inverse_sqrt(x: Column | str) -> Column:
    return 1 / F.sqrt(col(x))


def laplace(n: Column | str, total: Column | str, symbols: int = 4) -> Column:
    return (col(n) + 1) / (col(total) + symbols)


def rescale(n: Column | str, total: Column | str, most: int = 65_535) -> Column:
    """Halves a count, never to zero, once the total is over `most`."""
    return F.when(col(total) > most, F.shiftright(col(n), 1).bitwiseOR(F.lit(1))).otherwise(col(n))


def bits_per(size: Column | str, symbols: Column | str) -> Column:
    return F.when(col(symbols) > 0, 8.0 * col(size) / col(symbols)).otherwise(F.lit(0.0))
