"""Quality score by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, cut, release, runs, shingles, slices, small_batches, utf8, words
from .language_id import is_held_out

FEATURES = (
    "log_words", "log_word_len", "symbols", "shouts", "bars", "capitals", "digits", "stops", "breaks",
    "short_words", "long_words", "distinct_words", "repeat_words", "dup_lines",
)


def _table(chars: str | bytes | range) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return found


_SYMBOLS, _SHOUTS, _UPPER, _LOWER, _DIGITS, _STOPS = (_table(x) for x in ("#*$%&<>~^_=", "!?", range(65, 91), range(97, 123), range(48, 58), ".,;:"))


def _share_repeated(keys: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many distinct keys it has; for each key: whether its text has it twice or more."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    distinct = np.bincount(owner[order][first], minlength=len(off) - 1)
    twice = np.zeros(len(keys), bool)
    twice[order] = ~first | np.append(same, False)[: len(keys)]
    return distinct, twice


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares under a square root, sizes under a logarithm. An empty text gets zeros."""

    def total(flag: np.ndarray, at: np.ndarray = off) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return np.diff(sums[at]).astype(float)

    start, end, woff = words(data, off)
    size = end - start
    n = np.maximum(1, np.diff(woff)).astype(float)
    letters = np.maximum(1, total(_UPPER[data]) + total(_LOWER[data]))
    nbytes = np.maximum(1, np.diff(off)).astype(float)
    hashed = Hashes(data)
    key = hashed.of(start, end)
    distinct, _ = _share_repeated(key, woff)
    triples, toff = shingles(key, woff, 3)
    _, twice = _share_repeated(triples, toff)
    again = np.zeros(len(key) + 3, bool)
    at = (np.arange(len(triples)) - np.repeat(toff[:-1] - woff[:-1], np.diff(toff)))[twice]
    for j in range(3):
        again[at + j] = True
    ls, le = runs(data != 10, off)
    loff = np.searchsorted(ls, off)
    lines, _ = _share_repeated(hashed.of(ls, le), loff)
    word_bytes = np.diff(np.concatenate([[0], np.cumsum(size)])[woff])
    share = lambda x: np.sqrt(np.minimum(4, x / n))
    bar = (size == 1) & (data[start] == 124) if len(start) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(np.diff(woff)),
        np.log1p(word_bytes / n),
        share(total(_SYMBOLS[data])),
        share(total(_SHOUTS[data])),
        share(total(bar, woff)),
        np.sqrt(total(_UPPER[data]) / letters),
        np.sqrt(total(_DIGITS[data]) / nbytes),
        share(total(_STOPS[data])),
        share(total(data == 10)),
        share(total(size <= 3, woff)),
        share(total(size >= 10, woff)),
        np.sqrt(distinct / n),
        share(total(again[: len(key)], woff)),
        np.sqrt(1 - lines / np.maximum(1, np.diff(loff))) * (np.diff(loff) > 0),
    ])


@dataclass
class Discriminant:
    """Per class: prior logarithm, mean, inverse Cholesky factor of the shrunk covariance and its log determinant, in standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    log_prior: list[float]
    centre: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.centre):
            return np.full(len(x), 0.5)
        z = (x - self.mean) / self.scale
        density = [p - 0.5 * (((z - c) @ w.T) ** 2).sum(1) - 0.5 * d for p, c, w, d in zip(self.log_prior, self.centre, self.whiten, self.log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 4, -30, 30)))


def fit(labelled: DataFrame, shrink: float = 0.2, pooled_part: float = 0.5) -> Discriminant:
    """From columns x (array of FEATURES) and label (0 or 1), all of them: one aggregation brings each class's count, sums and products.

    A class's covariance is (1 - shrink) of its own and `shrink` of a target: `pooled_part` of the pooled covariance, the rest a multiple of the
    identity. Without rows of both classes every score is 0.5.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    rows = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    by = {r["label"]: r for r in rows}
    if not {0, 1} <= by.keys():
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], [])
    n = [by[c]["n"] for c in (0, 1)]
    sums = [np.array([by[c][f"s{i}"] for i in range(d)]) for c in (0, 1)]
    products = [np.zeros((d, d)), np.zeros((d, d))]
    for c in (0, 1):
        for i, j in pairs:
            products[c][i, j] = products[c][j, i] = by[c][f"p{i}_{j}"]
    mean = sum(sums) / sum(n)
    scale = np.sqrt(np.maximum(1e-6, np.diag(sum(products)) / sum(n) - mean**2))
    centre = [(s / k - mean) / scale for s, k in zip(sums, n, strict=True)]
    own = [(p / k - np.outer(s / k, s / k)) / np.outer(scale, scale) for p, s, k in zip(products, sums, n, strict=True)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    whiten, log_det = [], []
    for c in (0, 1):
        target = pooled_part * pooled + (1 - pooled_part) * np.eye(d) * np.trace(own[c]) / d
        factor = np.linalg.cholesky((1 - shrink) * own[c] + shrink * target + 1e-6 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(mean, scale, [float(np.log(k / sum(n))) for k in n], centre, whiten, log_det)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: <id_col>, held_out, score, predicted.

    Labels are learned only from ids whose crc32(id as text) mod 3 isn't 1, and from all of those; null ids and labels other than 0 and 1 teach
    nothing; an id with several labels or rows counts once for each. Only the text, null as empty, is an input of a score.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "_text"):
                x = statistics(*utf8(part.column(1)))
                values = pa.array(x.ravel(), pa.float64())
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["_id", "x"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    small_batches(docs.sparkSession)
    kind = rows.schema["_id"].dataType.simpleString()
    measured = cut(rows.mapInArrow(measure, f"_id {kind}, x array<double>"))
    held_out = is_held_out("_id")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    shipped = docs.sparkSession.sparkContext.broadcast(fit(measured.where(~held_out).join(known, "_id")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(shipped.value.score(x), pa.float64())], ["_id", "score"])

    scored = measured.mapInArrow(judge, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
