"""Vector best-fit packing: pieces of token sequences into bins limited in tokens, documents and attention cost.

A piece's demands follow from its length alone, so the packing needs only how many pieces there are of each length: at most `tokens` numbers,
counted by the cluster. Vector best-fit, longest first, then works on ranges of equal bins, and yields runs: "pieces of length L ranked lo to hi
go to sequences from s on, q in each, from offset o on". Each piece finds its run by its rank among its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder_of, vocabulary
from .common import cut, slices, small_batches


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; documents and attention cost (the sum of squared lengths) are unlimited, and without weight, if None.

    By default all three bind: a sequence's documents and its attention cost may be what one of `tokens` tokens can reach, so that fewest sequences are needed.

    score "norm" picks the bin with the least weighted norm of what is left after placing, "dot" the one whose remaining capacity has the largest weighted dot
    product with the demand, after which fuller bins win. The weights are by demand: how much of all bins' capacity the pieces use.
    """

    tokens: int = 2048
    documents: int | None = 2048
    attention: int | None = 2048**2
    score: str = "norm"


def vector_best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity = Capacity()) -> tuple[np.ndarray, int]:
    """Runs (length, lo, hi, first sequence, pieces in each sequence, offset) as rows of an array, and the number of sequences."""
    if len(lengths) and (lengths.max() > capacity.tokens or lengths.min() < 1):
        raise ValueError("every piece must have between 1 token and the capacity")
    if capacity.attention is not None and len(lengths) and (lengths.astype(object) ** 2).max() > capacity.attention:
        raise ValueError("a piece costs more attention than a sequence may")
    whole = np.array([capacity.tokens, capacity.documents or capacity.tokens, capacity.attention or capacity.tokens**2], float)
    used = np.array([(lengths * counts).sum(), counts.sum(), (lengths.astype(float) ** 2 * counts).sum()]) / whole
    limited = np.array([True, capacity.documents is not None, capacity.attention is not None])
    weight = np.where(limited, used / max(used.max(), 1e-9), 0.0)
    left = np.zeros((0, 3))  # what is left of each range of bins
    first, size, offset = (np.zeros(0, np.int64) for _ in range(3))
    runs, sequences = [], 0
    shortest = int(lengths.min()) if len(lengths) else 1
    for at in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[at]), int(counts[at])
        demand = np.array([length, 1.0, float(length) ** 2])
        lo = 0
        fits = np.flatnonzero((left >= demand).all(1))
        rest = left[fits] - demand
        near = ((rest / whole) ** 2 * weight).sum(1)
        if capacity.score == "dot":
            order = np.lexsort((near, -((left[fits] / whole) * (demand / whole) * weight).sum(1)))
        else:
            order = np.argsort(near, kind="stable")
        add = []
        for k in fits[order].tolist():
            if lo == n:
                break
            q = int(min(left[k] // demand))
            full = min(int(size[k]), (n - lo) // q)
            for bins, each in ((full, q), (1, n - lo - full * q)):
                if bins and 0 < each <= q and size[k] > 0:
                    runs.append((length, lo, lo + bins * each, first[k], each, offset[k]))
                    add.append((left[k] - each * demand, first[k], bins, offset[k] + each * length))
                    lo += bins * each
                    first[k] += bins
                    size[k] -= bins
        if lo < n:
            q = int(min(whole // demand))
            full, part = divmod(n - lo, q)
            for bins, each in ((full, q), (1, part)):
                if bins and each:
                    runs.append((length, lo, lo + bins * each, sequences, each, 0))
                    add.append((whole - each * demand, sequences, bins, each * length))
                    lo += bins * each
                    sequences += bins
        if add:
            left = np.concatenate([left, np.array([a[0] for a in add])])
            first, size, offset = (np.concatenate([x, np.array([a[i] for a in add], np.int64)]) for x, i in ((first, 1), (size, 2), (offset, 3)))
        open_ = (size > 0) & (left[:, 0] >= shortest)
        left, first, size, offset = left[open_], first[open_], size[open_], offset[open_]
    return np.array(runs, np.int64).reshape(-1, 6), sequences


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32 and, with keep_ids, ids (binary, little-endian unsigned 32-bit).

    A document is its ids under the vocabulary at `path`, then end_id; null text counts as empty. Only a longer document than `tokens` is cut, all
    pieces but the first being full. Rows with equal ids are documents of their own.
    """
    source = small_batches(docs.sparkSession).sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source.value, speculate=False)
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, blob in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    blob += end
                    n = len(blob) // 4
                    first = (n - 1) % tokens + 1
                    for j, at in enumerate((0, *range(first, n, tokens))):
                        size = tokens if j else first
                        own = blob[4 * at : 4 * (at + size)]
                        owner.append(i)
                        piece.append(j)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(own)
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*columns, pa.array(ids, pa.binary())] if keep_ids else columns, [*names, "ids"] if keep_ids else names)

    found = rows.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)
    return found.withColumnRenamed("_id", id_col)


_SHIFT = 1 << 44


def best_fit_pack(pieces: DataFrame, length_col: str = "length", capacity: Capacity = Capacity()) -> DataFrame:
    """pieces with sequence_id (0, 1, ...) and offset: into few sequences, each filled without gaps from 0, none over its capacity.

    A row's rank is that within its length in its partition plus the counts of the partitions before; no task gets a whole length. Columns
    named sequence_id or offset are replaced; a null length, or one outside 1 to capacity, is an error.
    """
    base = cut(pieces.drop("sequence_id", "offset").withColumns({"__sl_row": F.monotonically_increasing_id(), "__sl_part": F.spark_partition_id(), "__sl_len": F.col(length_col).cast("long")}))
    by_part = base.groupBy("__sl_len", "__sl_part").agg(F.count(F.lit(1)).alias("__sl_n"))
    before = by_part.withColumn("__sl_before", F.coalesce(F.sum("__sl_n").over(Window.partitionBy("__sl_len").orderBy("__sl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = by_part.groupBy("__sl_len").agg(F.sum("__sl_n").alias("n")).orderBy("__sl_len").limit(capacity.tokens + 2).collect()
    if any(r["__sl_len"] is None for r in found):
        raise ValueError("a piece has no length")
    runs, _ = vector_best_fit(np.array([r["__sl_len"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64), capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shipped = base.sparkSession.sparkContext.broadcast(runs)
    rank = F.row_number().over(Window.partitionBy("__sl_len", "__sl_part").orderBy("__sl_row")) - 1
    ranked = base.withColumn("__sl_rank", rank.cast("long")).join(before.drop("__sl_n"), ["__sl_len", "__sl_part"]).withColumn("__sl_rank", F.col("__sl_rank") + F.col("__sl_before"))
    names = [c for c in base.columns if c not in ("__sl_row", "__sl_part", "__sl_len")]
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, _, first, each, offset = shipped.value.T
        keys = length * _SHIFT + lo
        for batch in batches:
            n, r = (batch.column(i).to_numpy() for i in (0, 1))
            k = np.searchsorted(keys, n * _SHIFT + r, "right") - 1
            inner = r - lo[k]
            yield pa.record_batch([*batch.columns[2:], pa.array(first[k] + inner // each[k]), pa.array(offset[k] + inner % each[k] * n)], schema.names)

    return ranked.select("__sl_len", "__sl_rank", *names).mapInArrow(place, schema)
