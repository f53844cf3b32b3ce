"""Pieces that the operators share: lineage cuts, size-checked broadcasts, and whole-batch text arithmetic in NumPy.

Text arithmetic works on the UTF-8 bytes of an Arrow column as they lie in memory, so that a word, line or shingle costs
a few array steps rather than a Python object.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
T = TypeVar("T")
#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes up to which a side of a join may be broadcast.
BROADCAST_BYTES = 48 << 20
#: Bytes of text that one step of array work takes at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20
#: Bytes of a batch between JVM and Python (a longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the batches that cross between JVM and Python by bytes, so that texts of any length need little memory on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one if driver and executors are one process; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named or spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = named or tempfile.mkdtemp(prefix="strandlake-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_stored: list[list[str]] = []


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what store() wrote meanwhile: for work whose result has been written by then."""
    _stored.append([])
    try:
        yield
    finally:
        for path in _stored.pop():
            drop_folder(spark, path)


def store(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table beside the checkpoints: smaller than a checkpoint where rows are many. It lasts as long as the passing_tables around it, else until the folder's owner clears the folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _stored:
        _stored[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Marks df for broadcast if its counted rows, at row_bytes each, stay within the bounds above."""
    return F.broadcast(df) if is_small(rows, row_bytes) else df


def is_small(rows: int, row_bytes: int = 64) -> bool:
    return rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES


def few_keys(df: DataFrame, key: str) -> Broadcast | None:
    """The integers in a column of df, which has a row for each, sorted and sent to all workers; None if they are too many for that."""
    if df.count() * 8 > BROADCAST_BYTES:
        return None
    found = df.select(F.col(key).cast("long")).toArrow().column(0).to_numpy()
    return df.sparkSession.sparkContext.broadcast(np.sort(found))


def picked(batches: Iterator[pa.RecordBatch], column: int, keys: Broadcast | None, inside: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose entry in a column is one of few_keys, or with inside=False all others (nulls too); all rows if keys is None."""
    for batch in batches:
        if keys is None:
            yield batch
            continue
        own = pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False)
        there = np.zeros(len(own), bool)
        if len(keys.value):
            there = keys.value[np.minimum(np.searchsorted(keys.value, own), len(keys.value) - 1)] == own
        there &= batch.column(column).is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(there if inside else ~there))


#: Rows of one key from which a join deals them by itself.
HOT_ROWS = 1000


def skew_join(rows: DataFrame, by_key: DataFrame, key: str, how: str = "inner", by_key_rows: int | None = None, hot_rows: int = HOT_ROWS, most_broadcast: int = BROADCAST_ROWS, salts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with by_key, which has a row for each key at most, so that no task gets all rows of a key that has many.

    If by_key is known to have few rows (by_key_rows, at about 64 bytes each), it is broadcast. Else keys are counted first, summed before the shuffle (if `hot`,
    the table of keys with more than hot_rows rows, isn't given). Rows of hot keys don't move: their rows of by_key are broadcast; if there are too many to broadcast, rows of hot
    keys are dealt by key and one of `salts` numbers, and their rows of by_key are repeated for each number. Other rows are joined by key.
    """
    if by_key_rows is not None and by_key_rows <= most_broadcast:
        return rows.join(broadcast_if_small(by_key, by_key_rows), key, how)
    if hot is None:
        hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__sl_n")).where((F.col("__sl_n") > hot_rows) & F.col(key).isNotNull()).select(key)
    hot = cut(hot)
    n = hot.count()
    if not n:
        return rows.join(by_key, key, how)
    if n <= most_broadcast:
        few, theirs = F.broadcast(hot), F.broadcast(by_key.join(F.broadcast(hot), key, "left_semi"))
        moved = rows.join(few, key, "left_semi").join(theirs, key, how)
    else:
        few = hot.withColumn("__sl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = rows.withColumn("__sl_salt", F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in rows.columns if c != key]), F.lit(salts)).cast("int"))
        theirs = by_key.join(few, key)
        flagged = salted.join(few.withColumn("__sl_hot", F.lit(True)), [key, "__sl_salt"], "left")
        moved = flagged.where("__sl_hot").drop("__sl_hot").join(theirs, [key, "__sl_salt"], how).drop("__sl_salt")
        calm = flagged.where("__sl_hot is null").drop("__sl_hot", "__sl_salt").join(by_key, key, how)
        return calm.unionByName(moved)
    return rows.join(few, key, "left_anti").join(by_key, key, how).unionByName(moved)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about `most` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, one thing at a time: whatever another operator left behind goes first."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def _libc_trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim. Arrays from 4 MB on get pages of their own, which go back when freed: left alone, glibc raises that bound up to 32 MB."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        return libc.malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_trim = _libc_trim()


def release() -> None:
    """Drops what an earlier operator left in this worker, and gives free memory back to the system: workers live on from task to task."""
    if _resident:
        _resident.clear()
        gc.collect()
    _tables.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work with release() before it and after: a worker that waits for its next task, of another operator too, holds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from work(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_RADIX = 0x9E3779B97F4A7C15
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(radix: int, n: int) -> np.ndarray:
    table = _tables.get(radix)
    if table is None or len(table) < n:
        size = 1 << max(16, n.bit_length())
        factors = np.full(size, U(radix))
        factors[0] = U(1)
        table = np.multiply.accumulate(factors)
        if size <= 1 << 24:
            _tables[radix] = table
    return table[:n]


class Hashes:
    """Hashes of any byte ranges of a buffer: differences of a prefix sum of byte times radix power, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _powers(_RADIX, n + 1)[:n], out=self.sums[1:])
        self.inverse = _powers(_RADIX_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


#: The bytes that part words: space, and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (first[:n] | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return start, end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and where each text's words begin among them (n + 1 entries)."""
    start, end = runs(~SPACE[data], off)
    return start, end, np.searchsorted(start, off)


def shingles(word_hash: np.ndarray, woff: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay within a text, and where each text's begin (n + 1 entries).

    A text of fewer than k words, but at least one, has one shingle of all its words; a text without words has none.
    """
    n = len(word_hash)
    count = np.diff(woff)
    take = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    soff = np.zeros(len(woff), np.int64)
    np.cumsum(take, out=soff[1:])
    at = np.arange(soff[-1]) - np.repeat(soff[:-1] - woff[:-1], take)
    last = np.repeat(woff[1:], take)
    h = np.zeros(len(at), U)
    padded = np.concatenate([word_hash, np.zeros(k, U)])
    for j in range(k):
        there = at + j < last
        h = mix(h * U(0xFF51AFD7ED558CCD) + np.where(there, padded[np.minimum(at + j, n)], U(0x632BE59BD9B4E019)))
    return h, soff


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first n_keys columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            same = all(held[-1].column(i)[-1].as_py() == keys[i][0] for i in range(n_keys))
            cut_at = int(np.flatnonzero(change)[0]) if change.any() else batch.num_rows
            if not same:
                yield pa.Table.from_batches(held)
                held = []
            elif last:
                yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
                held, batch, last = [], batch.slice(cut_at), last - cut_at
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(change)]]).astype(np.int64) if len(change) else np.zeros(1, np.int64)
