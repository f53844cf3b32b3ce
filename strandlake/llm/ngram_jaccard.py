"""Documents whose sets of word shingles have a Jaccard similarity of a threshold or more: a chosen-path join.

In each run a set walks down a tree: at every node it takes the shared-random minimum of its shingles and follows it, so that two sets stay together with the
probability of their similarity. A path ends where few enough sets are left; these are compared with each other by sketch. Runs repeat until
the chance that a similar pair never ends together is below 1 - recall. What is linked so far forms candidate clusters; each document's whole
set goes once to its cluster, where every pair is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, Hashes, U, bounds, broadcast_if_small, cut, grouped, mix, release, shingles, shuffle_partitions, skew_join, slices, small_batches, utf8, words
from .components import components


@dataclass(frozen=True)
class Paths:
    """threshold: least similarity; recall: wanted chance that a pair at the threshold ends together in a run, whatever the length of its paths.

    bucket: sets at which a path may end; longer paths, `depth` steps at most, only for fuller ones, which are then compared in blocks.
    A pair at the threshold ends together with the probability threshold ** depth at least in each run, so that many runs are needed.
    sketch: bytes of minwise sketch; slack: how far a sketch's estimate may lie under the threshold (5 standard deviations at 128 bytes).
    """

    threshold: float = 0.8
    words: int = 5
    recall: float = 1 - 1e-7
    bucket: int = 1000
    depth: int = 3
    sketch: int = 128
    slack: float = 0.18
    block: int = 400

    @property
    def runs(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.depth))


def _salt(n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U)) * U(0xA0761D6478BD642F)) | U(1)


def shingle_sets(part: pa.RecordBatch, at: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin."""
    data, off = utf8(part.column(at))
    start, end, woff = words(data, off)
    h, soff = shingles(Hashes(data).of(start, end), woff, k)
    sets = [np.unique(h[a:b]) for a, b in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True)]
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def set_digests(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0 for an empty one): the mixed sum of its mixed members."""
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h + U(0x2545F4914F6CDD1D)), out=sums[1:])
    size = np.diff(off)
    return np.where(size > 0, mix((sums[off[1:]] - sums[off[:-1]]) + size.astype(U)), U(0)).astype(np.int64)


def signatures(h: np.ndarray, off: np.ndarray, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """For each set that isn't empty: its path keys (runs x depth) and its sketch (bytes)."""
    full = np.flatnonzero(np.diff(off))
    first = off[:-1][full]
    keys = np.zeros((len(full), paths.runs, paths.depth), U)
    salts = _salt(paths.runs * paths.depth + paths.sketch)
    if len(full):
        for r in range(paths.runs):
            path = np.full(len(full), U(r + 1))
            for level in range(paths.depth):
                least = np.minimum.reduceat(mix(h ^ salts[r * paths.depth + level]) if level == 0 else (h ^ salts[r * paths.depth + level]) * salts[-1 - level - r], first)
                path = mix(path * U(0x9E3779B97F4A7C15) + least)
                keys[:, r, level] = path
    sketch = np.zeros((len(full), paths.sketch), np.uint8)
    if len(full):
        base = mix(h + U(0x5851F42D4C957F2D))
        for j in range(paths.sketch):
            least = np.minimum.reduceat((base ^ salts[paths.runs * paths.depth + j]) * salts[j], first)
            sketch[:, j] = mix(least) >> U(56)
    return keys.astype(np.int64), sketch


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; near(i, others) tells which of the others i is linked with."""
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            reached = left[hit]
            left = left[~hit]
            edges += [(i, j) for j in reached.tolist()]
            todo += reached.tolist()
    return edges


def _bucket_edges(paths: Paths) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = paths.threshold - paths.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in grouped(batches, 1):
            bucket, digest, n = (table.column(i).to_numpy() for i in range(3))
            sketch = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, paths.sketch)
            at = bounds(bucket)
            size = np.diff(at)
            a, b = [], []

            def similar(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
                sizes = np.minimum(n[i], n[j]) >= paths.threshold * np.maximum(n[i], n[j])
                same = (sketch[i] == sketch[j]).mean(-1)
                return sizes & ((same - 1 / 256) / (1 - 1 / 256) >= least)

            small = np.repeat(size <= 16, size)
            end = np.repeat(at[1:], size)
            for d in range(1, 16):
                i = np.flatnonzero(small & (np.arange(len(n)) + d < end))
                for i in np.array_split(i, len(i) // 200_000 + 1):
                    hit = similar(i, i + d)
                    a.append(digest[i[hit]])
                    b.append(digest[i[hit] + d])
            for lo, hi in zip(at[:-1][size > 16].tolist(), at[1:][size > 16].tolist(), strict=True):
                found = spanning(hi - lo, lambda i, rest, lo=lo: similar(lo + i, lo + rest))
                a.append(digest[[lo + x for x, _ in found]])
                b.append(digest[[lo + y for _, y in found]])
            yield pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def _links(table: pa.Table, lo: int, hi: int, paths: Paths) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For rows lo to hi, one cluster's block or pair of blocks: each row's links, weighted by members, and a spanning forest of them."""
    n, members, block = (table.column(c).slice(lo, hi - lo).to_numpy() for c in ("n", "members", "block"))
    sets = [np.frombuffer(x, U) for x in table.column("shingles").slice(lo, hi - lo).to_pylist()]
    m = hi - lo
    shared = np.zeros((m, m))
    if m == 2:
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        column = np.full(len(token), -1)
        column[count > 1] = np.arange((count > 1).sum())
        common = column[inverse] >= 0
        owner, at = owner[common], column[inverse][common]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        width = max(1, min(8192, (16 << 20) // m))
        for left in range(0, int((count > 1).sum()), width):
            x = np.zeros((m, width), np.float32)
            span = slice(*np.searchsorted(at, [left, left + width]))
            x[owner[span], at[span] - left] = 1
            shared += x @ x.T
    linked = shared * (1 + paths.threshold) >= paths.threshold * (n[:, None] + n[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    pair = table.column("pair")[lo].as_py()
    if pair >> 31 != pair & (1 << 31) - 1:
        linked &= block[:, None] != block[None, :]
    return linked @ members, spanning(m, lambda i, rest: linked[i, rest])


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: Paths = Paths(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: <id_col>, class_id, group_id, n_links, n_shingles, kept.

    A shingle is `words` successive words ([^\\x20\\x09-\\x0D]+) of a text; a shorter text has one shingle of all its words. class_id is the smallest id
    whose text has the same set of shingles; n_links the number of other rows whose similarity is the threshold or more, those of the
    same class included; group_id the smallest id of all that such links connect; kept is true for one row of each group. A null or
    empty text has no shingles, no links and a class and group of its own. Ties of id are broken by row; a null id comes last.
    """
    spark = small_batches(docs.sparkSession)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    kind = rows.schema["_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "_text"):
                h, off = shingle_sets(part, 1, paths.words)
                size = np.diff(off)
                keys, sketch = signatures(h, off, paths)
                full = np.cumsum(size > 0) - 1
                some = (size > 0).tolist()
                blobs = [keys[i].tobytes() for i in range(len(keys))], [sketch[i].tobytes() for i in range(len(sketch))]
                columns = [pa.array([x[i] if s else None for i, s in zip(full.tolist(), some, strict=True)], pa.binary()) for x in blobs]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(size), pa.array(set_digests(h, off)), *columns], ["_id", "_key", "n", "digest", "keys", "sketch"])

    signed = cut(rows.mapInArrow(sign, f"_id {kind}, _key long, n long, digest long, keys binary, sketch binary").withColumn("_row", F.monotonically_increasing_id()))
    me = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_key").alias("key"))
    classes = cut(
        signed.where("n > 0").groupBy("digest", "n").agg(F.min(me).alias("rep"), F.count(F.lit(1)).alias("members"), F.min(F.struct("keys", "sketch")).alias("s")).select("digest", "n", "rep", "members", "s.keys", "s.sketch")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(-1, paths.depth)
                owner = np.repeat(part.column(0).to_numpy(), paths.runs)
                yield pa.record_batch([pa.array(owner), *(pa.array(keys[:, i]) for i in range(paths.depth))], ["digest", *(f"k{i}" for i in range(paths.depth))])

    path = classes.select("digest", "keys").mapInArrow(walk, "digest long, " + ", ".join(f"k{i} long" for i in range(paths.depth)))
    ended = []
    for level in range(paths.depth):
        key = f"k{level}"
        here = cut(path.groupBy(key).agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
        path = cut(skew_join(path, here, key, hot=here.where(F.col("sets") > hot_rows).select(key)))
        last = level == paths.depth - 1
        blocks = F.ceil(F.col("sets") / paths.bucket) if last else F.lit(1)
        done = (path if last else path.where(F.col("sets") <= paths.bucket)).select(F.col(key).alias("bucket"), "digest", blocks.cast("int").alias("blocks"))
        ended.append(done)
        path = path.where(F.col("sets") > paths.bucket).drop("sets")
        if last or path.isEmpty():
            break
    ended = [_block_pairs(x, "bucket", "digest") for x in ended]
    met = ended[0]
    for more in ended[1:]:
        met = met.unionByName(more)
    bucketed = met.select(F.xxhash64("bucket", "pair").alias("bucket"), "digest").join(classes.select("digest", "n", "sketch"), "digest").select("bucket", "digest", "n", "sketch")
    edges = bucketed.repartition(parts, "bucket").sortWithinPartitions("bucket", "digest").mapInArrow(_bucket_edges(paths), "a long, b long")
    cluster = components(edges)
    sizes = cluster.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / paths.block).cast("int").alias("blocks"))
    wanted = cut(skew_join(cluster, sizes, "root", by_key_rows=cluster.count(), hot_rows=hot_rows).join(classes.select(F.col("digest").alias("node"), "n", "members", F.col("rep.id").alias("_id"), F.col("rep.key").alias("_key")), "node"))
    # a representative's text is found by its id and hash; of copies without an id, one row goes on
    names, held = broadcast_if_small(wanted, wanted.count()), ["_text", "node", "root", "blocks", "n", "members"]
    whole = rows.join(names, ["_id", "_key"]).select(*held)
    nameless = rows.where("_id is null").drop("_id").join(names.where("_id is null").drop("_id"), "_key").select(*held).dropDuplicates(["node", "_text"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "_text"):
                h, off = shingle_sets(part, 0, paths.words)
                mine = np.flatnonzero(set_digests(h, off) == part.column(1).to_numpy())
                texts = pa.array([h[off[i] : off[i + 1]].tobytes() for i in mine.tolist()], pa.binary())
                yield pa.record_batch([*(part.column(i).take(pa.array(mine)) for i in range(1, 6)), texts], ["digest", "root", "blocks", "n", "members", "shingles"])

    spelled = whole.unionByName(nameless).select("_text", F.col("node").alias("digest"), "root", "blocks", "n", "members").mapInArrow(spell, "digest long, root long, blocks int, n long, members long, shingles binary")
    paired = _block_pairs(spelled, "root", "digest").select("root", "pair", "digest", "n", "members", "block", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in grouped(batches, 2):
            digest = table.column("digest").to_numpy()
            at = bounds(table.column(0).to_numpy(), table.column(1).to_numpy())
            a, b, links = [], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                unique = np.unique(digest[lo:hi], return_index=True)[1]
                if len(unique) < hi - lo:  # rows repeated under one id
                    own = table.slice(lo, hi - lo).take(pa.array(np.sort(unique)))
                else:
                    own = table.slice(lo, hi - lo)
                names = own.column("digest").to_numpy()
                if len(names) < 2:
                    continue
                count, forest = _links(own, 0, len(names), paths)
                a += [names, names[[i for i, _ in forest]]]
                b += [names, names[[j for _, j in forest]]]
                links += [count, np.zeros(len(forest))]
            columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b, links)]
            yield pa.record_batch([pa.array(x) for x in columns], ["a", "b", "links"])

    verified = cut(paired.repartition(parts, "root", "pair").sortWithinPartitions("root", "pair", "digest").mapInArrow(verify, "a long, b long, links long"))
    links = verified.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    linked = components(verified.where("a != b")).withColumnRenamed("node", "digest")
    about = cut(classes.select("digest", "rep", "members").join(links, "digest", "left").join(linked, "digest", "left"))
    heads = about.where("root is not null").groupBy("root").agg(F.min("rep").alias("head"))
    about = skew_join(about, heads, "root", "left", hot_rows=hot_rows).select("digest", "rep", "members", "links", F.coalesce("head", "rep").alias("head"))
    out = skew_join(signed.select("_id", "_row", "n", "digest"), about, "digest", "left", hot_rows=hot_rows)
    alone = F.col("rep").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("rep.id")).alias("class_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("head.id")).alias("group_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("members") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        (alone | (F.col("head.row") == F.col("_row"))).alias("kept"),
    )


def _block_pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """A row for every pair of blocks that its own block takes part in, with columns block and pair (low << 31 | high); a group of one block stays as it is."""
    own = rows.withColumn("block", F.pmod(F.xxhash64(member), "blocks").cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.shiftleft(F.least("block", j).cast("long"), 31) + F.greatest("block", j))
    return own.withColumn("pair", F.explode(other)).drop("blocks")
