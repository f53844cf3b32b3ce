"""Removes every byte that a string of `length` bytes found earlier covers: suffix sorting over a difference cover chosen by content.

Texts don't line up, so the cover can't be positions modulo a period: of every `length - gram + 1` successive positions the one whose gram hashes lowest is
sampled. Equal strings thus hold equal samples at equal offsets, and a string is known by its sample's suffix and the few bytes before it, as in the merge step of
the difference-cover algorithm. Samples are sorted by gram over the cluster; those with an equal gram and equal surroundings are settled there.
Short grams recur by chance, the more the larger the input. Strings whose offset is at most half of the greatest share the bytes from the sample on, all others those about it:
only samples that have such a core of some 60 bytes in common with another's fetch their bytes. There, sampled suffixes are sorted by triples of words, whose names are sorted by triples again until `length` bytes are
named; so are the reversed prefixes; adjacent ones are compared, and the strings of each offset fall into classes by both ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, U, bounds, broadcast_if_small, few_keys, grouped, is_small, mix, picked, shuffle_partitions, slices, small_batches, store, tidy, utf8

LENGTH, GRAM = 100, 20
#: Samples of one core with differing surroundings from which each string of them becomes a group of its own, spread by its hash.
HOT = 1000
#: Bytes of text for each group of samples that a task holds at once; there are as many groups as the input needs.
GROUP_BYTES = 48 << 20
_POS = U((1 << 24) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` successive bytes, put together from hashes of runs of 1, 2, 4, ... bytes."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, U)
    power, size, done, out, rest = data.astype(U) + U(0x9E37), 1, 0, None, gram
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else (out * U(0x9FB21C651E98DF25) ^ (out >> U(29))) + part * U(0xD6E8FEB86659FD93)
            done += size
        rest >>= 1
        if rest:
            m = len(power) - size
            power = (power[:m] * U(0xC2B2AE3D27D4EB4F) ^ (power[:m] >> U(31))) + power[size : size + m] * U(0x165667B19E3779F9)
            size *= 2
    return mix(out)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` successive entries, from least-so-far and least-to-come within blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    so_far = np.minimum.accumulate(padded, 1).ravel()
    to_come = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(to_come[:m], so_far[width - 1 : width - 1 + m])


def samples(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sampled positions: text number, position in the buffer, first and last start of the strings that each stands for, hash of the gram."""
    width = length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U),)
    found = []
    whole = np.concatenate([np.flatnonzero(np.diff(off) >= length)])
    if not len(whole):
        return none
    step = (1 << 24) - length
    hashes = gram_hashes(data, gram)
    for lo in range(0, len(hashes) - width + 1, step):
        part = hashes[lo : lo + step + width - 1]
        key = (part & ~_POS) | np.arange(len(part), dtype=U)
        least = _window_least(key, width)
        start = np.arange(lo, lo + len(least))
        found.append((start, lo + (least & _POS).astype(np.int64)))
    start, at = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[start]
    inside = start + length <= off[text + 1]
    start, at, text = start[inside], at[inside], text[inside]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(at)) - 1
    at, text = at[begin], text[begin]
    return text, at, start[begin], start[last], hashes[at]


#: near, far: hashes of the bytes common to all strings whose offset (bytes before the sample) is at most half of the greatest, and to all others.
_RECORD = np.dtype([("gram", "<u8"), ("around", "<u8"), ("id", "<i8"), ("at", "<u4"), ("near", "<u4"), ("far", "<u4"), ("before", "u1"), ("span", "u1")])


def pack(found: np.ndarray) -> bytes:
    """Records column by column in order of text and place, which compresses better than row by row in order of hash."""
    found = found[np.lexsort((found["at"], found["id"]))]
    return b"".join(found[name].tobytes() for name in _RECORD.names)


def unpack(blob: pa.Scalar) -> np.ndarray:
    raw = blob.as_buffer()
    found, at = np.empty(raw.size // _RECORD.itemsize, _RECORD), 0
    for name in _RECORD.names:
        kind = _RECORD[name]
        found[name] = np.frombuffer(raw, kind, len(found), at)
        at += kind.itemsize * len(found)
    return found


def grams_of(blob: pa.Scalar) -> np.ndarray:
    raw = blob.as_buffer()
    return np.frombuffer(raw, _RECORD["gram"], raw.size // _RECORD.itemsize)


def name_triples(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Ranks of the rows of `words` (columns of equal width, most significant first) within the order of (group, row): triples of columns get
    names in sorted order, the names form triples again, until one name is left. Equal rows of a group share a rank."""
    names = [words[:, i] for i in range(words.shape[1])]
    while len(names) > 1:
        level = []
        for i in range(0, len(names), 3):
            triple = names[i : i + 3]
            order = np.lexsort(triple[::-1])
            new = np.zeros(len(order), bool)
            for column in triple:
                new[1:] |= column[order][1:] != column[order][:-1]
            name = np.empty(len(order), np.int64)
            name[order] = np.cumsum(new)
            level.append(name)
        names = level
    order = np.lexsort((names[0], group))
    new = np.zeros(len(order), bool)
    new[1:] = (names[0][order][1:] != names[0][order][:-1]) | (group[order][1:] != group[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _adjacent(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, bytes) and how many first bytes each shares with the row before it (-1 at a group's first)."""
    wide = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), wide), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    order = np.argsort(name_triples(padded.view(">u8").astype(np.uint64), group), kind="stable")
    a, b = matrix[order[1:]], matrix[order[:-1]]
    differ = a != b
    shared = np.full(len(matrix), -1, np.int64)
    shared[1:] = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    shared[1:][group[order][1:] != group[order][:-1]] = -1
    return order, shared


def repeated_offsets(group: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of (text, position): the least and greatest offset (bytes before the sample) of the strings found in an earlier row of the group; -1 where none is.

    before: the bytes before the sample, nearest first; after: those from the sample on; low and high: offsets that the row stands for.
    """
    n = len(group)
    least, most = np.full(n, -1), np.full(n, -1)
    by_after, after_shared = _adjacent(after, group)
    by_before, before_shared = _adjacent(before, group)
    for offset in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        mine = np.flatnonzero((low <= offset) & (offset <= high))
        if len(mine) < 2:
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[by_after] = np.cumsum(after_shared < length - offset)
        left[by_before] = np.cumsum(before_shared < offset)
        key = right[mine] * (n + 1) + left[mine]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(mine), bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        hit = mine[again]
        least[hit] = np.where(least[hit] < 0, offset, least[hit])
        most[hit] = offset
    return least, most


_SPANS = "doc long, start long, stop long, what int"
_SETTLED, _WANTED, _WANTED_HOT = 0, 1, 2


def _span_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)), pa.array(what.astype(np.int32))], ["doc", "start", "stop", "what"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each text that has any its spans (doc, spans), in UTF-8 bytes and apart, that strings of `length` bytes found earlier cover. Ids must be integers.

    Earlier: a smaller id, or the same text and an earlier start. Null counts as empty. Rows of one id count as one text each; of such rows
    equal positions tie, and none is the earlier. Samples are dealt into groups by their gram, as many as the input's bytes need; a task holds one group at a time.
    """
    spark = small_batches(docs.sparkSession)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text"))
    groups = max(parts, -(-int(rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // group_bytes))
    reach = length - gram
    half = reach // 2

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            held.clear()
            found = found[np.lexsort((found["at"], found["id"], found["around"], found["gram"]))]
            # of equal surroundings only the earliest need leave this task
            same = np.zeros(len(found), bool)
            same[1:] = (found["gram"][1:] == found["gram"][:-1]) & (found["around"][1:] == found["around"][:-1])
            same[1:] &= (found["id"][1:] != found["id"][:-1]) | (found["at"][1:] != found["at"][:-1])
            settled, found = found[same], found[~same]
            bucket = (mix(found["gram"]) % U(groups)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            at = bounds(bucket)
            blobs = [pack(found[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            early = [pack(settled[i : i + 100_000]) for i in range(0, len(settled), 100_000)]
            spread = [int(x["id"][0]) % groups for x in (settled[i : i + 1] for i in range(0, len(settled), 100_000))]
            columns = [pa.array([*bucket[at[:-1]].tolist(), *spread], pa.int64()), pa.array([False] * len(blobs) + [True] * len(early)), pa.array(blobs + early, pa.binary())]
            yield pa.record_batch(columns, ["bucket", "settled", "records"])

        for batch in batches:
            for part in slices(batch, "_text"):
                data, off = utf8(part.column(1))
                text, at, first, last, grams = samples(data, off, length, gram)
                found = np.zeros(len(text), _RECORD)
                hashes = Hashes(data)
                found["gram"], found["around"] = grams, hashes.of(first, last + length) + (at - first).astype(U)
                has_near, has_far = at - last <= half, at - first > half
                found["near"][has_near] = hashes.of(at[has_near], at[has_near] + length - half) >> U(32)
                found["far"][has_far] = hashes.of(at[has_far] - half - 1, at[has_far] + gram) >> U(32)
                found["id"] = part.column(0).to_numpy(zero_copy_only=False)[text]
                found["at"], found["before"], found["span"] = at - off[text], at - first, last - first
                held.append(found)
                if sum(map(len, held)) > 600_000:
                    yield from flush()
        if held:
            yield from flush()

    packets = rows.where("doc is not null").mapInArrow(tidy(sample), "bucket long, settled boolean, records binary")

    def spans_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = found["at"].astype(np.int64) - found["before"]
        return found["id"], start, start + found["span"].astype(np.int64) + length

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet in grouped(batches, 1):
            held: list[pa.Scalar] = []
            for settled, blob in zip(packet.column(1).to_pylist(), (x for chunk in packet.column(2).chunks for x in chunk), strict=True):
                if settled:
                    doc, start, stop = spans_of(unpack(blob))
                    yield _span_batch(doc, start, stop, np.full(len(doc), _SETTLED))
                else:
                    held.append(blob)
            # most grams are alone: they are told by their column before records are put together
            grams = np.sort(np.concatenate([np.zeros(0, U), *map(grams_of, held)]))
            grams = np.unique(grams[1:][grams[1:] == grams[:-1]])
            if not len(grams):
                continue
            held = [x[grams[np.minimum(np.searchsorted(grams, x["gram"]), len(grams) - 1)] == x["gram"]] for x in map(unpack, held)]
            found = np.concatenate(held)
            del packet, held, grams
            found = found[np.lexsort((found["at"], found["id"], found["around"], found["gram"]))]
            new_gram = np.ones(len(found), bool)
            new_gram[1:] = found["gram"][1:] != found["gram"][:-1]
            again = np.zeros(len(found), bool)
            again[1:] = ~new_gram[1:] & (found["around"][1:] == found["around"][:-1])
            # rows of one id at one position tie
            tie = np.zeros(len(found), bool)
            tie[1:] = again[1:] & (found["id"][1:] == found["id"][:-1]) & (found["at"][1:] == found["at"][:-1])
            doc, start, stop = spans_of(found[again & ~tie])
            yield _span_batch(doc, start, stop, np.full(len(doc), _SETTLED))
            # of the others those whose strings of near or far offsets may equal another's: all such strings hold the same `near` or `far` bytes
            found = found[~again]
            high = found["before"].astype(np.int64)
            low = high - found["span"]
            for core, mine, least, most in (("near", low <= half, low, np.minimum(high, half)), ("far", high > half, np.maximum(low, half + 1), high)):
                k = np.flatnonzero(mine)
                k = k[np.lexsort((found[core][k], found["gram"][k]))]
                edge = bounds(found["gram"][k], found[core][k])
                kinds = np.repeat(np.diff(edge), np.diff(edge))
                k, kinds = k[kinds > 1], kinds[kinds > 1]
                at, least, most = found["at"][k].astype(np.int64), least[k], most[k]
                yield _span_batch(found["id"][k], at - most | most << 40, at - least + length, np.where(kinds > hot, _WANTED_HOT, _WANTED))

    first = store(packets.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(settle), _SPANS))
    wanted = first.where(F.col("what") != _SETTLED)
    asked = store(wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "what")).alias("asked")))
    ids = few_keys(asked, "doc")

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(picked(batches, 0, ids))

    packed = rows.where("doc is not null").mapInArrow(tidy(pack_texts), "doc long, size long, packed binary")
    whole = packed.join(asked.hint("merge"), "doc")
    wide = reach + length

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each wanted sample with its surroundings: reach bytes before it, nearest first, and length bytes from it on, filled up with zeros."""
        for part in _unpacked(batches, 1 << 20):
            data, off = utf8(part.column(1))
            asked = part.column(2)
            many = np.diff(asked.offsets.to_numpy()) if len(asked) else np.zeros(0, np.int64)
            flat = asked.flatten()
            start, stop, what = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            text = np.repeat(np.arange(len(many)), many)
            base = off[text]
            before, start = start >> 40, start & ((1 << 40) - 1)
            at = start + before
            span = stop - length - start
            inside = stop <= np.diff(off)[text]
            text, base, before, start, at, span, stop, what = (x[inside] for x in (text, base, before, start, at, span, stop, what))
            ids = part.column(0).to_numpy()[text]
            for lo in range(0, len(at), 10_000):
                s = slice(lo, lo + 10_000)
                left = np.arange(1, reach + 1)
                right = np.arange(length)
                a = (base[s] + at[s])[:, None]
                size = stop[s] - at[s]
                rows_ = np.zeros((len(at[s]), wide), np.uint8)
                rows_[:, :reach] = np.where(left <= before[s][:, None], data[np.maximum(a - left, 0)], 0)
                rows_[:, reach:] = np.where(right < size[:, None], data[np.minimum(a + right, len(data) - 1)], 0)
                # grouped by the bytes that all strings of near or far offsets hold
                hashes, row = Hashes(rows_.ravel()), np.arange(len(rows_)) * wide
                far = (before - span)[s] > half
                cores = np.where(far, mix(hashes.of(row, row + half + 1)) ^ hashes.of(row + reach, row + reach + gram), hashes.of(row + reach, row + wide - half))
                hot_ = what[s] == _WANTED_HOT
                out = [(cores[~hot_], ids[s][~hot_], at[s][~hot_], (before - span)[s][~hot_], before[s][~hot_], rows_[~hot_])]
                # strings of hot cores become samples of one offset each, grouped by their own hash; of equal ones here only the earliest goes on, the others are settled
                least, most = np.full(len(hot_), -1), np.full(len(hot_), -1)
                for offset in range(reach + 1) if hot_.any() else ():
                    k = np.flatnonzero(hot_ & ((before - span)[s] <= offset) & (offset <= before[s]))
                    if len(k):
                        own = rows_[k].copy()
                        own[:, offset:reach] = 0
                        own[:, reach + length - offset :] = 0
                        h = Hashes(own.ravel()).of(np.arange(len(k)) * wide, np.arange(len(k)) * wide + wide) + U(offset)
                        order = np.lexsort((at[s][k], ids[s][k], h))
                        k, own, h = k[order], own[order], h[order]
                        again = np.zeros(len(k), bool)
                        again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1]).all(1) & ((ids[s][k][1:] != ids[s][k][:-1]) | (at[s][k][1:] != at[s][k][:-1]))
                        hit = k[again]
                        least[hit], most[hit] = np.where(least[hit] < 0, offset, least[hit]), offset
                        k, own, h = k[~again], own[~again], h[~again]
                        out.append((h, ids[s][k], at[s][k], np.full(len(k), offset), np.full(len(k), offset), own))
                hit = np.flatnonzero(most >= 0)
                out.append((cores[hit], ids[s][hit], at[s][hit], least[hit], most[hit], None))
                for found in out:
                    if len(found[0]):
                        yield travelling(*found)

    def travelling(g: np.ndarray, doc: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
        """Samples on the way to their group; without bytes, those whose strings from offset low to high are settled."""
        bucket = (mix(g if own is not None else doc.astype(U)) % U(groups)).astype(np.int64)
        blob = pa.nulls(len(g), pa.binary()) if own is None else pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(g), [None, pa.py_buffer(np.ascontiguousarray(own))]).cast(pa.binary())
        columns = [pa.array(bucket), pa.array(g.astype(np.int64)), pa.array(doc), pa.array(pos), *(pa.array(x.astype(np.int32)) for x in (low, high)), blob]
        return pa.record_batch(columns, ["bucket", "gram", "doc", "at", "low", "high", "bytes"])

    fetched = whole.select("doc", "size", "packed", "asked").mapInArrow(tidy(fetch), "bucket long, gram long, doc long, at long, low int, high int, bytes binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 1):
            done = pc.is_null(table.column("bytes"))
            if pc.any(done).as_py():
                settled = table.filter(done)
                doc, at, low, high = (settled.column(i).to_numpy() for i in range(2, 6))
                yield _span_batch(doc, at - high, at - low + length, np.full(len(doc), _SETTLED))
                table = table.filter(pc.invert(done))
            gram_, doc, at, low, high = (table.column(i).to_numpy() for i in range(1, 6))
            order = np.lexsort((at, doc, gram_))
            edge = bounds(gram_[order])
            cuts = [0]  # whole grams, some 60,000 samples at once
            for e in edge[1:].tolist():
                if e - cuts[-1] > 60_000 or e == len(order):
                    cuts.append(e)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = order[lo:hi]
                matrix = np.frombuffer(b"".join(table.column(6).take(pa.array(own)).to_pylist()), np.uint8).reshape(-1, wide)
                group = np.cumsum(np.diff(gram_[own], prepend=gram_[own][:1]) != 0)
                least, most = repeated_offsets(group, matrix[:, :reach], matrix[:, reach:], low[own].astype(np.int64), high[own].astype(np.int64), length)
                hit = most >= 0
                yield _span_batch(doc[own][hit], (at[own] - most)[hit], (at[own] - least)[hit] + length, np.full(int(hit.sum()), _SETTLED))

    compared = fetched.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(compare), _SPANS)
    spans = first.where(F.col("what") == _SETTLED).unionByName(compared)
    by_doc = spans.groupBy("doc").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    return by_doc.mapInArrow(tidy(_merged), "doc long, spans array<struct<start: long, stop: long>>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's overlapping or touching spans as one."""
    for batch in batches:
        many = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(many)), many)
        start, stop = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
        order = np.lexsort((start, text))
        text, start, stop = text[order], start[order], stop[order]
        wide = int(stop.max(initial=0)) + 1
        reached = np.maximum.accumulate(stop + text * wide) if len(stop) else stop
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] + text[1:] * wide > reached[:-1])
        begin = np.flatnonzero(new)
        end = reached[np.append(begin[1:], len(text)) - 1] - text[begin] * wide if len(text) else stop
        offsets = np.searchsorted(text[begin], np.arange(batch.num_rows + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start[begin]), pa.array(end)], ["start", "stop"])
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["doc", "spans"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts under Zstandard, for the way through a shuffle."""
    for batch in batches:
        blobs = [pa.compress(t.as_buffer(), "zstd", asbytes=True) if t.is_valid else None for t in batch.column(1)]
        sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(batch.column(1).to_numpy())
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            part = batch.slice(at, end - at)
            texts = [pa.decompress(b.as_buffer(), n, "zstd", asbytes=True) if b.is_valid else None for n, b in zip(part.column(1).to_pylist(), part.column(2), strict=True)]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.binary()), part.column(3)], ["doc", "_text", "asked"])
            at = end


def _left(own: np.ndarray, spans: pa.Scalar) -> tuple[int, int, bytes]:
    """Removed bytes, runs of them, and what is left of a text under its spans."""
    if not spans.is_valid or not len(spans.values):
        return 0, 0, own.tobytes()
    start, stop = (spans.values.field(k).to_numpy() for k in (0, 1))
    step = np.zeros(len(own) + 1, np.int32)
    np.add.at(step, np.minimum(start, len(own)), 1)
    np.add.at(step, np.minimum(stop, len(own)), -1)
    gone = np.cumsum(step[:-1]) > 0
    return int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), own[~gone].tobytes()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with as_text the text is what is left, else it is dropped.

    Removes each byte that a string of `length` bytes covers which also starts earlier (repeated_spans); strings are judged on the
    input. A null text counts as empty, and comes out empty; a row without an id stays whole. Where a run ends within a character, its torn bytes
    go too, from the text but not from kept_sha256. Columns of docs named like the new ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    by_doc = store(repeated_spans(docs, id_col, text_col, length).withColumnRenamed("spans", "__sl_spans"))
    size = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("__sl_spans"))).first()
    names = [c for c in docs.columns if c not in new and c != text_col]
    rows = docs.select(*names, F.col(id_col).cast("long").alias("__sl_doc"), F.col(text_col).alias("__sl_text"))
    spans = by_doc.withColumnRenamed("doc", "__sl_doc")
    entries = max(size[0], size[1] or 0)
    ids = None if is_small(entries, 32) else few_keys(by_doc, "doc")
    if ids is not None:  # texts without a span need not move
        at, kind = len(names), rows.schema
        moved = rows.where("__sl_doc is not null").mapInArrow(tidy(lambda batches: picked(batches, at, ids)), kind)
        joined = moved.join(spans, "__sl_doc").select(*names, "__sl_text", "__sl_spans")
    else:
        joined = rows.join(broadcast_if_small(spans, entries, 32), "__sl_doc", "left").select(*names, "__sl_text", "__sl_spans")
    out = [*docs.select(*names).columns, *new, *[text_col] * as_text]
    schema = docs.select(*names).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema = schema.add(text_col, "string") if as_text else schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__sl_text"):
                data, off = utf8(part.column(len(names)))
                found = [_left(data[a:b], s) for a, b, s in zip(off[:-1].tolist(), off[1:].tolist(), part.column(len(names) + 1), strict=True)]
                columns = [*(part.column(i) for i in range(len(names))), pa.array(np.diff(off)), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))]
                columns.append(pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string()))
                if as_text:
                    columns.append(pa.array([f[2].decode("utf-8", "ignore") for f in found], pa.string()))
                yield pa.record_batch(columns, out)

    if ids is None:
        return joined.mapInArrow(tidy(remove), schema)
    still = rows.withColumn("__sl_spans", F.lit(None).cast(spans.schema["__sl_spans"].dataType))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in picked(batches, at, ids, inside=False):
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], [*names, "__sl_text", "__sl_spans"])

    return joined.mapInArrow(tidy(remove), schema).unionByName(still.mapInArrow(tidy(lambda batches: remove(stay(batches))), schema))
