"""A lossless archive of reads: blocks that are coded, checked and decoded independently of each other.

A block has four streams: identifiers (shapes and columns of numbers), bases, qualities (runs) and the rest (lengths, runs of other letters, plus lines).
Symbols are coded by interleaved range asymmetric numeral systems in integer arithmetic, so that every machine decodes alike; the lanes of a stream advance together as
one NumPy vector. A stream's model is its own counts in the context of the symbols before, shared out by largest remainder; bases have an adaptive model
to choose (mode "adaptive": smaller and some fifty times slower). FASTA records are reads without qualities, long ones cut into pieces.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive

BITS = 12
TOTAL = 1 << BITS
_LOW = 1 << 16
MAGIC = b"SLK2"


def write_varint(out: bytearray, v: int) -> None:
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


class Reader:
    """A cursor over bytes that never reads past the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the block ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        v = shift = 0
        while True:
            b = self.take(1)[0]
            v |= (b & 127) << shift
            if b < 128:
                return v
            shift += 7
            if shift > 63:
                raise ValueError("a number is too long")


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def unzigzag(z: int) -> int:
    return z >> 1 if not z & 1 else -(z + 1 >> 1)


def shares(counts: np.ndarray, target: int = TOTAL) -> np.ndarray:
    """Counts as integer shares that sum to target, by largest remainder; every count over zero gets one at least. At most `target` symbols."""
    n = counts.astype(np.int64)
    if not n.sum():  # nothing counted: symbol i gets what lies between floor(i * target / N) and the next
        return np.diff(np.arange(len(n) + 1) * target // len(n))
    p = n * target // n.sum()
    frac = n * target % n.sum()
    lifted = (n > 0) & (p == 0)
    p[lifted], frac[lifted] = 1, 0
    while (rest := target - int(p.sum())) != 0:
        order = np.lexsort((np.arange(len(n)), -frac if rest > 0 else frac))
        order = order[(n[order] > 0) if rest > 0 else (p[order] > 1)]
        p[order[: abs(rest)]] += 1 if rest > 0 else -1
    return p


#: Rows of shares that a stream's model has at most.
MOST_ROWS = 4096
#: Lanes that a stream has at most.
LANES = 1024


def _lane_grid(values: np.ndarray, lanes: int) -> np.ndarray:
    """Values dealt to lanes as successive stretches: a row a step, filled up with zeros."""
    steps = -(-len(values) // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(values)] = values
    return grid.reshape(lanes, steps).T


def _levels(order: int, sides: int) -> list[int]:
    """Levels of context above none, by how many symbols before they hold: with sides the side alone, then 1 to `order` symbols beside it."""
    return list(range(0 if sides > 1 else 1, order + 1))


def _parents(size: int, sides: int, symbols: int) -> np.ndarray:
    """For each context of a level the one a symbol shorter."""
    own = np.arange(size**symbols * sides)
    return (own // sides) % size ** (symbols - 1) * sides + own % sides if symbols else own * 0


def _rows_by_context(size: int, order: int, sides: int, sent: list[np.ndarray]) -> np.ndarray:
    """The row of shares of each full context: that of the longest of its endings that was sent. Row 0 has no context; rows follow in order of level and context."""
    row, base = np.zeros(1, np.int64), 1
    for symbols, chosen in zip(_levels(order, sides), sent, strict=True):
        row = row[_parents(size, sides, symbols)]
        row[chosen] = base + np.arange(len(chosen))
        base += len(chosen)
    return row


def encode_symbols(symbols: np.ndarray, size: int, order: int, side: np.ndarray | None = None, sides: int = 1, gates: tuple[int, ...] = (8, 16, 16)) -> bytes:
    """Symbols below `size` in the context of the `order` before them in their lane and, with sides, of a number below `sides` that the decoder knows of each.

    A context is sent if its total reaches its level's gate (the last gate for further levels) and its shares save more than they cost; others use their shorter ending's.
    """
    out = bytearray()
    n = len(symbols)
    write_varint(out, n)
    if not n:
        return bytes(out)
    while order > 1 and size**order * sides * size > 1 << 22:
        order -= 1
    lanes = int(min(LANES, max(1, n // 512)))
    grid = _lane_grid(symbols, lanes)
    beside = _lane_grid(side if side is not None else np.zeros(n, np.int64), lanes)
    steps = len(grid)
    history = np.zeros((steps, lanes), np.int64)
    for t in range(1, steps if order else 0):
        history[t] = (history[t - 1] * size + grid[t - 1]) % size**order
    flat = grid.ravel()
    sent: list[np.ndarray] = []
    before = np.bincount(flat, minlength=size)[None]
    for level, longer in enumerate(_levels(order, sides)):
        ctx = (history % size**longer * sides + beside).ravel()
        counts = np.bincount(ctx * size + flat, minlength=size**longer * sides * size).reshape(-1, size)
        total = counts.sum(1)
        above = before[_parents(size, sides, longer)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(counts > 0, counts * np.log2(counts / np.maximum(total, 1)[:, None] * above.sum(1)[:, None] / np.maximum(above, 1)), 0).sum(1)
        worth = (total >= gates[min(level, len(gates) - 1)]) & (gain > 14 * (counts > 0).sum(1) + 8)
        chosen = np.flatnonzero(worth)
        room = MOST_ROWS - 1 - sum(map(len, sent))
        if len(chosen) > room:
            chosen = np.sort(chosen[np.argsort(-gain[chosen], kind="stable")[:room]])
        sent.append(chosen)
        before = np.where(worth[:, None] & np.isin(np.arange(len(total)), chosen)[:, None], counts, above)
    row = _rows_by_context(size, order, sides, sent)
    at = row[history * sides + beside]
    counts = np.bincount(at.ravel() * size + flat, minlength=(1 + sum(map(len, sent))) * size).reshape(-1, size)
    for v in (size, order, sides, lanes):
        write_varint(out, v)
    for chosen in sent:
        write_varint(out, len(chosen))
        for gap in np.diff(chosen, prepend=0).tolist():
            write_varint(out, gap)
    freq = np.zeros_like(counts)
    for i in range(len(counts)):
        if counts[i].any():
            freq[i] = shares(counts[i])
        some = np.flatnonzero(freq[i]).tolist()
        write_varint(out, len(some))
        last = 0
        for s in some:
            write_varint(out, s - last)
            write_varint(out, int(freq[i, s]))
            last = s
    cum = np.cumsum(freq, 1) - freq
    state = np.full(lanes, _LOW, np.int64)
    words: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        f, c = freq[at[t], grid[t]], cum[at[t], grid[t]]
        full = state >= (f << (32 - BITS))
        if full.any():
            words.append((state[full] & 0xFFFF).astype("<u2")[::-1])
            state = np.where(full, state >> 16, state)
        state = (state // f << BITS) + state % f + c
    out += state.astype("<u4").tobytes()
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u2")
    write_varint(out, len(stream))
    return bytes(out) + stream.tobytes()


def decode_symbols(r: Reader, side: np.ndarray | None = None) -> np.ndarray:
    n = r.varint()
    if not n:
        return np.zeros(0, np.int64)
    size, order, sides, lanes = (r.varint() for _ in range(4))
    if not 0 < lanes <= LANES or not 0 < size or size**order * sides * size > 1 << 24 or (side is None) != (sides == 1) or (side is not None and len(side) != n):
        raise ValueError("the block's model is out of range")
    sent = []
    for longer in _levels(order, sides):
        chosen = np.cumsum([r.varint() for _ in range(r.varint())]).astype(np.int64)
        if len(chosen) > MOST_ROWS or (len(chosen) and chosen[-1] >= size**longer * sides):
            raise ValueError("the block's model is out of range")
        sent.append(chosen)
    row = _rows_by_context(size, order, sides, sent)
    freq = np.zeros((1 + sum(map(len, sent)), size), np.int64)
    for i in range(len(freq)):
        s = 0
        for _ in range(r.varint()):
            s += r.varint()
            freq[i, s] = r.varint()
    cum = np.cumsum(freq, 1) - freq
    symbol = np.zeros((len(freq), TOTAL), np.int16 if size < 1 << 15 else np.int32)
    for c in np.flatnonzero(freq.sum(1) == TOTAL).tolist():
        symbol[c] = np.repeat(np.arange(size), freq[c])
    steps = -(-n // lanes)
    beside = _lane_grid(side if side is not None else np.zeros(n, np.int64), lanes)
    state = np.frombuffer(r.take(4 * lanes), "<u4").astype(np.int64)
    stream = np.frombuffer(r.take(2 * r.varint()), "<u2").astype(np.int64)
    grid = np.zeros((steps, lanes), np.int64)
    ctx = np.zeros(lanes, np.int64)
    at = 0
    for t in range(steps):
        slot = state & (TOTAL - 1)
        own = row[ctx * sides + beside[t]]
        s = symbol[own, slot].astype(np.int64)
        state = freq[own, s] * (state >> BITS) + slot - cum[own, s]
        low = state < _LOW
        k = int(low.sum())
        if k:
            state[low] = state[low] << 16 | stream[at : at + k]
            at += k
        grid[t] = s
        ctx = (ctx * size + s) % size**order if order else ctx
    return grid.T.ravel()[:n]


def _text_stream(lines: list[str], order: int) -> bytes:
    if any("\n" in x for x in lines):
        raise ValueError("a line holds a line break")
    raw = "\n".join(lines).encode("utf-8", "surrogateescape")
    data = np.frombuffer(raw, np.uint8)
    known = np.unique(data)
    out = bytearray()
    write_varint(out, len(known))
    out += known.tobytes()
    return bytes(out) + encode_symbols(np.searchsorted(known, data), max(1, len(known)), order)


def _read_text(r: Reader, count: int) -> list[str]:
    known = np.frombuffer(r.take(r.varint()), np.uint8)
    symbols = decode_symbols(r)
    lines = (known[symbols].tobytes() if len(symbols) else b"").decode("utf-8", "surrogateescape").split("\n")
    if count and len(lines) != count:
        raise ValueError("a stream has another number of records")
    return lines if count else []


def _write_numbers(out: bytearray, values: Iterable[int]) -> None:
    """Signed numbers as varints, whose bytes are coded if that is shorter."""
    raw = bytearray()
    for v in values:
        write_varint(raw, zigzag(v))
    coded = encode_symbols(np.frombuffer(bytes(raw), np.uint8).astype(np.int64), 256, 1) if len(raw) > 32 else raw
    out.append(len(coded) < len(raw))
    out += coded if len(coded) < len(raw) else raw


def _read_numbers(r: Reader, count: int) -> list[int]:
    if not r.take(1)[0]:
        return [unzigzag(r.varint()) for _ in range(count)]
    raw = Reader(decode_symbols(r).astype(np.uint8).tobytes())
    return [unzigzag(raw.varint()) for _ in range(count)]


_NUMBER = re.compile(r"[0-9]{1,18}(?![0-9])|[0-9]{19,}|[^0-9]+")
_RAW, _TOKENS, _PLAIN = 0, 1, 2


def _shape(identifier: str) -> tuple[str, list[int]]:
    """The identifier with its numbers (18 digits at most) taken out, and the numbers. Widths of numbers with leading zeros stay in the shape."""
    shape, numbers = [], []
    for token in _NUMBER.findall(identifier):
        if token[0].isascii() and token[0].isdigit() and len(token) <= 18:
            numbers.append(int(token))
            shape.append(f"\x01{len(token) if token[0] == '0' and len(token) > 1 else 0}\x02")
        else:
            shape.append(token)
    return "".join(shape), numbers


def _fill(shape: str, numbers: list[int]) -> str:
    given = iter(numbers)
    return re.sub("\x01([0-9]+)\x02", lambda m: str(next(given)).zfill(int(m[1])), shape)


def encode_identifiers(identifiers: list[str]) -> bytes:
    """By shapes and columns of numbers, each as it is or as differences from the identifier before of that shape, whichever is smaller; as text if shapes are many, plain if that
    is shorter."""
    coded = _encode_identifiers(identifiers)
    plain = "\n".join(identifiers).encode("utf-8", "surrogateescape")
    return coded if len(coded) <= len(plain) + 1 else bytes([_PLAIN]) + plain


def _encode_identifiers(identifiers: list[str]) -> bytes:
    found = [_shape(x) for x in identifiers]
    shapes = sorted({x for x, _ in found})
    if any(c in x for x in identifiers for c in "\x01\x02") or len(shapes) > max(4, len(identifiers) // 4) or len(shapes) > 4096:
        return bytes([_RAW]) + _text_stream(identifiers, 2)
    out = bytearray([_TOKENS])
    write_varint(out, len(shapes))
    out += _text_stream(shapes, 1)
    place = {x: i for i, x in enumerate(shapes)}
    kinds = np.array([place[x] for x, _ in found], np.int64)
    out += encode_symbols(kinds, max(1, len(shapes)), 1)
    for i in range(len(shapes)):
        columns = np.array([numbers for (_, numbers), k in zip(found, kinds.tolist(), strict=True) if k == i], np.int64)
        for values in columns.T:
            plain, deltas = bytearray(), bytearray()
            _write_numbers(plain, values.tolist())
            _write_numbers(deltas, np.diff(values, prepend=0).tolist())
            out.append(len(deltas) < len(plain))
            out += min(deltas, plain, key=len) if len(deltas) != len(plain) else plain
    return bytes(out)


def decode_identifiers(data: bytes, count: int) -> list[str]:
    r = Reader(data)
    kind = r.take(1)[0]
    if kind == _PLAIN:
        lines = data[1:].decode("utf-8", "surrogateescape").split("\n") if count else []
        if len(lines) != count:
            raise ValueError("a stream has another number of records")
        return lines
    if kind == _RAW:
        return _read_text(r, count)
    shapes = _read_text(r, r.varint())
    kinds = decode_symbols(r)
    if len(kinds) != count:
        raise ValueError("a stream has another number of records")
    rows = []
    for i, shape in enumerate(shapes):
        n, columns = int((kinds == i).sum()), []
        for _ in range(shape.count("\x01")):
            differences = r.take(1)[0]
            values = _read_numbers(r, n)
            columns.append(list(itertools.accumulate(values)) if differences else values)
        rows.append(iter([_fill(shape, list(x)) for x in zip(*columns, strict=True)] if columns else [shape] * n))
    return [next(rows[k]) for k in kinds.tolist()]


#: Runs longer than this go on in further symbols.
_LONGEST = 31


def _run_places(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The eighth of its read in which each run begins, from the runs' lengths and the reads'."""
    start = np.cumsum(lengths) - lengths
    ends = np.cumsum(sizes)
    read = np.searchsorted(ends, start, "right")
    size = np.maximum(1, sizes[read]) if len(read) else read
    return np.minimum(7, (start - (ends[read] - sizes[read])) * 8 // size) if len(read) else start


def encode_qualities(qual: list[str]) -> bytes:
    """Runs of equal scores within reads: lengths after the lengths before, then symbols after the two before and their place in the read. Text beyond ASCII stays text."""
    whole = "".join(qual)
    if not whole.isascii() or "\n" in whole:
        return bytes([_RAW]) + _text_stream(["".join(qual)], 1)
    raw = np.frombuffer(whole.encode(), np.uint8)
    sizes = np.array([len(q) for q in qual], np.int64)
    known, symbols = np.unique(raw, return_inverse=True)
    first = np.zeros(len(raw) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    first[1:-1] |= raw[1:] != raw[:-1] if len(raw) else False
    begin = np.flatnonzero(first[: len(raw)])
    lengths = np.diff(np.append(begin, len(raw)))
    out = bytearray([_TOKENS])
    write_varint(out, len(known))
    out += known.tobytes()
    write_varint(out, len(begin))
    more = (lengths - 1) // _LONGEST
    pieces = np.full(int((more + 1).sum()), _LONGEST)
    pieces[np.cumsum(more + 1) - 1] = (lengths - 1) % _LONGEST
    out += encode_symbols(pieces, _LONGEST + 1, 1)
    out += encode_symbols(symbols[begin], max(1, len(known)), 2, _run_places(lengths, sizes), 8)
    return bytes(out)


def decode_qualities(data: bytes, sizes: list[int]) -> list[str]:
    r = Reader(data)
    if r.take(1)[0] == _RAW:
        whole = _read_text(r, 1)[0]
    else:
        known = np.frombuffer(r.take(r.varint()), np.uint8)
        count = r.varint()
        pieces = decode_symbols(r)
        last = np.flatnonzero(pieces < _LONGEST)
        lengths = np.diff(np.cumsum(pieces)[last], prepend=0) + 1
        if len(lengths) != count or lengths.sum() != sum(sizes):
            raise ValueError("the runs don't fit the reads")
        symbols = decode_symbols(r, _run_places(lengths, np.array(sizes, np.int64)))
        whole = np.repeat(known[symbols], lengths).tobytes().decode() if count else ""
    return _split(whole, sizes)


def _split(whole: str, sizes: list[int]) -> list[str]:
    ends = np.cumsum([0, *sizes]).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_PACKED, _STATIC, _ADAPTIVE = 0, 1, 2
MODES = ("static", "adaptive")
#: Bases up to which two bits each are the shortest.
SHORT = 64


def encode_bases(codes: np.ndarray, mode: str, order: int) -> bytes:
    """Bases 0 to 3, after their kind and number: two bits each if they are few, else under the block's counts or the adaptive model."""
    out = bytearray([_PACKED if len(codes) <= SHORT else 1 + MODES.index(mode)])
    write_varint(out, len(codes))
    if out[0] == _PACKED:
        quads = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
        quads[: len(codes)] = codes
        return bytes(out) + (quads.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8).tobytes()
    return bytes(out) + (encode_symbols(codes, 4, order) if out[0] == _STATIC else adaptive.encode_bases(codes))


def decode_bases(data: bytes) -> np.ndarray:
    r = Reader(data)
    kind, n = r.take(1)[0], r.varint()
    if kind == _PACKED:
        quads = np.frombuffer(r.take(-(-n // 4)), np.uint8)
        return (quads[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()[:n].astype(np.int64)
    codes = decode_symbols(r) if kind == _STATIC else adaptive.decode_bases(data[r.at :], n) if kind == _ADAPTIVE else np.zeros(0)
    if len(codes) != n:
        raise ValueError("a stream has another number of bases")
    return codes


def encode_block(identifier: list[str], seq: list[str], qual: list[str], plus: list[str], mode: str = "static", order: int = 8) -> tuple[bytes, bytes, bytes, bytes]:
    """The four streams of a block. Bases keep their letters; anything else than A, C, G, T is a run in the fourth stream, with its letter."""
    meta = bytearray()
    write_varint(meta, len(seq))
    sizes = [[len(x) for x in column] for column in (seq, qual)]
    meta.append(sizes[0] != sizes[1])
    for column in sizes[: 1 + (sizes[0] != sizes[1])]:
        _write_numbers(meta, np.diff(np.array(column, np.int64), prepend=0).tolist())
    some = [bool(p) for p in plus]
    write_varint(meta, int(any(some)))
    if any(some):
        meta += np.packbits(some).tobytes()
        texts = _text_stream([p for p in plus if p], 1)
        meta += texts
    raw = np.frombuffer("".join(seq).encode("utf-32-le"), "<u4")
    code = np.full(256, 4)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    codes = np.where(raw < 256, code[np.minimum(raw, 255)], 4)
    odd = np.flatnonzero(codes == 4)
    first = odd[np.concatenate([[True], (np.diff(odd) != 1) | (raw[odd[1:]] != raw[odd[:-1]])])] if len(odd) else odd
    ends = np.append(np.searchsorted(odd, first)[1:], len(odd)) if len(odd) else odd
    write_varint(meta, len(first))
    size = np.diff(ends, prepend=0)
    letters, which = np.unique(raw[first], return_inverse=True)
    _write_numbers(meta, (first - np.concatenate([[0], (first + size)[:-1]])[: len(first)]).tolist())
    _write_numbers(meta, size.tolist())
    write_varint(meta, len(letters))
    for letter in letters.tolist():
        write_varint(meta, letter)
    if len(letters) > 1:
        meta += encode_symbols(which, len(letters), 1)
    return encode_identifiers(identifier), encode_bases(codes[codes < 4], mode, order), encode_qualities(qual), bytes(meta)


def decode_block(identifiers: bytes, bases: bytes, qualities: bytes, meta: bytes) -> tuple[list[str], list[str], list[str], list[str]]:
    r = Reader(meta)
    n = r.varint()
    apart = r.take(1)[0]
    lengths = [list(itertools.accumulate(_read_numbers(r, n))) for _ in range(1 + apart)]
    lengths = lengths if apart else lengths * 2
    plus = [""] * n
    if r.varint():
        some = np.unpackbits(np.frombuffer(r.take(-(-n // 8)), np.uint8))[:n]
        texts = iter(_read_text(r, int(some.sum())))
        plus = [next(texts) if s else "" for s in some.tolist()]
    text = np.zeros(sum(lengths[0]), "<u4")
    free = np.ones(len(text), bool)
    count = r.varint()
    gaps, sizes = np.array(_read_numbers(r, count), np.int64), np.array(_read_numbers(r, count), np.int64)
    letters = np.array([r.varint() for _ in range(r.varint())], np.int64)
    which = decode_symbols(r) if len(letters) > 1 else np.zeros(count, np.int64)
    start = np.cumsum(gaps) + np.cumsum(sizes) - sizes
    places = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    if len(which) != count or (len(places) and (places.min() < 0 or places.max() >= len(text))):
        raise ValueError("the runs don't fit the sequences")
    text[places] = np.repeat(letters[which], sizes) if count else 0
    free[places] = False
    codes = decode_bases(bases)
    if len(codes) != free.sum():
        raise ValueError("a stream has another number of bases")
    text[free] = np.frombuffer(b"ACGT", np.uint8)[codes]
    return decode_identifiers(identifiers, n), _split(text.tobytes().decode("utf-32-le"), lengths[0]), decode_qualities(qualities, lengths[1]), plus


_STREAMS = ("identifiers", "bases_stream", "qualities", "meta")
ARCHIVE = "block_id bigint, records bigint, pieces bigint, bases bigint, text_bytes bigint, magic binary, record_nos binary, identifiers binary, bases_stream binary, qualities binary, meta binary, crc bigint"


_NAMES = [x.split()[0] for x in ARCHIVE.split(", ")]
_KINDS = {x.split()[0]: {"bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in ARCHIVE.split(", ")}


@dataclass(frozen=True)
class Options:
    """How blocks are coded. order: bases before a base that its static context holds; block_size: records of a block; block_bases: bases that close it."""

    mode: str = "static"
    order: int = 8
    block_size: int = 10_000
    block_bases: int = 2_000_000

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 2 <= self.order <= 20:
            raise ValueError("order must be from 2 to 20")
        if not 100 <= self.block_size <= 1_000_000:
            raise ValueError("block size must be from 100 to 1000000")
        if self.block_bases < 1:
            raise ValueError("a block must hold a base")


def _archive_row(block: int, numbers: np.ndarray, columns: list[list[str]], options: Options) -> pa.RecordBatch:
    """A block as a row; numbers are the records' and, from 2**40 on, their piece, with 2**62 for those of cut records."""
    streams = encode_block(*columns, options.mode, min(options.order, 8))
    coded = np.diff(numbers, prepend=0).astype("<i8").tobytes()
    size = sum(len(x) for c in columns for x in c) + 6 * len(columns[0])
    crc = zlib.crc32(coded + b"".join(streams))
    values = [block, len(columns[0]), int((numbers >> 62).sum()), sum(map(len, columns[1])), size, MAGIC, zlib.compress(coded), *streams, crc]
    return pa.record_batch([pa.array([v], _KINDS[k]) for v, k in zip(values, _NAMES, strict=True)], _NAMES)


def _blocks_of(batches: Iterable[pa.RecordBatch], options: Options, piece: int) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
    """Records as they come, in blocks: one ends when either limit is reached. Sequences longer than `piece` go on as records of their own (piece 1, 2, ...)."""
    numbers: list[int] = []
    columns: list[list[str]] = [[], [], [], []]
    bases = 0
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        for r, *row in zip(*lists, strict=True):
            name, seq, qual, plus = (x or "" for x in row)
            for i in range(max(1, -(-len(seq) // piece))):
                cut = slice(i * piece, (i + 1) * piece)
                numbers.append(r | i << 40 | (len(seq) > piece) << 62)
                for c, x in zip(columns, ("" if i else name, seq[cut], qual[cut] if len(qual) == len(seq) else "" if i else qual, "" if i else plus), strict=True):
                    c.append(x)
                bases += len(columns[1][-1])
                if len(numbers) >= options.block_size or bases >= options.block_bases:
                    yield np.array(numbers, np.int64), columns
                    numbers, columns, bases = [], [[], [], [], []], 0
    if numbers:
        yield np.array(numbers, np.int64), columns


def encode_blocks(reads: DataFrame, record: str = "record_no", block: str = "block_id", options: Options = Options()) -> DataFrame:
    """One row a given block, ready for Parquet: its counts, four streams and a checksum. Within a block records keep the order of `record`, a whole number below 2**40."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        columns = [[x or "" for x in table.column(c).to_pylist()] for c in ("identifier", "seq", "qual", "plus_line")]
        return pa.Table.from_batches([_archive_row(table.column("b")[0].as_py(), table.column("r").to_numpy(), columns, options)])

    rows = reads.select(F.col(block).cast("bigint").alias("b"), F.col(record).cast("bigint").alias("r"), "identifier", "seq", "qual", "plus_line")
    return rows.groupBy("b").applyInArrow(run, ARCHIVE)


def archive(reads: DataFrame, record: str = "record_no", options: Options = Options(), piece: int = 1 << 20) -> DataFrame:
    """reads (record, identifier, seq, qual, plus_line) as an archive, block by block where the rows lie: nothing is shuffled, and a task holds one block.

    A block ends under both limits of the options, and at its partition's end. Long sequences are cut into pieces of `piece` bases, so that none is ever coded whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, columns in _blocks_of(batches, options, piece):
            yield _archive_row(int(numbers[0]), numbers, columns, options)

    return reads.select(F.col(record).cast("bigint").alias("r"), "identifier", "seq", "qual", "plus_line").mapInArrow(run, ARCHIVE)


def archive_fasta(records: DataFrame, options: Options = Options(), piece: int = 1 << 20) -> DataFrame:
    """FASTA records (record_no, header, sequence with its own letters) as an archive."""
    empty = F.lit("")
    return archive(records.select("record_no", F.col("header").alias("identifier"), F.col("sequence").alias("seq"), empty.alias("qual"), empty.alias("plus_line")), options=options, piece=piece)


def _checked(row: dict) -> bytes:
    numbers = zlib.decompress(row["record_nos"])
    if row["magic"] != MAGIC or zlib.crc32(numbers + b"".join(row[s] for s in _STREAMS)) != row["crc"]:
        raise ValueError(f"block {row['block_id']} is damaged")
    return numbers


def decode_blocks(archive: DataFrame, record: str = "record_no", cut: bool = True) -> DataFrame:
    """The reads of an archive; a block whose magic or checksum is wrong is an error.

    Records that were cut into pieces are put together again: only blocks with pieces are shuffled. Without `cut`, records in pieces are an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = np.cumsum(np.frombuffer(_checked(row), "<i8"))
                columns = decode_block(*(row[s] for s in _STREAMS))
                yield pa.record_batch([pa.array(numbers), *(pa.array(c, pa.string()) for c in columns)], ["number", "identifier", "seq", "qual", "plus_line"])

    names = ["identifier", "seq", "qual", "plus_line"]
    kind = "number bigint, identifier string, seq string, qual string, plus_line string"
    number = F.col("number").bitwiseAND(F.lit((1 << 40) - 1)).alias(record)
    if not cut:
        whole = F.when(F.col("number") >= F.lit(1 << 62), F.raise_error(F.lit("a record is in pieces")).cast("bigint")).otherwise(number).alias(record)
        return archive.mapInArrow(run, kind).select(whole, *names)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.shiftright("number", 40).alias("piece"), c))), lambda x: x[c]), "")
    pieces = archive.where("pieces > 0").mapInArrow(run, kind).groupBy(number).agg(*[joined(c).alias(c) for c in names])
    return archive.where("pieces = 0").mapInArrow(run, kind).select(number, *names).unionByName(pieces)


def decode_fasta(archive: DataFrame) -> DataFrame:
    """record_no, header and sequence, in which ambiguous letters stand again."""
    return decode_blocks(archive).select("record_no", F.col("identifier").alias("header"), F.col("seq").alias("sequence"))


def encode_record(header: str, sequence: str, options: Options = Options()) -> bytes:
    """A single record as bytes of its own: magic, sizes of the streams, the streams and their checksum. Empty and short sequences included."""
    streams = encode_block([header], [sequence], [""], [""], options.mode, min(options.order, 8))
    out = bytearray(MAGIC)
    for s in streams:
        write_varint(out, len(s))
    return bytes(out) + b"".join(streams) + zlib.crc32(b"".join(streams)).to_bytes(4, "little")


def decode_record(data: bytes) -> tuple[str, str]:
    """Header and sequence of encode_record's bytes; damage is an error."""
    r = Reader(data)
    if r.take(4) != MAGIC:
        raise ValueError("not a record")
    sizes = [r.varint() for _ in _STREAMS]
    streams = [r.take(n) for n in sizes]
    if zlib.crc32(b"".join(streams)).to_bytes(4, "little") != r.take(4):
        raise ValueError("the record is damaged")
    header, sequence, _, _ = decode_block(*streams)
    return header[0], sequence[0]


def archive_report(archive: DataFrame) -> DataFrame:
    """One row of totals, from the columns of sizes alone: bytes by stream, bits a base, a quality and an identifier's character, and the ratio to the text."""
    sums = archive.agg(F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("records"), F.sum("bases").alias("bases"), F.sum("text_bytes").alias("text_bytes"), *[F.sum(F.octet_length(s)).alias(f"{s}_bytes") for s in _STREAMS])
    packed = sum((F.col(f"{s}_bytes") for s in _STREAMS), F.lit(0))
    names = F.col("text_bytes") - 6 * F.col("records") - 2 * F.col("bases")
    bits = lambda s, n=F.col("bases"): F.when(n > 0, F.round(8.0 * F.col(f"{s}_bytes") / n, 4)).otherwise(0.0)
    return sums.withColumns({"bits_per_base": bits("bases_stream"), "bits_per_quality": bits("qualities"), "bits_per_identifier_char": bits("identifiers", names), "ratio": F.round(F.col("text_bytes") / F.nullif(packed, F.lit(0)), 4)})


def report_text(archive: DataFrame) -> str:
    """The report as lines of "name: value"."""
    return "\n".join(f"{k}: {v}" for k, v in archive_report(archive).first().asDict().items())


def write_archive(reads: DataFrame, path: str, record: str = "record_no", block: str | None = "block_id", options: Options = Options()) -> None:
    """With a column of blocks these are kept, else blocks are made where the rows lie."""
    rows = encode_blocks(reads, record, block, options) if block else archive(reads, record, options)
    rows.write.mode("errorifexists").parquet(path)


def read_archive(spark: SparkSession, path: str, record: str = "record_no") -> DataFrame:
    return decode_blocks(spark.read.parquet(path), record)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, length, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
