"""An adaptive model of bases for the block codec: many small predictors, mixed and calibrated symbol by symbol.

The lanes of a block advance together, so that a step is array work over lanes. Everything that a step learns comes from steps before it, and lanes share their
counts and their past; a lane may copy what another has coded. Arithmetic is integer counts and single IEEE operations in a fixed order, so that every machine
decodes alike. Predictors: counts after the last `order` bases, both strands pooled; counts after predicted rather than true bases; copies of earlier stretches, forward
and as reverse complements.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

U = np.uint64
BITS = 14
TOTAL = 1 << BITS
_LOW = 1 << 16
ORDERS = (1, 2, 3, 4, 6, 8, 10, 11, 12, 14, 16, 18)
#: Orders whose counts are also looked up after predicted bases.
TOLERANT = (11, 16)
#: Lengths of the anchors of copies, and those that also look for reverse complements.
ANCHORS, INVERTED = (24, 16, 12), (20, 12)


def forget(counts: np.ndarray, at: np.ndarray, limit: int) -> None:
    """Halves the counts of the rows `at` whose sum is over the limit."""
    at = np.unique(at)
    over = at[counts[at].sum(1) > limit]
    counts[over] >>= 1


def symmetric(p: np.ndarray, share: float = 0.05) -> np.ndarray:
    """Probabilities of A, C, G, T (rows) moved by `share` towards the mean of each base and its complement."""
    return p * (1 - share) + (p + p[::-1]) * (share / 2)


def quantised(p: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Integer shares of total, each 1 at least; the likeliest symbol (the first of equals) takes what is left over."""
    f = (p * (total - len(p))).astype(np.int64) + 1
    best = p.argmax(0)
    f[best, np.arange(p.shape[1])] += total - f.sum(0)
    return f


class Mixer:
    """Weighted means of distributions, a set of weights for each lane and context; weights follow how well each input foretold the symbols, and forget by `share`."""

    def __init__(self, inputs: int, lanes: int, contexts: int, share: float):
        self.w = np.full((contexts, lanes, inputs), 1.0 / inputs)
        self.lane, self.share, self.inputs = np.arange(lanes), share, inputs

    def mix(self, p: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        self.ctx, self.now = ctx, self.w[ctx, self.lane].T
        out = p[0] * self.now[0][None, :]
        for i in range(1, self.inputs):
            out += p[i] * self.now[i][None, :]
        return out

    def learn(self, hit: np.ndarray) -> None:
        """hit: what each input (rows) gave the symbol that came, in each lane."""
        w = self.now * hit
        total = w[0].copy()
        for i in range(1, self.inputs):
            total += w[i]
        self.w[self.ctx, self.lane] = (w / total * (1 - self.share) + self.share / self.inputs).T


class Calibration:
    """How often the first, second, ... likeliest symbol really came, by context and by the probability of the likeliest in `buckets`."""

    def __init__(self, contexts: int, buckets: int = 32):
        self.buckets = buckets
        middle = (np.arange(buckets) + 0.5) / buckets * 0.75 + 0.25
        prior = np.stack([middle, *[(1 - middle) / 3] * 3], 1)
        self.counts = np.repeat(np.maximum(1, (prior * 64).astype(np.int64))[None], contexts, 0)

    def refine(self, ranked: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        self.at = ctx, np.minimum(((ranked[0] - 0.25) * (self.buckets / 0.75)).astype(np.int64), self.buckets - 1).clip(0)
        c = self.counts[self.at]
        return (c / c.sum(1)[:, None]).T

    def learn(self, rank: np.ndarray) -> None:
        np.add.at(self.counts, (*self.at, rank), 4)
        rows = np.unique(self.at[0] * self.buckets + self.at[1])
        flat = self.counts.reshape(-1, 4)
        over = rows[flat[rows].sum(1) > 8192]
        flat[over] = (flat[over] >> 1) | 1


@dataclass
class Copies:
    """Pointers into what all lanes have coded: forward from the latest earlier place of the last `length` bases, or backward from that of their reverse complement."""

    length: int
    inverted: bool
    lanes: int
    slots: int
    pointer: np.ndarray = field(init=False)
    run: np.ndarray = field(init=False)
    misses: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    trust: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.pointer = np.full(self.lanes, -1, np.int64)
        self.run = np.zeros(self.lanes, np.int64)
        self.misses = np.zeros(self.lanes, np.int64)
        self.table = np.full(self.slots, -1, np.int64)
        self.trust = np.tile(np.array([[3, 1]], np.int64), (32, 1))

    def _slot(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = key * U(0x9E3779B97F4A7C15)
        return (h >> U(44)).astype(np.int64) % self.slots, ((h >> U(20)) & U(0xFF)).astype(np.int64)

    def bucket(self) -> np.ndarray:
        return np.minimum(15, self.run) + 16 * (self.misses & 0xFF != 0)

    def expect(self, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expected symbols (-1: none) and how far each is to be trusted."""
        going = self.pointer >= 0
        found = past[np.maximum(self.pointer, 0)]
        symbol = np.where(going, 3 - found if self.inverted else found, -1)
        t = self.trust[self.bucket()]
        return symbol, np.where(going, t[:, 0] / (t[:, 0] + t[:, 1]), 0.25)

    def move(self, expected: np.ndarray, symbols: np.ndarray, step: int, lanes: int, forward: np.ndarray, reverse: np.ndarray, place: np.ndarray) -> None:
        """Learns from the step's symbols, moves or drops the pointers (over 8 misses of 32 drop one) and looks for new ones. Places are step * lanes + lane."""
        going = expected >= 0
        hit = going & (expected == symbols)
        b = self.bucket()[going]
        np.add.at(self.trust, (b, np.where(hit[going], 0, 1)), 1)
        over = np.unique(b)
        over = over[self.trust[over].sum(1) > 1 << 14]
        self.trust[over] = (self.trust[over] >> 1) | 1
        self.run = np.where(hit, self.run + 1, 0)
        self.misses = ((self.misses << 1) | (going & ~hit)) & 0xFFFFFFFF
        self.pointer = np.where(going, self.pointer + (-lanes if self.inverted else lanes), -1)
        many = np.bitwise_count(self.misses) > 8
        self.pointer[many | (self.pointer > place)] = -1
        lost = self.pointer < 0
        self.misses[lost], self.run[lost] = 0, 0
        if step + 1 < self.length:
            return
        shift = U(64 - 2 * self.length)
        mine = (forward << shift) >> shift
        slot, tag = self._slot(reverse >> shift if self.inverted else mine)
        if lost.any():
            held = self.table[slot]
            good = lost & (held >= 0) & (held & 0xFF == tag)
            at = held >> 8  # the place of the last base of the earlier stretch
            at = at - self.length * lanes if self.inverted else at + lanes
            self.pointer = np.where(good & (at >= 0) & (at <= place), at, self.pointer)
        slot, tag = self._slot(mine)
        self.table[slot] = place << 8 | tag


class Model:
    """Distributions of the next base of each lane, and what is learned when it is known."""

    def __init__(self, lanes: int, steps: int):
        n = lanes * steps
        self.lanes, self.steps, self.t = lanes, steps, 0
        room = max(10, min(22, n.bit_length() + 1))
        self.bits = np.array([min(2 * o, room) for o in ORDERS])
        self.first = np.concatenate([[0], np.cumsum(1 << self.bits)[:-1]])
        self.counts = np.zeros((int((1 << self.bits).sum()), 4), np.int32)
        self.step_up = np.array([[1 if o < 11 else 4] for o in ORDERS])
        self.limit = [1024 if o < 11 else 256 for o in ORDERS]
        self.alpha = np.array([1.0 if o < 9 else 0.5 if o < 11 else 0.25 for o in ORDERS])
        self.forward, self.reverse = np.zeros(lanes, U), np.zeros(lanes, U)
        self.tolerant = [np.zeros(lanes, U) for _ in TOLERANT]
        self.edits = [np.zeros(lanes, np.int64) for _ in TOLERANT]
        slots = 1 << max(10, min(20, n.bit_length()))
        self.copies = [Copies(k, False, lanes, slots) for k in ANCHORS] + [Copies(k, True, lanes, slots) for k in INVERTED]
        self.past = np.zeros(n, np.int64)
        self.inputs = len(ORDERS) + len(TOLERANT) + len(self.copies)
        self.mixers = [Mixer(self.inputs, lanes, c, s) for c, s in ((17, 0.02), (len(ORDERS) + 1, 0.02), (1, 0.004))]
        self.last = Mixer(len(self.mixers), lanes, 1, 0.01)
        self.calibrations = [Calibration(16), Calibration(17), Calibration(len(ORDERS) + 1)]

    def _rows(self, context: np.ndarray, i: int) -> np.ndarray:
        """Rows of counts for contexts (packed bases) of the i-th order: direct, or by a hash where the table is smaller."""
        o, bits = ORDERS[i], int(self.bits[i])
        key = context & U((1 << 2 * o) - 1)
        if 2 * o > bits:
            key = (key * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
        return key.astype(np.int64) + self.first[i]

    def predict(self) -> np.ndarray:
        """Integer shares of TOTAL (rows: A, C, G, T) for each lane."""
        rows = np.stack([self._rows(self.forward, i) for i in range(len(ORDERS))])
        found = [self.counts[rows]]
        self.guess = []
        for ctx, o in zip(self.tolerant, TOLERANT, strict=True):
            c = self.counts[self._rows(ctx, ORDERS.index(o))]
            self.guess.append(np.where(c.any(1), c.argmax(1), -1))
            found.append(c[None])
        c = np.concatenate(found)
        alpha = np.concatenate([self.alpha, [0.25] * len(TOLERANT)])[:, None, None]
        sums = c[..., 0] + c[..., 1] + c[..., 2] + c[..., 3]
        p = np.empty((self.inputs, 4, self.lanes))
        p[: len(c)] = ((c + alpha) / (sums[..., None] + 4 * alpha)).transpose(0, 2, 1)
        for j, o in enumerate(TOLERANT):  # beyond half of the context's bases edited it tells nothing
            p[len(ORDERS) + j][:, np.bitwise_count(self.edits[j] & ((1 << o) - 1)) > o // 2] = 0.25
        self.expected = []
        for j, x in enumerate(self.copies):
            symbol, q = x.expect(self.past)
            self.expected.append(symbol)
            p[len(c) + j] = np.where(np.arange(4)[:, None] == symbol, q, (1 - q) / 3)
        self.p = p
        longest = self.copies[0]
        match = np.where(longest.pointer >= 0, 1 + np.minimum(15, longest.run), 0)
        seen = (sums[: len(ORDERS)] > 0).sum(0)
        mixed = [m.mix(p, ctx) for m, ctx in zip(self.mixers, (match, seen, np.zeros(self.lanes, np.int64)), strict=True)]
        self.mixed = np.stack(mixed)
        q = symmetric(self.last.mix(self.mixed, np.zeros(self.lanes, np.int64)))
        order = np.argsort(-q, 0, kind="stable")
        ranked = np.take_along_axis(q, order, 0)
        fine = ranked * 2
        for cal, ctx in zip(self.calibrations, ((self.forward & U(15)).astype(np.int64), match, seen), strict=True):
            fine += cal.refine(ranked, ctx)
        fine /= fine[0] + fine[1] + fine[2] + fine[3]
        self.order = order
        out = np.empty_like(q)
        np.put_along_axis(out, order, fine, 0)
        return quantised(out)

    def learn(self, symbols: np.ndarray) -> None:
        lane = np.arange(self.lanes)
        self.last.learn(self.mixed[:, symbols, lane])
        hit = self.p[:, symbols, lane]
        for m in self.mixers:
            m.learn(hit)
        rank = (self.order == symbols).argmax(0)
        for cal in self.calibrations:
            cal.learn(rank)
        for i in range(len(ORDERS)):
            self._count(self._rows(self.forward, i), symbols, i)
        place = self.t * self.lanes + lane
        self.past[place] = symbols
        s = symbols.astype(U)
        self.forward = self.forward << U(2) | s
        self.reverse = self.reverse >> U(2) | (U(3) - s) << U(62)
        for i, o in enumerate(ORDERS):  # the other strand: what came before the last bases, read backwards
            if self.t >= o:
                self._count(self._rows(self.reverse >> U(64 - 2 * o), i), 3 - ((self.forward >> U(2 * o)) & U(3)).astype(np.int64), i)
        for j in range(len(TOLERANT)):
            miss = (self.guess[j] != symbols) & (self.guess[j] >= 0)
            self.edits[j] = (self.edits[j] << 1 | miss) & 0xFFFFFF
            kept = np.where(self.guess[j] >= 0, self.guess[j], symbols).astype(U)
            strayed = np.bitwise_count(self.edits[j] & 0xFFFF) > 8
            self.tolerant[j] = np.where(strayed, self.forward, self.tolerant[j] << U(2) | kept)
            self.edits[j][strayed] = 0
        for x, expected in zip(self.copies, self.expected, strict=True):
            x.move(expected, symbols, self.t, self.lanes, self.forward, self.reverse, place)
        self.t += 1

    def _count(self, rows: np.ndarray, symbols: np.ndarray, i: int) -> None:
        np.add.at(self.counts, (rows, symbols), self.step_up[i, 0])
        over = rows[self.counts[rows].sum(1) > self.limit[i]]
        if len(over):
            forget(self.counts, over, self.limit[i])


def lanes_of(n: int) -> int:
    return int(min(512, max(1, n // 1024)))


def encode_bases(codes: np.ndarray) -> bytes:
    """Bases 0 to 3. The model runs forward over all steps; its shares are then coded backward, as the coder demands."""
    n = len(codes)
    if not n:
        return b""
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes, steps)
    share, below = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32)
    lane = np.arange(lanes)
    for t in range(steps):
        f = model.predict()
        share[t] = f[grid[t], lane]
        below[t] = (np.cumsum(f, 0) - f)[grid[t], lane]
        model.learn(grid[t])
    state = np.full(lanes, _LOW, np.int64)
    words: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        f, c = share[t].astype(np.int64), below[t]
        full = state >= (f << (32 - BITS))
        if full.any():
            words.append((state[full] & 0xFFFF).astype("<u2")[::-1])
            state = np.where(full, state >> 16, state)
        state = (state // f << BITS) + state % f + c
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u2")
    return state.astype("<u4").tobytes() + stream.astype("<u2").tobytes()


def decode_bases(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    if len(data) < 4 * lanes or len(data) % 2:
        raise ValueError("the stream of bases ends early")
    state = np.frombuffer(data[: 4 * lanes], "<u4").astype(np.int64)
    stream = np.frombuffer(data[4 * lanes :], "<u2").astype(np.int64)
    model = Model(lanes, steps)
    grid = np.zeros((steps, lanes), np.int64)
    lane = np.arange(lanes)
    at = 0
    for t in range(steps):
        f = model.predict()
        below = np.cumsum(f, 0) - f
        slot = state & (TOTAL - 1)
        s = (below <= slot).sum(0) - 1
        state = f[s, lane] * (state >> BITS) + slot - below[s, lane]
        low = state < _LOW
        k = int(low.sum())
        if k:
            if at + k > len(stream):
                raise ValueError("the stream of bases ends early")
            state[low] = state[low] << 16 | stream[at : at + k]
            at += k
        grid[t] = s
        model.learn(s)
    return np.ascontiguousarray(grid.T).ravel()[:n]
