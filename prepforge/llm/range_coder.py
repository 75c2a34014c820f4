"""Adaptive context-mixing range coder for token ids.

A block starts from an empty model and can be read on its own.  Its ids are cut into lanes that are
coded side by side, one id of every lane in a step; all lanes share one model and feed it after each
step, so a step is a handful of numpy operations over the lanes.

The model predicts ids at three orders.  Order 2 and order 1 remember the id that last followed a
context and how often that came true; order 0 counts all ids.  The chance of a remembered id is mixed
in the logistic domain from the success of its order at this confidence, the vote of the other order
and the order-0 count, with weights that are learned along the way.  An id is coded as "order 2 is
right", "order 1 is right" or neither, and in the last case by its order-0 frequency.  All arithmetic
is in integers, so any machine decodes what another has encoded.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"ptrc"
HEADER = "<4sBQIIIII"  # magic, version, ids, alphabet, lanes, words, crc of the ids, crc of the body
VERSION = 1
LANES, LANE_IDS = 8192, 128
_ONE = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_16 = np.uint64(16)
_FULL = np.uint64(1) << np.uint64(32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) in 1/256 for a probability in 1/4096, and its inverse in 1/65536."""
    stretch = [round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)]
    squash = [min(_ONE - 600, max(600, round(_ONE / (1 + math.exp(-(i - 2048) / 256))))) for i in range(4096)]
    return np.array(stretch, dtype="int64"), np.array(squash, dtype="int64")


STRETCH, SQUASH = _tables()
UP = np.array([1, 2, 3, 4, 5, 6, 7, 7], dtype="int64")
# what a confidence becomes less what it was, after a miss (first half) and a hit
MOVE = np.concatenate([np.arange(8) >> 1, UP]) - np.tile(np.arange(8), 2)


class Model:
    """The shared adaptive state of a block."""

    CONTEXTS = 20  # bits of the order-2 table
    STEP = 24      # what one occurrence adds to an order-0 count
    LIMIT = 1 << 26

    def __init__(self, alphabet: int):
        self.n = alphabet
        # a remembered id and its confidence (0 to 7) in one number
        self.order1, self.order2 = np.zeros(alphabet, dtype="int64"), np.zeros(1 << self.CONTEXTS, dtype="int64")
        self.counts = np.ones(alphabet, dtype="int64")
        self.pending: list[np.ndarray] = []
        self.steps = 0
        # [order][confidence]: tries and successes
        self.tries = np.full((2, 8), 16, dtype="int64")
        self.right = np.full((2, 8), 4, dtype="int64")
        # mixing weights in 1/65536 for each order and confidence: own success, the other order, order 0
        self.weights = np.tile(np.array([_ONE, _ONE // 4, _ONE // 4], dtype="int64"), (2, 8, 1))
        self._settle()
        self._refresh()

    def _settle(self):
        """What the predictions of the next steps read: the mixed votes of both orders by place, that is by
        the confidence of order 2, that of order 1 and whether they agree, and the weight of order 0."""
        self.own = STRETCH[(self.right << 12) // (self.tries + 1)]
        own2, own1 = self.own
        self.vote = np.stack([np.tile(-own1, (8, 1)), np.tile(own1, (8, 1))], axis=2)  # of order 1 for the id of order 2
        w2, w1 = self.weights
        middle = 2048 << 16
        self.base2 = ((w2[:, 0] * own2 + middle)[:, None, None] + w2[:, 1][:, None, None] * self.vote).ravel()
        self.base1 = np.repeat((w1[:, 0] * own1 + middle)[None, :] - w1[:, 1][None, :] * own2[:, None], 2)
        self.rare2, self.rare1 = np.repeat(w2[:, 2], 16), np.tile(np.repeat(w1[:, 2], 2), 8)

    def _refresh(self):
        if self.pending:
            self.counts += self.STEP * np.bincount(np.concatenate(self.pending), minlength=self.n)
            self.pending = []
            if self.counts.sum() > self.LIMIT:
                self.counts = (self.counts + 1) >> 1
        self.ends = np.cumsum(self.counts)
        self.total = int(self.ends[-1])
        self.shares = STRETCH[np.minimum(4095, (self.counts << 12) // self.total)]
        self.below = None

    def predict(self, p1: np.ndarray, p2: np.ndarray):
        """Remembered ids and the frequencies (of 65536) of "order 2 right" and "order 1 right"."""
        self.slot = ((p2 * 0x9E3779B1 + p1 * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - self.CONTEXTS)
        self.p1 = p1
        self.e2, self.e1 = self.order2[self.slot], self.order1[p1]
        self.c2, self.c1, self.k2, self.k1 = self.e2 >> 3, self.e1 >> 3, self.e2 & 7, self.e1 & 7
        self.same = self.c1 == self.c2
        place = self.k2 << 3
        place |= self.k1
        place <<= 1
        place |= self.same
        self.place, self.s2, self.s1 = place, self.shares[self.c2], self.shares[self.c1]
        self.q2 = self._mix(self.base2, self.rare2, self.s2)
        self.q1 = self._mix(self.base1, self.rare1, self.s1)
        f1 = _ONE - self.q2
        f1 *= self.q1
        f1 >>= 16
        f1 *= ~self.same
        return self.q2, f1

    def _mix(self, base: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
        s = weight[self.place]
        s *= share
        s += base[self.place]
        s >>= 16
        np.maximum(s, 0, out=s)
        np.minimum(s, 4095, out=s)
        return SQUASH[s]

    def counts_at(self, ids: np.ndarray) -> np.ndarray:
        return self.counts[ids]

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose order-0 frequencies hold v: all ends in parts of the range before its own, then a search in its part."""
        if self.below is None:
            self.part = max(0, self.total.bit_length() - 14)
            part = np.bincount(self.ends >> self.part, minlength=(self.total >> self.part) + 1)
            self.below = np.concatenate([[0], np.cumsum(part)])
        part = v >> self.part
        low, high = self.below[part], self.below[part + 1]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            before = self.ends[middle] <= v[open_]
            a, b = np.where(before, middle + 1, a), np.where(before, b, middle)
            low[open_], high[open_] = a, b
            open_ = open_[a < b]
        return low

    def update(self, ids: np.ndarray):
        hit2, hit1 = ids == self.c2, ids == self.c1
        if self.steps < 16 or self.steps % 4 == 0:
            own2, own1 = self.own
            self._learn(0, self.place, hit2, self.q2, self.s2, own2, self.vote, (1, 2))
            other = np.flatnonzero(~(hit2 | self.same))
            self._learn(1, self.place[other], hit1[other], self.q1[other], self.s1[other], own1, -own2[:, None, None], (0, 2))
            self._settle()
        new = ids << 3
        new |= 1
        self.order2[self.slot] = np.where(hit2 | (self.k2 > 1), self.e2 + MOVE[self.k2 + (hit2.view("int8") << 3)], new)
        self.order1[self.p1] = np.where(hit1 | (self.k1 > 1), self.e1 + MOVE[self.k1 + (hit1.view("int8") << 3)], new)
        self.pending.append(ids)
        self.steps += 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 8 == 0:
            self._refresh()

    def _learn(self, order: int, place: np.ndarray, hit: np.ndarray, q: np.ndarray, share: np.ndarray, own: np.ndarray, other: np.ndarray, rest: tuple[int, int]):
        """Votes are the same for all lanes of a place, so errors are summed by place before they meet the votes."""
        def by_place(at, weights=None):
            # sums of integers below 2**53 are exact in doubles
            return np.bincount(at, weights=weights, minlength=128).astype("int64").reshape(8, 8, 2)

        error = hit * np.int64(_ONE)
        error -= q
        tries, missed = by_place(place).sum(rest), by_place(place, error)
        self.tries[order] += tries
        self.right[order] += by_place(place[hit]).sum(rest)
        steps = own * missed.sum(rest), (other * missed).sum(rest), by_place(place, error * share).sum(rest)
        for j, step in enumerate(steps):
            step //= np.maximum(tries, 1)
            self.weights[order, :, j] = np.clip(self.weights[order, :, j] + (step >> 9), -4 * _ONE, 4 * _ONE)


def _narrow(low, part, start, size):
    """Take [start, start + size) of the equal parts of every lane's interval."""
    return low + part * start.view("uint64"), part * size.view("uint64")


def _choice(hit2, miss, f2, f1):
    """Start and size of "order 2 right", "order 1 right" or neither, whichever holds in a lane."""
    other = ~hit2
    start = other * f2
    start += miss * f1
    end = other * f1
    end += f2
    np.copyto(end, _ONE, where=miss)
    end -= start
    return start, end


def _shift(low, span):
    """Lanes whose span has become too small to go on; a span across a word border is cut to its lower part."""
    small = np.flatnonzero(span < _FULL)
    if len(small):
        a, s = low[small], span[small]
        crosses = (a ^ (a + s - np.uint64(1))) >> _32 != 0
        s[crosses] = _FULL - (a[crosses] & _LOW)
        span[small] = s
    return small


def _layout(n: int) -> tuple[int, int]:
    """Lanes and ids in a lane."""
    lanes = max(1, min(LANES, -(-n // LANE_IDS)))
    each = -(-n // lanes)
    return -(-n // each), each


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of at least one id; every id is below ``alphabet``."""
    ids = np.ascontiguousarray(ids, dtype="int64")
    lanes, each = _layout(len(ids))
    grid = np.zeros(lanes * each, dtype="int64")
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, each).T)
    last = len(ids) - (lanes - 1) * each
    model = Model(alphabet)
    low, span = np.zeros(lanes, dtype="uint64"), np.full(lanes, np.iinfo("uint64").max, dtype="uint64")
    p1 = p2 = np.zeros(lanes, dtype="int64")
    where, words = [], []

    for t in range(each):
        m = lanes if t < last else lanes - 1
        x = grid[t, :m]
        f2, f1 = model.predict(p1[:m], p2[:m])
        hit2 = x == model.c2
        known = hit2 | (~model.same & (x == model.c1))
        lo, sp = _narrow(low[:m], span[:m] >> _16, *_choice(hit2, ~known, f2, f1))
        small = _shift(lo, sp)
        where.append(small)
        words.append((lo[small] >> _32).astype("<u4"))
        lo[small] <<= _32
        sp[small] <<= _32
        miss = np.flatnonzero(~known)
        xm = x[miss]
        size = model.counts_at(xm)
        l2, s2 = _narrow(lo[miss], sp[miss] // np.uint64(model.total), model.ends[xm] - size, size)
        small = _shift(l2, s2)
        where.append(miss[small])
        words.append((l2[small] >> _32).astype("<u4"))
        l2[small] <<= _32
        s2[small] <<= _32
        lo[miss], sp[miss] = l2, s2
        low[:m], span[:m] = lo, sp
        model.update(x)
        p2, p1 = p1[:m], x
    # one word of each lane's interval ends it; what follows reads as zero
    where.append(np.arange(lanes))
    words.append(((low >> _32) + (low & _LOW != 0)).astype("<u4"))
    lane, word = np.concatenate(where), np.concatenate(words)
    order = np.argsort(lane.astype("uint16") if lanes <= _ONE else lane, kind="stable")  # short numbers are sorted by digits
    sizes = np.bincount(lane, minlength=lanes).astype("<u2" if each <= 1 << 14 else "<u4")
    body = sizes.tobytes() + word[order].tobytes()
    crc = zlib.crc32(ids.astype("<u4"))
    return struct.pack(HEADER, MAGIC, VERSION, len(ids), alphabet, lanes, len(word), crc, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; a damaged block raises ValueError."""
    magic, version, n, alphabet, lanes, n_words, crc, body_crc = struct.unpack_from(HEADER, block)
    body = memoryview(block)[struct.calcsize(HEADER):]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != body_crc:
        raise ValueError("damaged token block")
    each = -(-n // lanes)
    kind = np.dtype("<u2" if each <= 1 << 14 else "<u4")
    sizes = np.frombuffer(body, dtype=kind, count=lanes).astype("int64")
    words = np.concatenate([np.frombuffer(body, dtype="<u4", offset=lanes * kind.itemsize, count=n_words), np.zeros(1, "<u4")]).astype("uint64")
    ends = np.cumsum(sizes)
    at = ends - sizes

    def read(rows):
        p = at[rows]
        at[rows] = p + 1
        return words[np.where(p < ends[rows], p, n_words)]

    every = np.arange(lanes)
    code = read(every) << _32
    code |= read(every)
    last = n - (lanes - 1) * each
    model = Model(alphabet)
    low, span = np.zeros(lanes, dtype="uint64"), np.full(lanes, np.iinfo("uint64").max, dtype="uint64")
    p1 = p2 = np.zeros(lanes, dtype="int64")
    grid = np.zeros((each, lanes), dtype="int64")
    for t in range(each):
        m = lanes if t < last else lanes - 1
        f2, f1 = model.predict(p1[:m], p2[:m])
        lo, sp, cd = low[:m], span[:m], code[:m]
        part = sp >> _16
        v = ((cd - lo) // part).view("int64")
        hit2, unknown = v < f2, v >= f2 + f1
        lo, sp = _narrow(lo, part, *_choice(hit2, unknown, f2, f1))
        small = _shift(lo, sp)
        cd[small] = (cd[small] << _32) | read(small)
        lo[small] <<= _32
        sp[small] <<= _32
        x = np.where(hit2, model.c2, model.c1)
        miss = np.flatnonzero(unknown)
        l2, c2 = lo[miss], cd[miss]
        part = sp[miss] // np.uint64(model.total)
        v = np.minimum(((c2 - l2) // part).view("int64"), model.total - 1)
        xm = model.find(v)
        size = model.counts_at(xm)
        l2, s2 = _narrow(l2, part, model.ends[xm] - size, size)
        small = _shift(l2, s2)
        c2[small] = (c2[small] << _32) | read(miss[small])
        l2[small] <<= _32
        s2[small] <<= _32
        lo[miss], sp[miss], cd[miss], x[miss] = l2, s2, c2, xm
        low[:m], span[:m] = lo, sp
        grid[t, :m] = x
        model.update(x)
        p2, p1 = p1[:m], x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids) != crc:
        raise ValueError("damaged token block")
    return ids
