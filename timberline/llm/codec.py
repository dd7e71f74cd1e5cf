"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that start from the same state, so every block can be decoded alone with the
header of its segment. All blocks of a segment are coded side by side, one numpy lane each.

An id is predicted three times: order 2 (the id that last followed the last two), order 1 (the id that last
followed the last one) and order 0 (frequencies of the ids of the segment, in its header). An id is then
one of three classes: order-2 hit, order-1 hit, or coded by the order-0 frequencies. The class probabilities are a
mix of two adaptive tables, one by the confidence in the order-2 and order-1 predictions, one by
the last two classes, with a weight that each lane moves towards the table that was right. All arithmetic is on
integers, so any machine decodes any file.

Coded blocks are 16-bit words of a range coder with a 48-bit register.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
_MAGIC = b"TLR2"
_HASH = 10  # bits of a lane's prediction tables
_SCALE = 11  # bits of a class probability
_SURE = 20  # a prediction is kept as rank + 2^20 * confidence
_RANK = (1 << _SURE) - 1
_MASK32 = (1 << 32) - 1
_FIELDS = 0x007F007F  # both bounds of a class table after a shift by 5
#: what a class adds to the two bounds (end of class 0, end of class 1) of a table
_PULL = np.array([64 | 64 << 16, 64 << 16, 0], np.int32)


class _Order0:
    """Frequencies of the ids of a segment, scaled to a power of two. Ids are coded as ranks among them."""

    def __init__(self, known: np.ndarray, freq: np.ndarray):
        if len(known) > _RANK:
            raise ValueError("a segment may hold at most 2^20 - 1 different ids")
        self.known, self.freq = known, freq.astype(np.int64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.bits = self.bits_for(len(known))
        # beyond 20 bits the register has to be filled up between a class and its rank
        self.fill = self.bits > 20

    @staticmethod
    def bits_for(n: int) -> int:
        return max(12, n.bit_length() + 3)

    @classmethod
    def of(cls, known: np.ndarray, counts: np.ndarray) -> "_Order0":
        """At least 1 each; what scaling leaves over or lacks goes to the largest, in proportion."""
        if not len(known):
            return cls(known, counts)
        total = 1 << cls.bits_for(len(known))
        freq = 1 + counts * (total - len(known)) // int(counts.sum())
        freq[int(np.argmax(freq))] += total - int(freq.sum())
        return cls(known, freq)

    def slots(self) -> np.ndarray:
        """Rank by every value below 2^bits."""
        return np.repeat(np.arange(len(self.known), dtype=np.int32), self.freq)

    def pack(self) -> bytes:
        gaps = np.diff(self.known, prepend=0).astype("<u4")
        both = np.concatenate([gaps, self.freq.astype("<u4")])
        # bytes of equal weight side by side
        return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> "_Order0":
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        both = np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)
        n = len(both) // 2
        return cls(np.cumsum(both[:n]), both[n:])


class _Model:
    """The predictions of a number of lanes; the coder and the decoder drive it alike.

    A class table is two bounds in one number: the end of class 0 and, 16 bits up, the end of class 1.
    """

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) << _HASH
        self.base_ctx = np.arange(lanes, dtype=np.int64) << 4
        self.after2, self.after1 = np.zeros(lanes << _HASH, np.int32), np.zeros(lanes << _HASH, np.int32)
        start = np.full(lanes << 4, 256 | 768 << 16, np.int32)
        self.by_sure, self.by_past = start, start.copy()
        self.weight = np.full(lanes, 4, np.int32)
        self.past = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order-2 and order-1 predictions of the first k lanes and the ends of the classes 0 and 1; no
        class is empty and the last ends at 2^11."""
        last, mask, base = self.last[:k], (1 << _HASH) - 1, self.base[:k]
        h1 = last * 40503
        self.at1 = ((h1 >> 6) & mask) + base
        h1 += self.before[:k]
        self.at2 = ((h1 >> 5) & mask) + base
        e2, e1 = self.after2.take(self.at2), self.after1.take(self.at1)
        self.s2, self.s1 = e2 >> _SURE, e1 >> _SURE
        ctx = self.base_ctx[:k]
        self.ctx_a = ctx + ((self.s2 << 2) + self.s1)
        self.ctx_b = ctx + self.past[:k]
        self.a, self.b = self.by_sure.take(self.ctx_a), self.by_past.take(self.ctx_b)
        both = (self.b << 3) + (self.a - self.b) * self.weight[:k]
        end0, end1 = (both >> 3) & 0x1FFF, both >> 19
        end0 -= (end0 >> 5) - 1
        end1 -= (end1 >> 5) - 32
        return e2 & _RANK, e1 & _RANK, end0.astype(np.int64), end1.astype(np.int64)

    def update(self, k: int, ranks: np.ndarray, kind: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        small = ranks.astype(np.int32)
        self.after2[self.at2] = small + (np.minimum(self.s2 + 1, 3) * hit2 << _SURE)
        self.after1[self.at1] = small + (np.minimum(self.s1 + 1, 3) * hit1 << _SURE)
        a, b = self.a, self.b
        by0, by1 = (a & 0xFFFF) - (b & 0xFFFF), (a >> 16) - (b >> 16)
        won = np.where(kind == 1, by1 - by0, (by0 + by1) * (1 - kind))
        weight = self.weight[:k]
        weight += np.sign(won).astype(np.int32)
        np.clip(weight, 0, 8, out=weight)
        pull = _PULL.take(kind)
        self.by_sure[self.ctx_a] = a - ((a >> 5) & _FIELDS) + pull
        self.by_past[self.ctx_b] = b - ((b >> 5) & _FIELDS) + pull
        past = self.past[:k]
        past <<= 2
        past += kind
        past &= 15
        self.before[:k] = self.last[:k] * 60493
        self.last[:k] = ranks


def _lanes(n: int, block: int) -> tuple[np.ndarray, list[int]]:
    """Lengths of the blocks of n ids, and the number of lanes still running at each step."""
    sizes = np.full(-(-n // block), block)
    if n % block:
        sizes[-1] = n % block
    steps = int(sizes[0]) if n else 0
    return sizes, [len(sizes) - (t >= sizes[-1]) for t in range(steps)]


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, the place of every id among them, and how often each occurs."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[known] = np.arange(len(known))
    return known, place[ids], counts[known]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: header with the order-0 frequencies, a table of blocks (ids, bytes, crc32 of the
    ids) and the coded blocks. Ids are below 2^32; an empty segment has no blocks."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() > _MASK32):
        raise ValueError("ids must be unsigned 32-bit numbers")
    known, ranks, counts = _ranked(ids)
    order0 = _Order0.of(known, counts)
    sizes, running = _lanes(len(ids), block)
    n = len(sizes)
    padded = np.zeros(n * block, np.int64)
    padded[:len(ids)] = ranks
    symbols = np.ascontiguousarray(padded.reshape(n, block).T)
    model = _Model(n)
    low, span, at = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64), np.zeros(n, np.int64)
    words = np.zeros((3 * block + 4, n), np.uint32)

    def fill(lo: np.ndarray, sp: np.ndarray) -> None:
        need = np.flatnonzero(sp < 1 << 32)
        while len(need):
            v, w, wide = lo[need], at[need], sp[need] << 16
            words[w, need] = v >> 32
            lo[need] = (v & _MASK32) << 16
            sp[need] = wide
            at[need] = w + 1
            need = need[wide < 1 << 32]

    for t, k in enumerate(running):
        x, lo, sp = symbols[t, :k], low[:k], span[:k]
        p2, p1, end0, end1 = model.predict(k)
        hit2, hit1 = p2 == x, p1 == x
        kind = np.where(hit2, 0, 2 - hit1)
        r = sp >> _SCALE
        start = np.where(hit2, 0, np.where(hit1, end0, end1))
        lo += r * start
        sp[:] = r * (np.where(hit2, end0, np.where(hit1, end1, 1 << _SCALE)) - start)
        if order0.fill:
            fill(lo, sp)
        plain = np.flatnonzero(kind == 2)
        rank, r = x[plain], sp[plain] >> order0.bits
        lo[plain] += r * order0.cum[rank]
        sp[plain] = r * order0.freq[rank]
        fill(lo, sp)
        model.update(k, x, kind, hit2, hit1)
    lane = np.arange(n)
    for _ in range(3):
        words[at, lane] = low >> 32
        low = (low & _MASK32) << 16
        at += 1
    for i in range(len(words) - 1, 0, -1):  # carries into earlier words
        words[i - 1] += words[i] >> 16
    coded = np.ascontiguousarray(words.T).astype("<u2")
    raw = ids.astype("<u4")
    table = order0.pack()
    parts, heads = [], []
    for j in range(n):
        data = coded[j, :at[j]].tobytes()
        parts.append(data)
        heads.append(struct.pack("<III", sizes[j], len(data), zlib.crc32(raw[j * block:j * block + sizes[j]].tobytes())))
    front = struct.pack("<IIII", block, n, len(table), zlib.crc32(table))
    return b"".join([_MAGIC, front, table, *heads, *parts])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; a header or block whose checksum differs raises ValueError."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment of coded ids")
    block, n, size, crc = struct.unpack_from("<IIII", data, 4)
    if zlib.crc32(data[20:20 + size]) != crc:
        raise ValueError("checksum of the frequencies differs")
    order0 = _Order0.unpack(data[20:20 + size])
    if not n:
        return np.zeros(0, "<u4")
    heads = np.frombuffer(data, "<u4", 3 * n, 20 + size).reshape(n, 3).astype(np.int64)
    starts = 20 + size + 12 * n + np.cumsum(heads[:, 1]) - heads[:, 1]
    longest = int(heads[:, 1].max()) // 2
    words = np.zeros((longest + 4, n), np.uint16)
    for j in range(n):
        words[:heads[j, 1] // 2, j] = np.frombuffer(data, "<u2", int(heads[j, 1]) // 2, int(starts[j]))
    sizes, running = _lanes(int(heads[:, 0].sum()), block)
    if not np.array_equal(sizes, heads[:, 0]):
        raise ValueError("block table is damaged")
    model, slots = _Model(n), order0.slots()
    w = words[:3].astype(np.int64)
    left = (w[0] << 32) | (w[1] << 16) | w[2]
    span, at = np.full(n, 1 << 48, np.int64), np.full(n, 3, np.int64)
    out = np.zeros((block, n), np.int32)

    def fill(d: np.ndarray, sp: np.ndarray) -> None:
        need = np.flatnonzero(sp < 1 << 32)
        while len(need):
            w, wide = at[need], sp[need] << 16
            d[need] = (d[need] << 16) | words[np.minimum(w, longest + 3), need]
            sp[need] = wide
            at[need] = w + 1
            need = need[wide < 1 << 32]

    for t, k in enumerate(running):
        d, sp = left[:k], span[:k]
        p2, p1, end0, end1 = model.predict(k)
        r = sp >> _SCALE
        over0, over1 = d >= r * end0, d >= r * end1
        kind = over0.astype(np.int64) + over1
        start = np.where(over1, end1, np.where(over0, end0, 0))
        d -= r * start
        sp[:] = r * (np.where(over1, 1 << _SCALE, np.where(over0, end1, end0)) - start)
        if order0.fill:
            fill(d, sp)
        x = np.where(over0, p1, p2).astype(np.int64)
        plain = np.flatnonzero(over1)
        mine, r = d[plain], sp[plain] >> order0.bits
        rank = slots.take(mine // r, mode="clip")  # only damaged blocks lie beyond
        x[plain] = rank
        d[plain] = mine - r * order0.cum[rank]
        sp[plain] = r * order0.freq[rank]
        fill(d, sp)
        out[t, :k] = x
        model.update(k, x, kind, p2 == x, p1 == x)
    ids = order0.known[out.T.reshape(-1)[:int(sizes.sum())]].astype("<u4")
    for j in range(n):
        if zlib.crc32(ids[j * block:j * block + int(sizes[j])].tobytes()) != heads[j, 2]:
            raise ValueError(f"checksum of block {j} differs")
    return ids
