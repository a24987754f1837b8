"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block codes its symbols on ``lanes`` states in turn (symbol i on lane i mod lanes), so each step codes one symbol on
every lane at once. Blocks are independent of each other and share one frequency table. In a block, checkpoints hold all
states and the place in the stream every ``CHECKPOINT_STEPS`` steps: a decoder can start at any of them.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 128
MAGIC = b"RLRANS1\0"
_HEAD = struct.Struct("<8sIIIIIIIq")
_32 = np.uint64(32)
_FULL = np.uint64(31 - BITS + 32)  # a state this far above its symbol's frequency gives 32 bits away first


@dataclass
class Table:
    """Frequencies that sum to 2**BITS; a symbol that occurs has one of 1 at least."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.low = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.rest = np.uint64(1 << BITS) - self.freq
        self.times = self.freq[self.symbol]  # by slot: frequency of its symbol, and its place among the symbol's slots
        self.place = np.arange(1 << BITS, dtype=np.uint64) - self.low[self.symbol]
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """From counts of all symbols in all data; without data every symbol is impossible but 0."""
        counts = np.asarray(counts, np.int64)
        if not counts.sum():
            counts = np.eye(1, max(1, len(counts)), dtype=np.int64)[0]
        full = 1 << BITS
        used = counts > 0
        if used.sum() > full:
            raise ValueError(f"{used.sum()} symbols do not fit a table of {full}")
        spare = full - int(used.sum())
        freq = used + np.floor(counts / counts.sum() * spare).astype(np.int64)
        freq[np.argmax(counts)] += full - freq.sum()
        return cls(freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4"))


def encode(ids: np.ndarray, table: Table, doc_ids: np.ndarray, lengths: np.ndarray, start: int) -> bytes:
    """One block: header, documents, checkpoints, final states, stream. ``start``: ids in all blocks before."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 16))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, emitted, marks = [], 0, []
    freq, low, rest = table.freq, table.low, table.rest
    if n and int(freq[ids].min()) == 0:
        raise ValueError("a symbol that the table does not have")
    symbols = ids.astype(np.intp)
    for t in range(steps - 1, -1, -1):
        s = symbols[t * lanes : (t + 1) * lanes]
        m = len(s)
        y = x[:m]
        f = freq[s]
        over = np.flatnonzero((y >> _FULL) >= f)
        if len(over):
            out = y[over]
            words.append(out.astype("<u4"))
            emitted += len(out)
            y[over] = out >> _32
        q = y // f
        q *= rest[s]
        y += q
        y += low[s]
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((t, emitted, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).tobytes() if words else b""
    index = np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes()
    points = b"".join(struct.pack("<II", t, emitted - e) + states for t, e, states in reversed(marks))
    body = index + points + x.astype("<u8").tobytes() + stream
    head = _HEAD.pack(MAGIC, n, lanes, emitted, len(marks), len(doc_ids), table.crc, zlib.crc32(ids.astype("<u4").tobytes()), start)
    return head + struct.pack("<I", zlib.crc32(head + body)) + body


@dataclass
class Block:
    """A parsed block; nothing is decoded yet."""

    n: int
    lanes: int
    start: int
    crc: int
    doc_ids: np.ndarray
    lengths: np.ndarray
    points: list[tuple[int, int, np.ndarray]]  # step, place in the stream, states
    stream: np.ndarray

    @classmethod
    def parse(cls, blob: bytes, table: Table) -> Block:
        magic, n, lanes, words, marks, docs, table_crc, crc, start = _HEAD.unpack_from(blob)
        at = _HEAD.size
        if magic != MAGIC or table_crc != table.crc:
            raise ValueError("not a block of this table")
        (sum_,) = struct.unpack_from("<I", blob, at)
        if zlib.crc32(blob[at + 4 :], zlib.crc32(blob[:at])) != sum_:
            raise ValueError("block checksum differs")
        at += 4
        doc_ids = np.frombuffer(blob, "<i8", docs, at)
        lengths = np.frombuffer(blob, "<u4", docs, at := at + 8 * docs)
        at += 4 * docs
        points = []
        for _ in range(marks):
            t, place = struct.unpack_from("<II", blob, at)
            points.append((t, place, np.frombuffer(blob, "<u8", lanes, at + 8)))
            at += 8 + 8 * lanes
        points.insert(0, (0, 0, np.frombuffer(blob, "<u8", lanes, at)))
        at += 8 * lanes
        return cls(n, lanes, start, crc, doc_ids, lengths, points, np.frombuffer(blob, "<u4", words, at))

    def decode(self, table: Table, point: int = 0, points: int | None = None) -> np.ndarray:
        """Ids from one checkpoint over ``points`` checkpoints' worth of steps (all by default)."""
        t, place, states = self.points[point]
        after = point + points if points else len(self.points)
        last = self.points[after][0] if after < len(self.points) else -(-self.n // self.lanes)
        x = states.astype(np.uint64)
        out = np.empty(min(self.n, last * self.lanes) - t * self.lanes, np.uint32)
        times, slots, symbol, stream = table.times, table.place, table.symbol, self.stream
        mask, done = np.uint64((1 << BITS) - 1), 0
        for step in range(t, last):
            m = min(self.lanes, self.n - step * self.lanes)
            y = x[:m]
            slot = (y & mask).view(np.int64)
            out[done : done + m] = symbol[slot]
            done += m
            y = times[slot] * (y >> np.uint64(BITS)) + slots[slot]
            under = np.flatnonzero(y < LOW)
            if len(under):
                y[under] = (y[under] << _32) | stream[place : place + len(under)].astype(np.uint64)
                place += len(under)
            x[:m] = y
        return out

    def ids(self, table: Table) -> np.ndarray:
        out = self.decode(table)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("decoded ids differ from those encoded")
        return out
