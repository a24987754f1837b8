"""Substring deduplication with suffix arrays: bytes of every string of ``length`` that starts in two places are removed.

Most text repeats nowhere, so suffix arrays are built over what may repeat. Each string of ``length`` bytes has an anchor, the leftmost
of its ``ANCHOR``-byte parts with the smallest hash; equal strings have equal anchors at equal places. Consecutive strings
with one anchor are a region. Three exchanges between chunks of documents and buckets of anchors follow:

1. chunks send each anchor once, with how many regions it has and whether they differ; buckets answer which anchors occur
   in several regions, which of those are alike (then all their strings repeat), and which differ;
2. chunks send the bytes of regions with anchors that differ, each distinct one once, to the anchor's shard;
3. shards answer, for each region, which of its strings repeat.

A shard's suffix array comes from Larsson-Sadakane refinement (only groups still tied are sorted again, by the rank of what
follows at doubling distance) and its common prefixes from Kasai's algorithm on many stretches at a time, both in numpy and both
up to ``length``, beyond which nothing matters. Equal strings share an anchor, so anchors can be dealt to shards of bounded
size. An anchor with more than ``HOT`` regions is split into several shards; each pair of those is merged
by a binary search of the suffixes of one in the array of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.common import BYTE_KEY, MULT, MULT2, U64, by_bucket, chunked, chunks_of, mix, release, slices, stage, utf8

LENGTH = 400
ANCHOR = 160
HOT = 4096
SHARD_BYTES = 2 << 20
_FLAG_BYTES = (LENGTH + 7) // 8


def suffix_array(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``limit`` bytes, words of 8 bytes at each place, is a suffix the first of those tied).

    Ties stay in order of place.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8 + limit, np.uint8)))
    word = np.zeros(n + limit, np.uint64)
    for j in range(8):
        word = (word << U64(8)) | padded[j : j + n + limit]
    sa = np.argsort(word[:n], kind="stable")
    rank = np.empty(n, np.int64)
    first = np.ones(n, bool)
    first[1:] = word[sa[1:]] != word[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth = 8
    while depth < limit and n:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        step = min(depth, limit - depth)
        at = sa[tied]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at].astype(np.uint64) << U64(32) | second.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[tied] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first[tied] = new
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        depth += step
    return sa, word, first


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    out = (x == 0).astype(np.int64)
    for bits in range(8, 64, 8):
        out += x < U64(1 << bits)
    return out


def common_prefixes(sa: np.ndarray, word: np.ndarray, first: np.ndarray, limit: int, stretch: int = 256) -> np.ndarray:
    """Kasai: bytes that each suffix in ``sa`` shares with the one before it, up to ``limit``.

    Within a stretch of the text the prefix shrinks by one at most from place to place; all stretches advance at once.
    Refinement has told which suffixes tie; as ties are in order of place, the rule says nothing of what follows one.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ties = np.zeros(n, bool)
    ties[sa] = ~first
    shared = np.zeros(n, np.int64)
    begin = np.arange(0, n, stretch)
    have = np.zeros(len(begin), np.int64)
    for d in range(min(stretch, n)):
        at = begin + d
        at = at[at < n]
        have = have[: len(at)]
        other = before[at]
        have[(other < 0) | (have == limit - 1)] = 0
        have[ties[at]] = limit
        open_ = np.flatnonzero((other >= 0) & (have < limit))
        while len(open_):
            more = _equal_bytes(word[at[open_] + have[open_]], word[other[open_] + have[open_]])
            have[open_] += more
            open_ = open_[(more == 8) & (have[open_] < limit)]
        # places past the end of the text hold zeros; they can't count
        have = np.minimum(have, np.minimum(limit, n - np.maximum(at, other)))
        shared[at] = have
        have = np.maximum(have - 1, 0)
    return shared[sa]


def repeats(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` (places of whole strings of ``length``) begin a string that begins at another of them."""
    out = np.zeros(len(text), bool)
    sa, word, first = suffix_array(text, length)
    if len(sa):
        shared = common_prefixes(sa, word, first, length)
        group = np.cumsum(shared < length)
        is_start = np.zeros(len(text), bool)
        is_start[starts] = True
        count = np.bincount(group, is_start[sa])
        out[sa] = is_start[sa] & (count[group] > 1)
    return out[starts]


def _strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    return np.ascontiguousarray(view[at]).view(f"S{length}")[:, 0]


def found_in(text: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` begin a string that begins at ``other_starts`` of the other text: binary search in its suffix array."""
    sa, _, _ = suffix_array(other, length)
    ok = np.zeros(len(other), bool)
    ok[other_starts] = True
    sa = sa[ok[sa]]
    if not len(sa):
        return np.zeros(len(starts), bool)
    hit = np.zeros(len(starts), bool)
    for i in range(0, len(starts), 4096):
        mine = _strings(text, starts[i : i + 4096], length)
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(sa))
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(sa) - 1)
            less = _less(_strings(other, sa[mid], length), mine) & (low < high)
            low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
        place = np.minimum(low, len(sa) - 1)
        a, b = _strings(other, sa[place], length), mine
        hit[i : i + 4096] = (a.view(np.uint8).reshape(len(b), length) == b.view(np.uint8).reshape(len(b), length)).all(1)
    return hit


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b as bytes (numpy's own comparison would ignore zero bytes at the end)."""
    n = len(a)
    x, y = a.view(np.uint8).reshape(n, -1), b.view(np.uint8).reshape(n, -1)
    at = (x != y).argmax(1)
    rows = np.arange(n)
    return x[rows, at] < y[rows, at]


class Regions:
    """Regions of a run of texts: first and last string start, hash of the anchor, hash of the whole."""

    _powers = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            size = max(n, 1 << 20)
            back = U64(pow(int(MULT), -1, 2**64))
            one = np.ones(size, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = MULT, back
            cls._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls._powers

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        n = len(data)
        self.first = self.last = self.anchor = self.whole = np.zeros(0, np.uint64)
        self.first = self.last = np.zeros(0, np.int64)
        size = np.diff(offsets)
        room = np.maximum(size - length + 1, 0)
        if not room.any():
            return
        up, down = self.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEY[data] * up[:n], out=total[1:])
        grams = mix((total[anchor:] - total[:-anchor]) * down[: n + 1 - anchor])
        bits = U64(int(n).bit_length())
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - anchor + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        keep = room > 0
        ends = np.cumsum(room[keep])
        at = np.arange(ends[-1]) - np.repeat(ends - room[keep] - offsets[:-1][keep], room[keep])
        place = (low[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.last = at[begin], at[np.append(begin[1:], len(at)) - 1]
        self.anchor = grams[place[begin]]
        end = self.last + length
        inside = (place[begin] - self.first).astype(np.uint64)
        self.whole = mix((total[end] - total[self.first]) * down[self.first] + mix((end - self.first).astype(np.uint64) * MULT2 + inside))


def _texts(group: pa.Table, length: int, anchor: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, Regions, int, int]]:
    release()
    data, offsets = utf8(group.column("text"))
    for i, j in slices(offsets, limit):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield part, at, Regions(part, at, length, anchor), i, j


def _packed(part: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.as_buffer() for x in part.column(name)]
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int64)


_SEEN = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("anchors", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("regions", pa.binary()), ("kinds", pa.binary())])
_SEEN_DDL = "bucket int, chunk int, anchors binary, least binary, most binary, regions binary, kinds binary"
_TOLD_DDL = "chunk int, anchors binary, kinds binary"
_SENT = pa.schema([("bucket", pa.int32()), ("hot", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("chunk", pa.int32()), ("anchors", pa.binary()), ("wholes", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
_SENT_DDL = "bucket int, hot long, i int, j int, side int, chunk int, anchors binary, wholes binary, counts binary, sizes binary, bytes binary"
_FLAGS_DDL = "chunk int, anchors binary, wholes binary, flags binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _distinct(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the distinct pairs, how often each occurs)."""
    order = np.lexsort((whole, anchor))
    a, w = anchor[order], whole[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(a)))


def _told(part: pa.Table) -> pa.Table:
    """For each chunk: its anchors that occur in several regions; kind 1 if all regions are alike, else the number of distinct ones (2 or more)."""
    anchor, n = _packed(part, "anchors", np.uint64)
    least, most, regions, kinds = (_packed(part, c, t)[0] for c, t in (("least", np.uint64), ("most", np.uint64), ("regions", np.int64), ("kinds", np.int64)))
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    total, sorts = np.add.reduceat(regions[order], first), np.add.reduceat(kinds[order], first)
    alike = np.minimum.reduceat(least[order], first) == np.maximum.reduceat(most[order], first)
    kind = np.where(total < 2, 0, np.where(alike, 1, np.maximum(sorts, 2)))
    keep = kind[group] > 0
    row = np.repeat(np.arange(len(n)), n)[keep]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    k, v = anchor[keep], kind[group][keep]
    rows = [(c, k[x:y].tobytes(), v[x:y].tobytes()) for c, x, y in zip(part.column("chunk").to_pylist(), at[:-1], at[1:]) if y > x]
    return _batch(rows, pa.schema([("chunk", pa.int32()), ("anchors", pa.binary()), ("kinds", pa.binary())]))


def _flags(part: pa.Table, length: int) -> pa.Table:
    """Per chunk and region of a shard (or a pair of shards): a bit for each string that repeats."""
    anchor, n = _packed(part, "anchors", np.uint64)
    whole, count, size = (_packed(part, c, t)[0] for c, t in (("wholes", np.uint64), ("counts", np.int64), ("sizes", np.int64)))
    text, _ = _packed(part, "bytes", np.uint8)
    side = np.repeat(np.array(part.column("side").to_pylist(), np.int64), n)
    place = np.cumsum(size) - size
    pick, _ = _distinct(anchor, whole)
    order = np.lexsort((whole, anchor))
    group = np.empty(len(anchor), np.int64)
    a, w = anchor[order], whole[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    group[order] = np.cumsum(new) - 1
    times = np.bincount(group, count)
    bits = np.zeros((len(pick), _FLAG_BYTES * 8), bool)
    bits[times > 1] = True
    i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()

    def gathered(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of these regions end to end, string starts, region of each start, offset in it)."""
        at, n_ = place[pick[which]], size[pick[which]]
        begin = np.cumsum(n_) - n_
        rows = np.repeat(at - begin, n_) + np.arange(int(n_.sum()))
        strings = n_ - length + 1
        first = np.cumsum(strings) - strings
        offset = np.arange(int(strings.sum())) - np.repeat(first, strings)
        return text[rows], np.repeat(begin, strings) + offset, np.repeat(which, strings), offset

    if i == j:
        ends = np.cumsum(size[pick])
        run = ends // SHARD_BYTES
        own = anchor[pick]
        # a shard ends where its bytes are full and the anchor changes; an anchor by itself among its regions has nothing to find
        cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]))))
        several = np.repeat(np.diff(np.append(cut, len(own))) > 1, np.diff(np.append(cut, len(own))))
        shard = np.repeat(run[cut], np.diff(np.append(cut, len(own))))
        for s in np.unique(shard):
            which = np.flatnonzero((shard == s) & several)
            if len(which):
                t, starts, region, offset = gathered(which)
                hit = repeats(t, starts, length)
                bits[region[hit], offset[hit]] = True
    else:
        half = side[pick]
        one, two = np.flatnonzero(half == i), np.flatnonzero(half == j)
        if len(one) and len(two):
            left, right = gathered(one), gathered(two)
            for x, y in ((left, right), (right, left)):
                hit = found_in(x[0], x[1], y[0], y[1], length)
                bits[x[2][hit], x[3][hit]] = True
    packed = np.packbits(bits, axis=1)
    at = np.concatenate(([0], np.cumsum(n)))
    rows = []
    for k, c in enumerate(part.column("chunk").to_pylist()):
        g = group[at[k] : at[k + 1]]
        some = bits[g].any(1)
        if some.any():
            rows.append((c, anchor[at[k] : at[k + 1]][some].tobytes(), whole[at[k] : at[k + 1]][some].tobytes(), packed[g[some]].tobytes()))
    return _batch(rows, pa.schema([("chunk", pa.int32()), ("anchors", pa.binary()), ("wholes", pa.binary()), ("flags", pa.binary())]))


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): bytes covered by a string of ``length`` that starts elsewhere, too, are gone.

    All copies lose them, the first as well. Null texts are empty; texts under ``length`` stay whole; repeated rows count as
    places of their own; null ids pass. An empty table gives no rows; other columns are ignored.
    """
    if length > LENGTH or anchor >= length:
        raise ValueError(f"length must be {LENGTH} at most and over the anchor")
    chunks = chunks_of(docs)
    n = chunks // 2
    texts = chunked(docs, chunks)

    def seen(group: pa.Table) -> pa.Table:
        found = [(r.anchor, r.whole) for _, _, r, _, _ in _texts(group, length, anchor)]
        a, w = (np.concatenate([f[k] for f in found]) for k in range(2))
        if not len(a):
            return _batch([], _SEEN)
        pick, times = _distinct(a, w)
        a, w = a[pick], w[pick]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        key, least, most = a[first], w[first], w[np.append(first[1:], len(a)) - 1]
        regions, kinds = np.add.reduceat(times, first), np.diff(np.append(first, len(a)))
        chunk = group.column("chunk")[0].as_py()
        return _batch([(b, chunk, *(x[k].tobytes() for x in (key, least, most, regions, kinds))) for b, k in by_bucket(key, n)], _SEEN)

    def told(part: pa.Table) -> pa.Table:
        return _told(part)

    def sent(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        if not group.num_rows or not answer.num_rows:
            return _batch([], _SENT)
        names, kinds = _packed(answer, "anchors", np.uint64)[0], _packed(answer, "kinds", np.int64)[0]
        order = np.argsort(names)
        names, kinds = names[order], kinds[order]
        a, w, raw, sizes = [], [], [], []
        for data, _, r, _, _ in _texts(group, length, anchor):
            at = np.minimum(np.searchsorted(names, r.anchor), len(names) - 1)
            some = np.flatnonzero((names[at] == r.anchor) & (kinds[at] > 1))
            a.append(r.anchor[some]), w.append(r.whole[some])
            for s, e in zip(r.first[some].tolist(), (r.last[some] + length).tolist()):
                raw.append(data[s:e].tobytes())
                sizes.append(e - s)
        a, w = np.concatenate(a), np.concatenate(w)
        if not len(a):
            return _batch([], _SENT)
        pick, times = _distinct(a, w)
        a, w, sizes = a[pick], w[pick], np.array(sizes, np.int64)[pick]
        split = -(-kinds[np.searchsorted(names, a)] // HOT)
        sub = (w % split.astype(np.uint64)).astype(np.int64)
        chunk, rows = group.column("chunk")[0].as_py(), []

        def add(b: int, hot: int, i: int, j: int, side: int, k: np.ndarray) -> None:
            rows.append((b, hot, i, j, side, chunk, a[k].tobytes(), w[k].tobytes(), times[k].tobytes(), sizes[k].tobytes(), b"".join([raw[x] for x in pick[k]])))

        usual = np.flatnonzero(split == 1)
        for b, k in by_bucket(a[usual], 4 * n):
            add(b, 0, 0, 0, 0, usual[k])
        hot = np.flatnonzero(split > 1)
        for name in np.unique(a[hot]):
            k = hot[a[hot] == name]
            for side in np.unique(sub[k]).tolist():
                for other in range(int(split[k[0]])):
                    add(0, int(name.view(np.int64)), min(side, other), max(side, other), side, k[sub[k] == side])
        return _batch(rows, _SENT)

    def flagged(part: pa.Table) -> pa.Table:
        return _flags(part, length)

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def removed(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        a, sizes = _packed(answer, "anchors", np.uint64)
        w = _packed(answer, "wholes", np.uint64)[0]
        flags = _packed(answer, "flags", np.uint8)[0].reshape(-1, _FLAG_BYTES)
        order = np.lexsort((w, a))
        a, w, flags = a[order], w[order], flags[order]
        pair = mix(a + mix(w))
        order = np.argsort(pair, kind="stable")
        pair, flags = pair[order], flags[order]
        ids, out = group.column("doc_id").to_pylist(), []
        for data, at, r, i, j in _texts(group, length, anchor):
            cover = np.zeros(len(data) + 1, np.int64)
            # an answer for all regions of an anchor has 0 for the region
            for mine in (mix(r.anchor + mix(np.zeros(len(r.anchor), np.uint64))), mix(r.anchor + mix(r.whole))):
                low, high = np.searchsorted(pair, mine, "left"), np.searchsorted(pair, mine, "right")
                for d in range(int((high - low).max(initial=0))):
                    some = np.flatnonzero(low + d < high)
                    bits = np.unpackbits(flags[low[some] + d], axis=1).astype(bool)
                    bits[np.arange(bits.shape[1]) > (r.last - r.first)[some][:, None]] = False
                    row, offset = np.nonzero(bits)
                    where = r.first[some[row]] + offset
                    np.add.at(cover, where, 1)
                    np.subtract.at(cover, where + length, 1)
            gone = np.cumsum(cover[:-1]) > 0
            for d in range(j - i):
                mine = gone[at[d] : at[d + 1]]
                kept = data[at[d] : at[d + 1]][~mine].tobytes()
                spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
                out.append((ids[i + d], len(mine), int(mine.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
        types = (*[pa.int64()] * 4, pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    shared = stage(texts.groupBy("chunk").applyInArrow(seen, _SEEN_DDL).groupBy("bucket").applyInArrow(told, _TOLD_DDL), "anchors")
    flags = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(sent, _SENT_DDL).repartition(4 * n, "bucket", "hot", "i", "j").groupBy("bucket", "hot", "i", "j").applyInArrow(flagged, _FLAGS_DDL)

    def all_alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for chunk, names, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                some = np.frombuffer(names, np.uint64)[np.frombuffer(kinds, np.int64) == 1]
                if len(some):
                    rows.append((chunk, some.tobytes(), bytes(8 * len(some)), b"\xff" * (_FLAG_BYTES * len(some))))
            yield from _batch(rows, pa.schema([("chunk", pa.int32()), ("anchors", pa.binary()), ("wholes", pa.binary()), ("flags", pa.binary())])).to_batches()

    answers = flags.unionByName(shared.mapInArrow(all_alike, _FLAGS_DDL))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(removed, kind)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: strings of 400 bytes."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
