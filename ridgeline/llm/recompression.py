"""Substring deduplication by recompression.

Words are symbols. A first round names each maximal run of one symbol; each further round tosses a coin for every symbol (a bit of
its name) and names each pair of a heads symbol with the tails symbol after it. Names are 64-bit hashes of what they stand
for, so Spark's tasks give equal content equal names without asking each other, on all rows, in every round. What a symbol
stands for and where its bounds fall depends on few words around it; the rounds keep that span for each symbol, so equal
passages provably have the same symbols inside, wherever they occur.

Each 13-word window is witnessed by the symbol of most words, on any level, whose span it covers (of several, the smallest name),
and by its own name if it covers none. Equal windows have equal witnesses, so:

1. every chunk of documents sends the distinct witnesses it has, with its smallest and greatest doc_id, to the bucket of each name;
2. a bucket answers which are shared by several documents;
3. only windows with a shared witness are verified: they send a 96-bit name of their words with the smallest doc_id;
4. a bucket answers the smallest doc_id of all that have that window, and the chunk removes the words that an earlier document covers.

Chunks reduce what they send to distinct names, so a passage in a third of all documents is one record a chunk. Texts are
shuffled once; steps 1, 3 and 4 read that shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import MULT, MULT2, U64, Words, by_bucket, chunked, chunks_of, gram_rows, grams, group_min, member, mix, release, slices, utf8

WINDOW = 13
ROUNDS = 3
_NONE = U64(2**64 - 1)
#: Stands for a null id: before all others, like a document of that number.
_BEFORE_ALL = -(2**63)
_PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_PACKED_DDL = "bucket int, chunk int, keys binary, more binary, low binary, high binary"


class Level:
    """Symbols of a run of texts: name, first word, and the first and last word of what the symbol depends on."""

    def __init__(self, name, start, low, high, doc, new=None):
        self.name, self.start, self.low, self.high, self.doc = name, start, low, high, doc
        self.new = np.ones(len(name), bool) if new is None else new  # named in this round

    @classmethod
    def runs(cls, key: np.ndarray, doc: np.ndarray) -> Level:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(key))
        size = (end - start).astype(np.uint64)
        name = np.where(size > 1, mix(key[start] * MULT + size), key[start])
        return cls(name, start, start - 1, end, doc[start])

    def pairs(self, round_: int) -> Level:
        """Names each heads symbol with the tails symbol after it."""
        n = len(self.name)
        if not n:
            return self
        heads = (mix(self.name + U64(round_)) >> U64(17)) & U64(1) == 0
        same = self.doc[1:] == self.doc[:-1]
        joins = np.zeros(n, bool)
        joins[:-1] = heads[:-1] & ~heads[1:] & same
        joined = np.zeros(n, bool)
        joined[1:] = joins[:-1]
        # a heads symbol depends on what follows it, a tails symbol on what is before it, a pair on its two parts
        after_low, after_high = np.append(self.low[1:], 0), np.append(self.high[1:], 0)
        end = np.append(~same, True)
        after_low[end], after_high[end] = self.low[end], self.high[end] + 2 * WINDOW
        before_low, before_high = np.insert(self.low[:-1], 0, 0), np.insert(self.high[:-1], 0, 0)
        begin = np.insert(~same, 0, True)
        before_low[begin], before_high[begin] = self.low[begin] - 2 * WINDOW, self.high[begin]
        low = np.minimum(self.low, np.where(heads, after_low, before_low))
        high = np.maximum(self.high, np.where(heads, after_high, before_high))
        name = self.name.copy()
        left = np.flatnonzero(joins)
        name[left] = mix(self.name[left] * MULT + self.name[left + 1] * MULT2 + U64(round_))
        keep = ~joined
        return Level(name[keep], self.start[keep], low[keep], high[keep], self.doc[keep], joins[keep])


def witnesses(words: Words, window: int, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A name for each window in ``at``: of the symbol of most words that it covers, or ``own`` where it covers none."""
    level = Level.runs(words.key, words.doc())
    best = np.full(len(at), _NONE)
    n = len(words)
    for depth in range(ROUNDS + 1):
        if depth:
            level = level.pairs(depth)
        fits = level.new & (level.high - level.low < window)
        if not fits.any():
            continue
        low, high = level.low[fits], level.high[fits]
        span = np.minimum(np.append(level.start[1:], n) - level.start, 15)[fits]
        # the fewer words, the larger
        value = (mix(level.name[fits] + U64(depth + 100)) >> U64(4)) | ((15 - span).astype(np.uint64) << U64(60))
        # both ends of the spans rise from symbol to symbol, so the symbols that a window covers follow each other
        begin = np.cumsum(np.bincount(low + 2, minlength=n + window + 2))[at + 1].astype(np.int32)
        size = np.cumsum(np.bincount(high + 1, minlength=n + window + 2))[at + window].astype(np.int32) - begin
        width = 1
        least = value  # of ``width`` symbols from each on
        while True:
            some = np.flatnonzero((size >= width) & (size < 2 * width))
            if len(some):
                i = begin[some]
                best[some] = np.minimum(best[some], np.minimum(least[i], least[i + size[some] - width]))
            if 2 * width > len(value) or not (size >= 2 * width).any():
                break
            least = np.minimum(least[:-width], least[width:])
            width *= 2
    return np.where(best == _NONE, mix(own ^ MULT2), best)


def _texts(group: pa.Table, limit: int = 1 << 20) -> Iterator[tuple[Words, np.ndarray, int, int]]:
    """(words, id of each text; nulls as the least number, rows i to j) for runs of the group's texts."""
    release()
    data, offsets = utf8(group.column("text"))
    ids = group.column("doc_id").combine_chunks().fill_null(_BEFORE_ALL).to_numpy()
    for i, j in slices(offsets, limit):
        yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), ids[i:j], i, j


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    at = gram_rows(words.first, window)
    return at, grams(words.key, window)[at]


def _second(words: Words, window: int) -> np.ndarray:
    """32 more bits of each window's name, from other values for bytes, words and places."""
    return (grams(words.keys(_SECOND), window, MULT2) >> U64(32)).astype(np.uint32)


def _pack(chunk: int, buckets: int, key, more, low, high) -> pa.RecordBatch:
    order = np.argsort(low, kind="stable")  # ids next to each other compress
    key, low, high = key[order], low[order], high[order]
    more = more[order] if more is not None else None
    rows = [(b, chunk, key[k].tobytes(), more[k].tobytes() if more is not None else b"", low[k].tobytes(), high[k].tobytes()) for b, k in by_bucket(key, buckets)]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)] if rows else [pa.array([], f.type) for f in _PACKED], schema=_PACKED)


def _column(part: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, values a row) of a packed column."""
    raw = [x.as_buffer() for x in part.column(name)]
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) // np.dtype(kind).itemsize for x in raw], np.int64)


def _answers(part: pa.Table, shared_only: bool) -> pa.Table:
    """For each chunk: its names that a document with another id has (shared_only), or those with the smallest id of all."""
    key, n = _column(part, "keys", np.uint64)
    low, _ = _column(part, "low", np.int64)
    high, _ = _column(part, "high", np.int64)
    more, _ = _column(part, "more", np.uint32)
    pair = np.stack([key, more.astype(np.uint64)], 1) if len(more) else key[:, None]
    order = np.lexsort(pair.T[::-1])
    p = pair[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    group = np.empty(len(p), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    # a chunk needs those that reach beyond it or, to remove words, those that an earlier document has
    keep = (least < most)[group] if shared_only else least[group] < high
    row = np.repeat(np.arange(len(n)), n)[keep]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    k, v, s = key[keep], least[group][keep], more[keep] if len(more) else key[:0]
    rows = [(c, k[a:b].tobytes(), s[a:b].tobytes() if len(s) else b"", b"" if shared_only else v[a:b].tobytes()) for c, a, b in zip(part.column("chunk").to_pylist(), at[:-1], at[1:]) if b > a]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), *[pa.binary()] * 3))], names=["chunk", "keys", "more", "least"])


_ANSWER_DDL = "chunk int, keys binary, more binary, least binary"


def _sorted(answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, _ = _column(answer, "keys", np.uint64)
    more, _ = _column(answer, "more", np.uint32)
    least, _ = _column(answer, "least", np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], more[order] if len(more) else more, least[order] if len(least) else least


def deduplicate(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): words covered by a window that a smaller doc_id has, too, are gone.

    Null and empty texts have no words. Rows with equal doc_ids are one document for what counts as earlier: they keep what they
    share. A null doc_id comes before all others (one of -2^63 counts as the same document). An empty table gives no rows; other columns are ignored.
    """
    chunks = chunks_of(docs)
    n = chunks // 2
    texts = chunked(docs, chunks)

    def witnessed(group: pa.Table) -> pa.Table:
        keys, lows, highs = [], [], []
        for words, ids, _, _ in _texts(group):
            at, own = _windows(words, window)
            k, lo, hi = group_min(witnesses(words, window, at, own), ids[words.doc()[at]])
            keys.append(k), lows.append(lo), highs.append(hi)
        key, low, high = (np.concatenate(x) for x in (keys, lows, highs))
        key, low, high = _merge(key, low, high)
        return pa.Table.from_batches([_pack(group.column("chunk")[0].as_py(), n, key, None, low, high)])

    def _verified(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        shared, _, _ = _sorted(answer)
        shared = np.unique(shared)
        one, two, who = [], [], []
        for words, ids, _, _ in _texts(group):
            at, own = _windows(words, window)
            found, _ = member(shared, witnesses(words, window, at, own))
            at = at[found]
            one.append(own[found]), two.append(_second(words, window)[at]), who.append(ids[words.doc()[at]])
        if not one:
            return pa.Table.from_batches([], schema=_PACKED)
        one, two, who = map(np.concatenate, (one, two, who))
        order = np.lexsort((who, two, one))
        one, two, who = one[order], two[order], who[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(one)) - 1
        return pa.Table.from_batches([_pack(group.column("chunk")[0].as_py(), n, one[first], two[first], who[first], who[last] if len(first) else who)])

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def _removed(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        one, two, least = _sorted(answer)
        out, names = [], group.column("doc_id").to_pylist()
        for words, ids, i, j in _texts(group):
            at, own = _windows(words, window)
            gone = np.zeros(len(words) + 1, np.int64)
            found, _ = member(one, own)
            if len(found):
                where = at[found]
                second = _second(words, window)[where]
                begin, end = np.searchsorted(one, own[found], "left"), np.searchsorted(one, own[found], "right")
                mine = ids[words.doc()[where]]
                hit = np.zeros(len(found), bool)
                for d in range(int((end - begin).max())):  # more than one only where first halves of names collide
                    k = np.minimum(begin + d, len(one) - 1)
                    hit |= (begin + d < end) & (two[k] == second) & (least[k] < mine)
                np.add.at(gone, where[hit], 1)
                np.subtract.at(gone, where[hit] + window, 1)
            covered = np.cumsum(gone[:-1]) > 0
            raw = words.data.tobytes()
            for d in range(j - i):
                a, b = words.first[d], words.first[d + 1]
                stay = np.flatnonzero(~covered[a:b]) + a
                kept = b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist())])
                out.append((names[i + d], int(b - a), int(b - a - len(stay)), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))[: 4 + with_text])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    # inner functions with the argument lists that Spark inspects
    def verified(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        return _verified(key, group, answer) if group.num_rows else pa.Table.from_batches([], schema=_PACKED)

    def removed(key: tuple, group: pa.Table, answer: pa.Table) -> pa.Table:
        return _removed(key, group, answer)

    def shared(part: pa.Table) -> pa.Table:
        return _answers(part, True)

    def earliest(part: pa.Table) -> pa.Table:
        return _answers(part, False)

    first = texts.groupBy("chunk").applyInArrow(witnessed, _PACKED_DDL).groupBy("bucket").applyInArrow(shared, _ANSWER_DDL)
    second = texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(verified, _PACKED_DDL).groupBy("bucket").applyInArrow(earliest, _ANSWER_DDL)
    return texts.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(removed, kind)


#: Byte values of the second half of names, independent of the first.
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * MULT2) | U64(1)


def _merge(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(key):
        return key, low, high
    order = np.argsort(key, kind="stable")
    k, lo, hi = key[order], low[order], high[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return k[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: windows of 13 words."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


_LIST = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_LIST} AS w FROM documents),
p AS (SELECT doc_id, k, w[k : k + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM p JOIN m USING (g) WHERE least < doc_id),
n AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
