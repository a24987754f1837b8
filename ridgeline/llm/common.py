"""Pieces that several operators share: the shared folder, word hashing in numpy, packed exchanges."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.staging import discard, fresh, passing, shared_dir, stage  # noqa: F401

U64 = np.uint64
#: Words are runs of bytes other than space and \t..\r; UTF-8 continuation and lead bytes are never among these.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte value, and the same with A-Z folded on a-z.
BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_KEY_LOWER = BYTE_KEY.copy()
BYTE_KEY_LOWER[65:91] = BYTE_KEY[97:123]
MULT = U64(0x9E3779B97F4A7C15)
MULT2 = U64(0xC2B2AE3D27D4EB4F)


#: Bytes of text that one chunk has, about: what one Python worker holds at a time.
CHUNK_BYTES = 4 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks_of(docs: DataFrame) -> int:
    """How many chunks a table is dealt to: by its bytes, and two for each shuffle partition at least."""
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), -(-size // CHUNK_BYTES))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give back what a Python worker keeps from earlier work: free heap, and the encoder of an operator that has ended."""
    if tokens := sys.modules.get("ridgeline.llm.tokens"):
        tokens.encoder.cache_clear()
    trim()


def trim() -> None:
    """Give free heap back."""
    pa.default_memory_pool().release_unused()
    if call := getattr(ctypes.CDLL(None), "malloc_trim", None):
        call(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts, end to end; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a run of texts: byte spans ``start``/``end``, ``first[d]:first[d+1]`` the words of text d, 64-bit ``key`` of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, keys: bool = True, space: np.ndarray = _SPACE):
        inside = ~space[data]
        n = len(data)
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        if n:
            before[0] = False
        cuts = offsets[:-1]
        cuts = cuts[cuts < n]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
        ends = offsets[1:-1]
        after[ends[ends > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data, self.offsets, self.inside = data, offsets, inside
        if keys:
            self.key = self.keys(BYTE_KEY_LOWER if lower else BYTE_KEY)

    def keys(self, table: np.ndarray, mult: np.uint64 = MULT) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        letters = self.data[self.inside]
        at = np.cumsum(size) - size
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
        powers = np.cumprod(np.full(int(size.max()), mult, np.uint64))
        return mix(np.add.reduceat(table[letters] * powers[place], at) ^ size.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte or word) over each text."""
    if values.dtype.kind == "f":  # each text by itself, so that a sum does not depend on what is around it
        out = np.zeros((len(offsets) - 1, *values.shape[1:]))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            out[some] = np.add.reduceat(values, offsets[some], axis=0, dtype=np.float64)
        return out
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def sampled_labels(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of the ``limit`` labelled rows with the smallest hash of doc_id (null texts and labels left out)."""
    few = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    few = (few if where is None else few.where(where)).orderBy(F.xxhash64("_id"), "_id", "_label").limit(limit)
    rows = clean(docs).where(F.col("text").isNotNull()).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    rows = sorted(map(tuple, rows.collect()))  # ``limit`` rows, unless documents repeat an id
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.float64)


def platt(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * raw + b))) fits the labels, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    if not len(raw) or label.min() == label.max():
        return a, b
    x = np.stack([raw, np.ones(len(raw))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        grad = x @ (label - p) - np.array([1e-3 * (a - 1), 0])
        hess = (x * (p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


def grams(key: np.ndarray, n: int, mult: np.uint64 = MULT) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 have none."""
    m = max(0, len(key) - n + 1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total *= mult
        total += key[j : j + m]
    return mix(total)


def gram_rows(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word windows that stay within one text."""
    count = np.diff(first) - n + 1
    keep = count > 0
    if not keep.any():
        return np.zeros(0, np.int64)
    count, base = count[keep], first[:-1][keep]
    total = np.cumsum(count)
    return np.arange(total[-1]) - np.repeat(total - count - base, count)


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 2000 rows and 16 MB at most, unless the session says otherwise: long texts then need no more memory."""
    for key, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(16 << 20))):
        if spark.conf.get(key, None) in (usual, None) or usual is None:
            spark.conf.set(key, most)


def clean(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and what else is named, whatever other columns there are."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def chunked(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt to n chunks of about equal size: equal rows meet, equal ids of unequal text need not."""
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return clean(docs).select(chunk.alias("chunk"), "doc_id", "text").repartition(n, "chunk")


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) by a hash of the key, since keys that are minima of others are not spread evenly."""
    if not len(keys):
        return
    bucket = ((mix(keys ^ MULT2) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if cut[b] < cut[b + 1]:
            yield b, order[cut[b] : cut[b + 1]]


def group_min(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least and greatest value of each)."""
    if not len(key):
        return key, value, value
    order = np.lexsort((value, key))
    k, v = key[order], value[order]
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[cut], v[cut], v[np.concatenate((cut[1:], [len(k)])) - 1]


def member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``keys`` of those in sorted distinct keys, their places there); most are told apart by 22 bits already."""
    if not len(sorted_keys) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 22, bool)
    seen[sorted_keys * MULT2 >> U64(42)] = True
    some = np.flatnonzero(seen[keys * MULT2 >> U64(42)])
    at = np.minimum(np.searchsorted(sorted_keys, keys[some]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == keys[some]
    return some[hit], at[hit]


def table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """mapInArrow function from a function of one batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return run
