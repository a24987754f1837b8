"""Benchmark decontamination: which documents contain which short test items.

An item's set is its distinct five-word shingles (A-Z lower-cased; fewer words: all of them as one). It is in a document that
holds ``THRESHOLD`` of the set. Items are partitioned by set size. Under one shared hash order the k smallest hashes of a set
of n are its MinHash sketch, with k = n - ceil(threshold * n) + 1 so that every document that reaches the threshold holds one
of the k at least, however long it is: estimates of Jaccard similarity would drown short items in long documents, sketches
looked up in the whole document do not. Each size class skips documents that are too short for it. What the sketches find
is verified by exact comparison of shingles, words and all.

A benchmark up to ``BROADCAST_BYTES`` goes to every task; a larger one is joined by sketch hash instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import Words, clean, gram_rows, grams, release, slices, stage, utf8

WORDS = 5
THRESHOLD = 0.8
BROADCAST_BYTES = 32 << 20
#: Beyond that: bits of the filter of sketch hashes, and shares of a hash that many documents hold.
BLOOM_BITS, SALTS = 25, 16
_PAIRS = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def shingles(text: str | None, sizes: set[int] = frozenset()) -> set[tuple[bytes, ...]]:
    """The set of a text; ``sizes``: these shorter lengths, too."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    out = {tuple(words[i : i + n]) for n in {WORDS, *sizes} for i in range(len(words) - n + 1)}
    return out or {tuple(words)}


def least(n: int, threshold: float) -> int:
    """The fewest of n shingles that reach the threshold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def item_hashes(text: str | None) -> np.ndarray:
    data, offsets = utf8(pa.array([text], pa.large_string()))
    words = Words(data, offsets, lower=True)
    return np.unique(grams(words.key, min(WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


@dataclass
class SizeClass:
    """Items of like size: ``key`` (sorted sketch hashes) and the item each is of; fewest shingles a document needs."""

    key: np.ndarray
    item: np.ndarray
    fewest: int


class Sketches:
    """Sketches of all items, by class of set size (powers of two)."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.sets = [shingles(t) for _, t in items]
        self.short = {n for s in self.sets if len(s) == 1 for x in s if (n := len(x)) < WORDS}
        by: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for k, (_, text) in enumerate(items):
            hashes = item_hashes(text)
            if n := len(hashes):
                by.setdefault(n.bit_length(), []).extend((h, k, n) for h in hashes[: n - least(n, threshold) + 1])
        self.classes = []
        self.filter = np.zeros(1 << 20, bool)
        for rows in by.values():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            self.filter[key >> np.uint64(44)] = True
            self.classes.append(SizeClass(key, np.array([r[1] for r in rows]), min(least(r[2], threshold) for r in rows)))

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) where the text holds a hash of the item's sketch."""
        found: set[tuple[int, int]] = set()
        doc = words.doc()
        for n in {WORDS, *self.short}:
            at = gram_rows(words.first, n)
            hashes = grams(words.key, n)[at]
            some = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
            hashes, of = hashes[some], doc[at[some]]
            room = np.diff(words.first)[of] - n + 1
            for c in self.classes:
                begin, end = np.searchsorted(c.key, hashes, "left"), np.searchsorted(c.key, hashes, "right")
                for k in np.flatnonzero((end > begin) & (room >= (c.fewest if n == WORDS else 1))):
                    found.update((int(of[k]), int(i)) for i in c.item[begin[k] : end[k]])
        return found

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) for all that reach the threshold."""
        data, offsets = utf8(texts)
        out = []
        for i, j in slices(offsets, 1 << 20):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
            last, own = None, set()
            for d, item in sorted(self.candidates(words)):
                if d != last:
                    last, own = d, shingles(texts[i + d].as_py(), self.short)
                shared = len(self.sets[item] & own)
                if shared >= least(len(self.sets[item]), self.threshold):
                    out.append((i + d, item, shared))
        return out


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs that reach the threshold, a row for each pair of rows.

    Null and empty texts hold nothing and are held by nothing; null ids pass; an empty table gives no rows; other columns
    are ignored.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _broadcast(docs, items, threshold) if size <= BROADCAST_BYTES else _joined(docs, items, threshold)


def _broadcast(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    rows = sorted(map(tuple, items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))  # BROADCAST_BYTES at most
    shared = docs.sparkSession.sparkContext.broadcast((rows, threshold))
    made: list[Sketches] = []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Sketches(*shared.value))
        release()
        for batch in it:
            if got := made[0].matches(batch.column("text")):
                n = [len(made[0].sets[k]) for _, k, _ in got]
                columns = [batch.column("doc_id").take(pa.array([d for d, _, _ in got])), pa.array([made[0].ids[k] for _, k, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for (_, _, s), m in zip(got, n)])]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    return clean(docs).mapInArrow(run, _PAIRS)


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """For a benchmark too large to broadcast: rows of sketch hashes meet rows of shingle hashes, then texts meet texts."""
    spark = docs.sparkSession
    lengths = items.select(F.size(F.filter(F.split(F.col("text"), r"[ \t-\r]+"), lambda w: w != "")).alias("n")).where(f"n BETWEEN 1 AND {WORDS - 1}").distinct()
    short = sorted(r["n"] for r in lengths.collect())  # four numbers at most: only lengths that items have are looked for

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key, text in zip(batch.column("_item").to_pylist(), batch.column("text").to_pylist()):
                hashes = item_hashes(text)
                if n := len(hashes):
                    hashes = hashes[: n - least(n, threshold) + 1].view(np.int64)
                    yield pa.record_batch([pa.array([key] * len(hashes), pa.int64()), pa.array(hashes)], names=["_item", "_hash"])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, 1 << 20):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                doc = np.asarray(batch.column("_doc").slice(i, j - i))
                for n in [WORDS, *short]:
                    at = gram_rows(words.first, n)
                    hashes, of = grams(words.key, n)[at], words.doc()[at]
                    for shift in shifts:
                        some = bits.value[(hashes >> np.uint64(shift)).astype(np.uint32) & mask]
                        hashes, of = hashes[some], of[some]
                    yield pa.record_batch([pa.array(doc[of]), pa.array(hashes.view(np.int64))], names=["_doc", "_hash"])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for doc_id, text, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item"))):
                own = shingles(item)
                n = len(own & shingles(text, {len(x) for x in own}))
                if n >= least(len(own), threshold):
                    rows.append((doc_id, item_id, n, len(own), n / len(own)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    # Keys of rows are hashes of what they hold, so a recomputed task makes them again; equal rows are told apart by count.
    documents = clean(docs).groupBy("doc_id", "text").agg(F.count("*").alias("_copies")).withColumn("_doc", F.xxhash64("doc_id", "text"))
    tests = items.groupBy("item_id", "text").agg(F.count("*").alias("_same")).withColumn("_item", F.xxhash64("item_id", "text"))
    sketches = stage(tests.select("_item", "text").mapInArrow(sketch, "_item long, _hash long").distinct(), "sketches")
    shifts, mask = (0, 29), np.uint32((1 << BLOOM_BITS) - 1)
    bits = spark.sparkContext.broadcast(_bloom(sketches, shifts, mask))  # of a fixed size: what no sketch has is not shuffled
    # what many documents hold is dealt by document, and the sketches with it to each share
    salted = sketches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = documents.select("_doc", "text").mapInArrow(hashed, "_doc long, _hash long").withColumn("_salt", F.pmod("_doc", F.lit(SALTS)).cast("int"))
    pairs = held.join(salted, ["_hash", "_salt"]).select("_doc", "_item").distinct()
    both = pairs.join(tests.withColumnRenamed("text", "item"), "_item").join(documents, "_doc").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies") * F.col("_same"))))
    return both.select("doc_id", "text", "item_id", "item").mapInArrow(verify, _PAIRS)


def _bloom(sketches: DataFrame, shifts: tuple[int, ...], mask: np.uint32) -> np.ndarray:
    """Which low bits (at each shift) some sketch hash has: set in each task, by slices, then put together."""
    width = 1 << 16

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(int(mask) + 1, bool)
        for batch in it:
            hashes = np.asarray(batch.column(0)).view(np.uint64)
            for shift in shifts:
                bits[(hashes >> np.uint64(shift)).astype(np.uint32) & mask] = True
        for k in np.flatnonzero(bits.reshape(-1, width).any(1)).tolist():
            yield pa.record_batch([pa.array([k]), pa.array([np.packbits(bits[k * width : (k + 1) * width]).tobytes()])], names=["slice", "bits"])

    def either(part: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("bits")]
        return pa.table({"slice": part.column("slice").slice(0, 1), "bits": [np.bitwise_or.reduce(rows).tobytes()]})

    kind = "slice long, bits binary"
    out = np.zeros(int(mask) + 1, bool)
    for row in sketches.select("_hash").mapInArrow(mark, kind).groupBy("slice").applyInArrow(either, kind).collect():  # 2^BLOOM_BITS bits in all
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: five words, containment of 0.8 or more."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = "list_filter(regexp_split_to_array(coalesce(" + _ASCII_LOWER.format("text") + r", ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, {_LIST} AS w FROM benchmark),
d AS (SELECT doc_id, {_LIST} AS w FROM documents),
s AS (SELECT DISTINCT item_id, n, w[k : k + n - 1] AS g
      FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
size AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
lengths AS (SELECT DISTINCT n FROM s),
t AS (SELECT DISTINCT doc_id, w[k : k + n - 1] AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_shingles::BIGINT AS n_shingles, count(*)::DOUBLE / n_shingles AS containment
FROM s JOIN t USING (g) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 100 * count(*) >= 80 * n_shingles
"""
