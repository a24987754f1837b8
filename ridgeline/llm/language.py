"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` long holds how often each byte followed. A byte that was seen after
the longest known context costs -log2 n / (t + q) (t: times, q: distinct bytes seen there); else an escape of q / (t + q)
leads to the next shorter context, without the bytes that the longer one would have coded (exclusion), down to equal
chances for all 256. The sums are exact code lengths of normalised distributions under frozen statistics; the language
with the shortest code wins. Nodes of all languages are kept together, each with a cost for every language, so scoring
looks each byte up once in most cases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import MULT, U64, clean, fold, per_text, slices, utf8

ORDER = 4
#: Training texts of each language: those with the smallest hash of doc_id, about this many, whole, as far as so many bytes go.
TEXTS_A_LANGUAGE, BYTES_A_LANGUAGE = 400, 4 << 20
#: Languages that are learnt: the most frequent ones, of equals the first by name.
LANGUAGES = 200
UNKNOWN = "und"


class Index:
    """Places of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = U64(64 - bits), U64((1 << bits) - 1)
        self.slot = np.full(1 << bits, U64(2**64 - 1))
        self.place = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        at = (keys * MULT) >> self.shift
        while len(left):
            free = self.slot[at[left]] == U64(2**64 - 1)
            some = left[free]
            _, first = np.unique(at[some], return_index=True)
            some = some[first]
            self.slot[at[some]] = keys[some]
            self.place[at[some]] = some
            left = left[self.slot[at[left]] != keys[left]]
            at[left] = (at[left] + U64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 if there is none."""
        at = (keys * MULT) >> self.shift
        got = self.slot[at]
        out = np.where(got == keys, self.place[at], np.int32(-1))
        left = np.flatnonzero((got != keys) & (got != U64(2**64 - 1)))
        while len(left):
            at[left] = (at[left] + U64(1)) & self.mask
            got = self.slot[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit & (got != U64(2**64 - 1))]
        return out


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) in lower case, each text after ORDER line feeds that count as its own context only."""
    data, at = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    n = np.diff(at)
    start = at[:-1] + ORDER * np.arange(1, len(at))
    out = np.full(len(data) + ORDER * len(n), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(start - at[:-1], n)] = data
    return out, np.stack([start, start + n])


def contexts(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The byte at each place with the ``order`` bytes before it, as a number."""
    key = np.zeros(len(at), np.uint64)
    for j in range(order, -1, -1):
        key = (key << U64(8)) | data[at - j].astype(np.uint64)
    return key


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    base: np.ndarray | None = None  # cost of each byte without context, for each language
    nodes: list[tuple[Index, np.ndarray]] = field(default_factory=list)  # by order: (context, byte) -> costs
    escapes: list[tuple[Index, np.ndarray]] = field(default_factory=list)  # by order: context -> costs of leaving it

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Model:
        names = sorted(texts)
        seen: list[list[tuple]] = []  # by order, by language: keys, counts, contexts, their place, total, distinct
        for order in range(ORDER + 1):
            row = []
            for name in names:
                data, span = padded(pa.array(texts[name], pa.large_string()))
                at = np.flatnonzero(np.repeat(np.tile([False, True], span.shape[1]), np.stack([np.full(span.shape[1], ORDER), span[1] - span[0]], 1).ravel()))
                keys, n = np.unique(contexts(data, at, order), return_counts=True)
                ctx, of = np.unique(keys >> U64(8), return_inverse=True)
                row.append((keys, n, ctx, of, np.bincount(of, n, len(ctx)), np.bincount(of, minlength=len(ctx))))
            seen.append(row)
        model = cls(names, np.zeros((256, len(names)), np.float32))
        below = None
        for order in range(ORDER + 1):
            keys = np.unique(np.concatenate([r[0] for r in seen[order]])) if order else np.arange(256, dtype=np.uint64)
            ctx = np.unique(keys >> U64(8))
            cost, leave = np.zeros((len(keys), len(names)), np.float32), np.zeros((len(ctx), len(names)), np.float32)
            lower = model.base[:0] if not order else below[1][np.searchsorted(below[0], keys & U64((1 << 8 * order) - 1))]
            for j, (k, n, c, of, total, distinct) in enumerate(seen[order]):
                p = n / (total + distinct)[of]
                if order:
                    k0, n0, _, of0, total0, distinct0 = seen[order - 1][j]
                    at = np.searchsorted(k0, k & U64((1 << 8 * order) - 1))
                    taken = np.bincount(of, n0[at] / (total0 + distinct0)[of0[at]], len(c))
                else:
                    taken = distinct / 256
                escape = distinct / (total + distinct)
                gone = -np.log2(escape / np.maximum(1 - taken, 1e-9))
                if len(c):
                    leave[np.searchsorted(ctx, c), j] = gone
                rest = 8.0 if not order else lower[:, j]
                cost[:, j] = rest + leave[np.searchsorted(ctx, keys >> U64(8)), j]
                cost[np.searchsorted(keys, k), j] = -np.log2(p)
            if order:
                model.nodes.append((Index(keys), cost))
                model.escapes.append((Index(ctx), leave))
            else:
                model.base = cost
            below = (keys, cost)
        return model

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text under each language, bytes of each text)."""
        data, span = padded(texts)
        size = span[1] - span[0]
        at = np.arange(int(size.sum())) + np.repeat(span[0] - (np.cumsum(size) - size), size)
        total = np.empty((len(at), len(self.languages)), np.float32)
        key = contexts(data, at, ORDER)
        place = self.nodes[-1][0].find(key)
        hit = place >= 0
        total[hit] = self.nodes[-1][1][place[hit]]
        left = np.flatnonzero(~hit)
        spent = np.zeros((len(left), len(self.languages)), np.float32)
        for order in range(ORDER, 0, -1):  # what is left leaves the context of this order
            index, cost = self.escapes[order - 1]
            place = index.find((key[left] >> U64(8)) & U64((1 << 8 * order) - 1))
            spent[place >= 0] += cost[place[place >= 0]]
            k = key[left] & U64((1 << 8 * order) - 1)
            if order == 1:
                total[left] = spent + self.base[k.astype(np.int64)]
                break
            place = self.nodes[order - 2][0].find(k)
            hit = place >= 0
            total[left[hit]] = spent[hit] + self.nodes[order - 2][1][place[hit]]
            left, spent = left[~hit], spent[~hit]
        return per_text(total, np.concatenate(([0], np.cumsum(size)))), size

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; texts that are null or without a letter are ``und`` with score 0."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        _, offsets = utf8(texts)
        for i, j in slices(offsets, 1 << 19):
            part = texts.slice(i, j - i)
            lettered = pc.match_substring_regex(part.cast(pa.large_string()), r"\p{L}").fill_null(False)
            some = np.flatnonzero(np.asarray(lettered)).tolist()
            if not some or not self.languages:
                continue
            bits, size = self.code_lengths(part.take(pa.array(some)).combine_chunks() if isinstance(part, pa.ChunkedArray) else part.take(pa.array(some)))
            odds = np.exp2(-(bits - bits.min(1, keepdims=True)) / np.maximum(1, np.sqrt(size))[:, None])
            best = bits.argmin(1)
            for k, b, p in zip(some, best, odds.max(1) / odds.sum(1)):
                names[i + k], scores[i + k] = self.languages[b], p
        return names, scores


def fit(docs: DataFrame, where=None) -> Model:
    """From whole texts of a bounded sample of rows with text and lang, chosen by hash of doc_id; text and lang only are learnt.

    The bound: LANGUAGES, TEXTS_A_LANGUAGE and BYTES_A_LANGUAGE; a longer text than that is none of the sample.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull())
    if where is not None:
        rows = rows.where(where)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return Model()
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, TEXTS_A_LANGUAGE / n)]), F.col("lang"))
    texts: dict[str, list[str]] = {}
    sample = rows.where(F.col("lang").isin(*counts)).where((share < rate) & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = sample.withColumn("_bytes", F.sum(F.octet_length("text").cast("long")).over(order)).where(F.col("_bytes") <= BYTES_A_LANGUAGE)
    for row in sample.select("doc_id", "lang", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return Model.fit({k: sorted(v) for k, v in texts.items() if any(v)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text's lang_pred and score) for every row; repeated rows and null ids stay. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names, scores = shared.value.predict(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return clean(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five folds, predicts all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, fold("doc_id", 5) != 0)
    return identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
