"""Quality rules: exact counts of each text, and a calibrated logistic regression over hashed word and character n-grams.

Features are shares: how much of a text's words, word pairs and byte trigrams falls on each hashed slot. The model is fitted in numpy
on a bounded sample of labelled whole texts (``SAMPLE`` rows), calibrated on a fifth that training leaves out, and applied in
Arrow batches with the fixed thresholds below. Long texts are no special case: all of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import MULT2, U64, Words, clean, gram_rows, grams, mix, per_text, platt, sampled_labels, slices, trim, utf8

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
WORD_BITS, CHAR_BITS = 18, 16
#: A text is kept if its calibrated probability of good quality is this or more.
KEEP = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found twice or more in its text, is it found earlier in its text)."""
    mixed = mix(key + doc.astype(np.uint64) * MULT2)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets, doc = words.data, words.offsets, words.doc()
    out = {"n_words": np.diff(words.first), "word_chars": per_text(words.inside & ~_CONTINUES[data], offsets), "n_symbols": per_text(_SYMBOL[data], offsets)}
    lines = Words(data, offsets, space=_LINE_END)
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    _, later = repeated(lines.key[worded], lines.doc()[worded])
    out["n_dup_lines"] = np.bincount(lines.doc()[worded], later, len(offsets) - 1).astype(np.int64)
    at = gram_rows(words.first, 3)
    twice, _ = repeated(grams(words.key, 3)[at], doc[at])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = per_text(covered, words.first)
    return out


def slots(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first slot of its kind, slot of each n-gram, offsets by text): words, word pairs, byte trigrams."""
    top = U64(64 - WORD_BITS)
    pairs = gram_rows(words.first, 2)
    pair_doc = words.doc()[pairs]
    of_pairs = np.searchsorted(pair_doc, np.arange(len(words.offsets)))
    d = words.data.astype(np.uint32)
    tri = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) if len(d) > 2 else d[:0]
    within = gram_rows(words.offsets, 3)  # none reaches into the next text
    ends = np.concatenate(([0], np.cumsum(np.maximum(np.diff(words.offsets) - 2, 0))))
    chars = (tri[within] * np.uint32(0x9E3779B1) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
    return [
        ((words.key >> top).astype(np.int64), words.first),
        ((grams(words.key, 2, MULT2)[pairs] >> top).astype(np.int64) + (1 << WORD_BITS), of_pairs),
        (chars + (2 << WORD_BITS), ends),
    ]


@dataclass
class _Part:
    """Shares of one kind in a run of texts, by text: texts ``first`` on have ``many`` entries each. What fitting holds of a text is 12 bytes a distinct n-gram."""

    first: int
    many: np.ndarray
    slot: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, first: int, slot: np.ndarray, at: np.ndarray) -> _Part:
        sizes = np.diff(at)
        key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 32 | slot, return_counts=True)
        d = key >> 32
        return cls(first, np.bincount(d, minlength=len(sizes)), (key & 0xFFFFFFFF).astype(np.int32), n / sizes[d])


def _products(parts: list[_Part], w: np.ndarray, n: int) -> np.ndarray:
    """Sum over each text's entries of value and weight."""
    z = np.zeros(n)
    for p in parts:
        np.add.at(z, np.repeat(np.arange(p.first, p.first + len(p.many)), p.many), p.value * w[p.slot])
    return z


@dataclass
class Model:
    weight: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, words: Words) -> np.ndarray:
        total = np.full(len(words.offsets) - 1, self.bias)
        for slot, offsets in slots(words):
            total += per_text(self.weight[slot], offsets) / np.maximum(1, np.diff(offsets))
        return total

    def probability(self, words: Words) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(words) + b, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], label: np.ndarray, rounds: int = 150) -> Model:
        """Adam on the mean log loss of four fifths; without both labels everything has probability 0.5 or so."""
        size = (2 << WORD_BITS) + (1 << CHAR_BITS)
        model = cls(np.zeros(size, np.float32))
        if not len(label) or label.min() == label.max():
            return model
        held = np.arange(len(label)) % 5 == 4
        parts, seen = [], np.zeros(size, bool)
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        for i, j in slices(offsets, 1 << 20):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for s, at in slots(words):
                parts.append(_Part.of(i, s, at))
                seen[parts[-1].slot] = True
        del data, offsets, words
        used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
        squares = np.zeros(len(used))
        for p in parts:
            p.slot = place[p.slot]
            np.add.at(squares, p.slot, p.value * p.value)
        spread = 1 / np.sqrt(squares / len(label) + 1e-5)  # rare and common slots learn alike
        for p in parts:
            p.value *= spread[p.slot]
        trim()
        w, b = np.zeros(len(used)), float(np.log(label.mean() / (1 - label.mean())))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        train = ~held
        for t in range(1, rounds + 1):
            z = _products(parts, w, len(label)) + b
            r = np.where(train, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label, 0) / train.sum()
            g = np.zeros(len(used))
            for p in parts:
                np.add.at(g, p.slot, p.value * np.repeat(r[p.first : p.first + len(p.many)], p.many))
            g += 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            gb = r.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            b -= 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
        z = _products(parts, w, len(label)) + b
        model.weight[used], model.bias, model.scale = w * spread, b, platt(z[held], label[held])
        return model


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    return Model.fit(*sampled_labels(docs, labels, "quality", SAMPLE, where))


def assess(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """(doc_id, the counts, base_failed, probability, kept) for every row.

    A null or empty text has no words and fails; repeated rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by WORD_BITS and CHAR_BITS
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, 1 << 19):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                c, p = counts(words), shared.value.probability(words)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                columns = [batch.column("doc_id").slice(i, j - i), *(pa.array(c[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))]
                yield pa.record_batch(columns, names=["doc_id", *names, "base_failed", "probability", "kept"])

    return clean(docs).mapInArrow(run, kind)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
