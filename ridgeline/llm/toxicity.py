"""Toxicity: a convolutional text classifier trained in numpy.

A word (a run of letters, in lower case for A-Z) is the two rows that two hashes of it pick from two embedding tables, so that two
words look alike only if both hashes agree. Filters of several widths run over all words of a text, each keeps its
greatest response (max pooling), and a logistic layer scores these. Training takes a bounded sample of labelled whole
texts (``SAMPLE`` rows); the first embedding dimension starts at each slot's association with the label, so that the filters
begin with a signal to sharpen. Scores are calibrated on a part that training leaves out, and so is a threshold for each
language, which a text's language selects after it is scored; the language is no input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import Words, bound_batches, clean, fold, platt, release, sampled_labels, slices, utf8

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
SLOT_BITS, DIMS, WIDTHS, FILTERS = 15, 6, (1, 2, 3), 12
#: A text is toxic from this score on, unless its language has a threshold of its own.
THRESHOLD = 0.3
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(65, 91), *range(97, 123)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first slot, second slot, word offsets by text); every text has WIDTHS[-1] empty words more, so none is too short."""
    words = Words(data, offsets, lower=True, space=_BREAK)
    n, pad = np.diff(words.first), max(WIDTHS)
    first = np.concatenate(([0], np.cumsum(n + pad)))
    at = np.arange(len(words)) + pad * words.doc()
    one, two = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32)
    mask = (1 << SLOT_BITS) - 2
    one[at] = 1 + (words.key.astype(np.int64) & (2**62 - 1)) % mask
    two[at] = 1 + (words.key >> np.uint64(33)).astype(np.int64) % mask
    return one, two, first


@dataclass
class Model:
    tables: np.ndarray  # (2, slots, DIMS)
    filters: list[np.ndarray] = field(default_factory=list)  # by width: (width, 2 * DIMS, FILTERS)
    biases: list[np.ndarray] = field(default_factory=list)
    weight: np.ndarray | None = None
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, one: np.ndarray, two: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(greatest response of each filter in each text, responses by width)."""
        x = np.concatenate((self.tables[0][one], self.tables[1][two]), 1)
        out, all_ = [], []
        for width, kernel, bias in zip(WIDTHS, self.filters, self.biases):
            y = x @ kernel[0]
            for j in range(1, width):
                y[:-j] += x[j:] @ kernel[j]
            for j in range(1, width):  # windows that reach into the next text
                y[first[1:] - j] = -np.inf
            all_.append(y)
            out.append(np.maximum.reduceat(y, first[:-1]) + bias)
        return np.concatenate(out, 1), all_

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        p, _ = self.pooled(*tokens(data, offsets))
        return np.maximum(p, 0) @ self.weight + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(data, offsets) + b, -30, 30)))

    @staticmethod
    def held(n: int) -> np.ndarray:
        """Which of n rows training leaves out, for calibration."""
        return np.arange(n) % 5 == 4

    @classmethod
    def fit(cls, texts: list[str], label: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01) -> Model:
        rng, n_slots = np.random.default_rng(7), 1 << SLOT_BITS
        model = cls(rng.normal(0, 0.05, (2, n_slots, DIMS)).astype(np.float32))
        model.filters = [rng.normal(0, 0.1, (w, 2 * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        model.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        model.weight, model.bias = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0
        if not len(label) or label.min() == label.max():
            model.weight[:] = 0
            model.bias = 30.0 if len(label) and label.max() else -30.0  # the one label there is, or nothing to call toxic
            return model
        held = cls.held(len(label))
        train = np.flatnonzero(~held)
        rows = []
        for t in texts:
            data, offsets = utf8(pa.array([t], pa.large_string()))
            rows.append(tokens(data, offsets)[:2])
        share = label[train].mean()
        for table in range(2):  # association of each slot with the label: deviations from what chance gives
            n, toxic = np.zeros(n_slots), np.zeros(n_slots)
            for i in train:
                slot = np.unique(rows[i][table])
                n[slot] += 1
                toxic[slot] += label[i]
            model.tables[table, :, 0] = np.clip((toxic - share * n) / np.sqrt(share * (1 - share) * n + 2), -3, 6) / 3
        for w, kernel in enumerate(model.filters):
            kernel[0, [0, DIMS], :3] = 1
            model.biases[w][:3] = [-1.5, -2.0, -2.5]
        model.weight[[0, 1, 2]] = 1
        model.bias = float(np.log(share / (1 - share)))
        moments = [np.zeros_like(x) for x in (*model.filters, *model.biases, model.weight)]
        bias_moment = 0.0
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            order = rng.permutation(train)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                one, two = (np.concatenate([rows[i][t] for i in some]) for t in range(2))
                first = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in some])))
                p, responses = model.pooled(one, two, first)
                a = np.maximum(p, 0)
                r = (1 / (1 + np.exp(-np.clip(a @ model.weight + model.bias, -30, 30))) - label[some]) / len(some)
                back = np.outer(r, model.weight) * (p > 0)
                x = np.concatenate((model.tables[0][one], model.tables[1][two]), 1)
                grads_f, grads_b, touched = [], [], []
                for w, width in enumerate(WIDTHS):
                    g = back[:, w * FILTERS : (w + 1) * FILTERS].astype(np.float32)
                    top = np.empty((len(some), FILTERS), np.int64)
                    for d in range(len(some)):
                        top[d] = first[d] + responses[w][first[d] : first[d + 1]].argmax(0)
                    grad = np.empty_like(model.filters[w])
                    for j in range(width):
                        grad[j] = np.einsum("dfk,df->kf", x[top + j], g)
                        touched.append((top + j, np.einsum("df,kf->dfk", g, model.filters[w][j])))
                    grads_f.append(grad)
                    grads_b.append(g.sum(0))
                for k, (value, grad) in enumerate(zip((*model.filters, *model.biases, model.weight), (*grads_f, *grads_b, (r @ a).astype(np.float32)))):
                    moments[k] = 0.95 * moments[k] + 0.05 * grad * grad
                    value -= (step * grad / (np.sqrt(moments[k]) + 1e-4)).astype(np.float32)
                bias_moment = 0.95 * bias_moment + 0.05 * r.sum() ** 2
                model.bias -= float(step * r.sum() / (np.sqrt(bias_moment) + 1e-4))
                for place, grad in touched:
                    np.add.at(model.tables[0], one[place], -step * 10 * grad[..., :DIMS])
                    np.add.at(model.tables[1], two[place], -step * 10 * grad[..., DIMS:])
        data, offsets = utf8(pa.array([texts[i] for i in np.flatnonzero(held)], pa.large_string()))
        raw = np.concatenate([model.raw(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20)])
        model.scale = platt(raw, label[held])
        return model

    def calibrate(self, texts: list[str], label: np.ndarray, language: list[str | None], least: int = 20) -> None:
        """For each language with ``least`` toxic texts: the threshold from 0.1 to 0.6 with the best F1, of equals the nearest to THRESHOLD."""
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        score = np.concatenate([np.zeros(0), *(self.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 20))])
        tongue = np.array([x or "" for x in language])
        for name in sorted(set(tongue) - {""}):
            s, y = score[tongue == name], label[tongue == name]
            if y.sum() >= least:
                f1 = {t: 2 * (y * (s >= t)).sum() / max(1, y.sum() + (s >= t).sum()) for t in np.round(np.arange(0.1, 0.61, 0.05), 2)}
                self.thresholds[name] = float(max(f1, key=lambda t: (round(f1[t], 6), -abs(t - THRESHOLD))))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """``where``: which of the labels (by ``_id``) may be learnt from. Without both labels every score is near the one there is, without any near 0."""
    texts, label = sampled_labels(docs, labels, "toxic", SAMPLE, where)
    return Model.fit(texts, label)


def fit_with_languages(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """As ``fit``, with thresholds by language from the part of the sample that training leaves out."""
    tagged = docs.withColumn("text", F.to_json(F.struct(F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l"))))
    import json

    rows, label = sampled_labels(tagged.where(docs["text"].isNotNull()), labels, "toxic", SAMPLE, where)
    pairs = [json.loads(x) for x in rows]
    model = Model.fit([p["t"] for p in pairs], label)
    held = Model.held(len(pairs))
    rest = [p for p, h in zip(pairs, held) if h]
    model.calibrate([p["t"] for p in rest], label[held], [p.get("l") for p in rest])
    return model


def classify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(doc_id, score, predicted[, kept columns]) for every row: predicted is 1 from THRESHOLD on.

    Null and empty texts are scored as texts without words; repeated rows and null ids stay; columns not named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SLOT_BITS, DIMS and FILTERS
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    names = ["doc_id", *keep, "score", "predicted"]
    kind = ", ".join([f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names[:-2]] + ["score double", "predicted int"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, 1 << 19):
                score = shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                columns = [*(batch.column(c).slice(i, j - i) for c in names[:-2]), pa.array(score.astype(np.float64)), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(run, kind)


def rejected(scored: DataFrame, model: Model, language: str = "lang") -> Column:
    """Whether a scored row reaches its language's threshold."""
    if not model.thresholds:
        return scored["score"] >= THRESHOLD
    own = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv]), F.coalesce(scored[language], F.lit("")))
    return scored["score"] >= F.coalesce(own, F.lit(THRESHOLD))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four folds, scores all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("_id", 4) != 2)
    return classify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
