"""Vector functions as Column expressions, block products in Arrow, and an encoder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import batches

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """-1 if a vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (n == 0), -1.0).otherwise(dot(a, b) / n)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; a null is a row of zeros. All other rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0))
    dim = dim or int(size.max(initial=0))
    out = np.zeros((len(column), dim))
    have = size > 0
    if have.any():
        if (size[have] != dim).any():
            raise ValueError("vectors must have one length")
        out[have] = np.asarray(column.flatten().fill_null(0.0), np.float64).reshape(-1, dim)
    return out


def products(rows: np.ndarray, queries: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Scores of all rows against all queries, a block at a time; by cosine a zero vector has -1."""
    found = rows @ queries.T
    if metric != "cosine":
        return found
    sizes = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((queries * queries).sum(1))[None, :]
    return np.where(sizes == 0, -1.0, found / np.where(sizes == 0, 1.0, sizes))


class Encoder(Protocol):
    """Turns a text column into ``array<double>`` or null for blank texts."""

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


@lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIM


def _counted(texts: pa.Array) -> pa.Array:
    """Counts by bucket of each text's tokens; distinct tokens of a step are hashed once. texts: ``batches.lowered``."""
    parts = [_lists(*batches.tokens(part), len(part)) for _, part in batches.steps(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def _lists(row: np.ndarray, tokens: pa.Array, n: int) -> pa.Array:
    coded = tokens.dictionary_encode()
    bucket = np.array([_bucket(t) for t in coded.dictionary.to_pylist()], np.int64)
    at = bucket[np.asarray(coded.indices)] if len(row) else row
    counts = np.bincount(row * DIM + at, minlength=n * DIM).astype(np.float64)
    cut = np.arange(n + 1, dtype=np.int32) * DIM
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(counts))
    return pc.if_else(pa.array(np.bincount(row, minlength=n) > 0), lists, pa.scalar(None, lists.type))


def hashed_tf(df: DataFrame, text: str, out: str) -> DataFrame:
    """Counts of tokens by md5 bucket: the same value in any engine with md5; blank texts have no vector."""
    return df.withColumn(out, F.arrow_udf(_counted, "array<double>")(batches.lowered(F.col(text))))


def pandas_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "") -> Encoder:
    """Encoder from a model's batch function: blank texts are null, vectors have length 1.

    ``load`` gives the function; each Python worker calls it once for all its batches, not once a batch.
    """

    def apply(df: DataFrame, text: str, out: str) -> DataFrame:
        import pandas as pd

        @F.pandas_udf("array<double>")
        def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in batches:
                found = pd.Series([None] * len(texts), dtype=object)
                some = [i for i, t in enumerate(texts) if t and t.strip()]
                if some:
                    v = np.asarray(encode([prefix + texts.iloc[i] for i in some]), float)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    for i, row in zip(some, v):
                        found.iloc[i] = row.tolist()
                yield found

        return df.withColumn(out, udf(F.col(text)))

    return apply
