"""Dense retrieval: top-k by dot product or cosine for all queries at once, and the variant with hygiene passes.

Queries are a stated set that meets all rows: they travel to the vectors in blocks of ``BLOCK_BYTES``, and scores are block
products in Arrow batches. Each task keeps its k best of each query, so what is shuffled grows with tasks, not with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.config import DENSE_HEURISTIC, Heuristic
from ridgeline.functions import text as T
from ridgeline.functions import vectors as V
from ridgeline.operators import ranking

#: Bytes of queries that one task has at a time, about; and scores of one step.
BLOCK_BYTES, STEP = 32 << 20, 4_000_000
#: Scores count to six places, so those this close may still change places.
CLOSE = 2e-6


def blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """(ids, matrix) of the queries, in blocks by hash of about ``limit`` bytes, however many there are."""
    spark = queries.sparkSession
    rows = queries.select("qid", "qvec")
    size = rows.agg(F.sum(F.greatest(F.lit(0), F.size("qvec")) * 8 + 64)).first()[0] or 0
    n = -(-size // limit)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b) if n > 1 else rows
        found = part.toArrow()
        yield spark.sparkContext.broadcast((found.column("qid").combine_chunks(), V.matrix(found.column("qvec"))))


def _scored(vectors: DataFrame, queries: DataFrame, metric: str, limit: int, keep: Callable) -> DataFrame:
    """(qid, id, score) of what ``keep`` leaves of each task's scores."""
    rows = vectors.select("id", "embedding").where("id IS NOT NULL")
    kind = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    found = None
    for block in blocks(queries, limit):

        def run(it: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            qids, asked = block.value

            def steps() -> Iterator[tuple[pa.Array, np.ndarray]]:
                for batch in it:
                    step = max(1, STEP // max(1, len(qids)))
                    for i in range(0, batch.num_rows, step):
                        part = batch.slice(i, step)
                        yield part.column("id"), V.products(V.matrix(part.column("embedding"), asked.shape[1]), asked, metric)

            for q, ids, score in keep(steps(), len(qids)):
                yield pa.record_batch([qids.take(pa.array(q)), ids, pa.array(score)], names=["qid", "id", "score"])

        part = rows.mapInArrow(run, kind)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], kind) if found is None else found


def best(steps: Iterator, n: int, k: int, above: float = -np.inf) -> Iterator[tuple]:
    """One (queries, ids, scores): the k best of each of n queries, with equal scores by id. steps: (ids, matrix of scores); scores at ``above`` or under don't count."""
    floor = np.full(n, -np.inf)  # no score below a query's can be among its k best
    have: tuple | None = None
    for ids, scores in steps:
        if len(scores) >= k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
        row, q = np.nonzero((scores >= floor - CLOSE) & (scores > above))
        new = (q, ids.take(pa.array(row)), scores[row, q])
        if have:
            new = (np.concatenate((have[0], q)), pa.concat_arrays([have[1], new[1]]), np.concatenate((have[2], new[2])))
        names = np.asarray(new[1].to_pylist()) if pa.types.is_string(new[1].type) else np.asarray(new[1])
        order = np.lexsort((names, -np.round(new[2], 6), new[0]))
        place = np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order])
        order = order[place < k]
        have = (new[0][order], new[1].take(pa.array(order)), new[2][order])
    if have:
        yield have


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", limit: int = BLOCK_BYTES) -> DataFrame:
    """(qid, id, score, rank) from (id, embedding) and (qid, qvec)."""

    return ranking.top_k(_scored(vectors, queries, metric, limit, lambda steps, n: best(steps, n, k)), k)


def scores(vectors: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """(qid, id, score) of all pairs."""

    def every(steps: Iterator, n: int) -> Iterator[tuple]:
        for ids, found in steps:
            yield np.tile(np.arange(n), len(ids)), ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), found.ravel()

    return _scored(vectors, queries, metric, BLOCK_BYTES, every)


def extremes(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, qmin, qmax): least and greatest cosine, to six places, over rows and queries that have vectors."""

    def ends(steps: Iterator, n: int) -> Iterator[tuple]:
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        some = None
        for ids, found in steps:
            some = ids[:1] if some is None else some
            known = found > -1
            low = np.minimum(low, np.where(known, found, np.inf).min(0))
            high = np.maximum(high, np.where(known, found, -np.inf).max(0))
        have = np.flatnonzero(np.isfinite(low))
        if len(have):
            yield np.tile(have, 2), some.take(pa.array(np.zeros(2 * len(have), np.int64))), np.concatenate((low[have], high[have]))

    found = _scored(vectors, queries, "cosine", BLOCK_BYTES, ends)
    return found.groupBy("qid").agg(F.round(F.min("score"), 6).alias("qmin"), F.round(F.max("score"), 6).alias("qmax"))


def heuristic(hits: DataFrame, passages: DataFrame, config: Heuristic = DENSE_HEURISTIC) -> DataFrame:
    """(qid, id, score, rank) from ranked candidates: a strict pass, then one that keeps lists and fragments."""
    tested = passages.join(hits.select("id").distinct(), "id", "left_semi").withColumn("text", T.strip(F.col("text")))
    t = F.col("text")
    base = (t != "") & ~T.is_caption(t) & ~T.is_table_header(t) & ~T.is_heading(t)
    strict = base & ~T.is_bullet_list(t) & ~T.is_incomplete(t) & ~t.endswith(":") & (F.length(t) >= config.min_chars)
    lax = base & (F.length(t) >= config.fallback_min_chars)
    tested = tested.select("id", strict.alias("strict"), lax.alias("lax"), F.md5(T.dedupe_key(t).cast("binary")).alias("key"))
    return ranking.relaxed(hits.join(tested, "id"), [F.col("strict"), F.col("lax")], F.col("key"), config.top_k, 0).select("qid", "id", "score", "rank")
