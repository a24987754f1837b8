"""Bulk-synchronous best-fit packing of token pieces into sequences of a fixed capacity.

Pieces are placed in bands of size, large ones first, as best-fit decreasing does. Pieces above half the capacity open a sequence each.
Every further band is a round, together with what the bands before have left over, and the last repeats until all have a place:

1. range-sort: the band's pieces and all gaps are sorted together by size, from large to small, over all tasks; rows of
   one size are told apart by id, so a common size is cut like any other;
2. sweep: each task walks down its range; a piece takes its successor, the smallest gap there that holds it, ranks decide
   between pieces that want the same gap, and what is left of the gap goes back among the gaps;
3. carry: pieces without a gap in their range go on to the gaps that the ranges above have left, nearest first, in shares
   by total size; if those are used up, their range may open as many sequences as its pieces fill. Only totals by range
   (two numbers each) reach the driver for this;
4. pieces and the gaps dealt to them meet and are swept again; gaps are updated. What still has no place is first in the next round.

A gap is a sequence and the room at its end, so what a sequence holds is ``capacity`` less its gap. All tables of a round are
written to the shared folder: a lost executor costs a re-read, and no round is computed twice.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import clean, release, stage, trim
from ridgeline.llm.tokens import encoder as shared_encoder
from ridgeline.llm.tokens import encoded

CAPACITY = 2048
#: Bands end at the capacity divided by these; the last one takes all that is smaller.
BANDS = (2, 4, 8, 16)
#: Pieces and gaps of one task, about.
RANGE_ROWS = 50_000
PLACED, GAP, OPEN = 0, 1, 2
#: ``id``: of a piece, or a gap's sequence; ``at``: total size of the smaller gaps of the range.
_STATE = "what int, part int, at long, id long, sid long, size long"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def sweep(gap_ids: np.ndarray, gap_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, capacity: int = 0, may_open: int = 0) -> tuple[list, list, list]:
    """(placed (piece, sequence, room before), gaps (sequence, size), open (piece, size)).

    Pieces from large to small each take the smallest gap that holds them; of gaps and of pieces of one size those with the smaller id come first.
    ``may_open``: sequences that may be opened, named by their first piece.
    """
    room: dict[int, list[int]] = {}
    for k in np.lexsort((-gap_ids, gap_sizes)).tolist():
        room.setdefault(int(gap_sizes[k]), []).append(int(gap_ids[k]))
    known = sorted(room)
    placed, open_ = [], []
    order = np.lexsort((ids, -sizes))
    for i, n in zip(ids[order].tolist(), sizes[order].tolist()):
        k = bisect.bisect_left(known, n)
        if k < len(known):
            gap = known[k]
            sid = room[gap].pop()
            if not room[gap]:
                del room[gap], known[k]
        elif may_open:
            may_open -= 1
            gap, sid = capacity, i
        else:
            open_.append((i, n))
            continue
        placed.append((i, sid, gap))
        if gap > n:
            if gap - n not in room:
                room[gap - n] = []
                bisect.insort(known, gap - n)
            room[gap - n].append(sid)
    return placed, [(sid, size) for size in known for sid in room[size]], open_


def _state(part: int, placed: list, gaps: list, open_: list, capacity: int) -> pa.RecordBatch:
    """One table of all: of a placed piece, size is its offset."""
    rows = [(PLACED, part, 0, i, sid, capacity - gap) for i, sid, gap in placed]
    at = 0
    for sid, size in gaps:
        rows.append((GAP, part, at, sid, sid, size))
        at += size
    rows += [(OPEN, part, 0, i, 0, n) for i, n in open_]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=_NAMES)


def _arrays(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n)) for n in names]


def _swept(gaps: DataFrame, open_: DataFrame, parts: int, capacity: int) -> DataFrame:
    """Steps 1 and 2. gaps and open_: (id, size)."""
    both = gaps.select(F.lit(GAP).alias("what"), "id", "size").unionByName(open_.select(F.lit(OPEN).alias("what"), "id", "size"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what tokenizing has left
        batches = [b for b in it if b.num_rows]
        if batches:
            what, ids, sizes = _arrays(pa.Table.from_batches(batches), "what", "id", "size")
            gap = what == GAP
            yield _state(TaskContext.get().partitionId(), *sweep(ids[gap], sizes[gap], ids[~gap], sizes[~gap]), capacity)

    return stage(both.repartitionByRange(parts, F.col("size").desc(), "what", "id").mapInArrow(run, _STATE), "swept")


def carried(totals: dict[int, tuple[int, int]], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], dict[int, int]]:
    """(by range: (from, to, range) shares of its gaps, by range: sequences it may open).

    totals: by range, from large sizes to small, what its open pieces and its gaps come to. Gaps of ranges above form a
    stack with the nearest on top; a range takes from it what its pieces come to, and sequences are opened for the rest
    of all ranges, as few as hold it.
    """
    stack: list[list[int]] = []  # range, from, to
    shares: dict[int, list[tuple[int, int, int]]] = {}
    opens: dict[int, int] = {}
    lacking = 0
    for part in sorted(totals):
        need, own = totals[part]
        while need > 0 and stack:
            source, begin, end = stack[-1]
            take = min(need, end - begin)
            shares.setdefault(source, []).append((begin, begin + take, part))
            need -= take
            if begin + take == end:
                stack.pop()
            else:
                stack[-1][1] += take
        if need > 0:  # what all ranges so far need, less what they may open already
            lacking += need
            if n := -(-lacking // capacity):
                opens[part] = n
                lacking -= n * capacity
        if own:
            stack.append([part, 0, own])
    return shares, opens


def _dealt(swept: DataFrame, totals: dict[int, tuple[int, int]], parts: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Steps 3 and 4: (gaps that were dealt to no range, state of the others)."""
    shares, opens = carried(totals, capacity)

    def target(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            what, part, at = _arrays(batch, "what", "part", "at")
            to = np.where(what == OPEN, part, -1)
            for source in np.unique(part[what == GAP]).tolist():
                own = np.flatnonzero((what == GAP) & (part == source))
                if cuts := shares.get(source):
                    k = np.searchsorted([b for b, _, _ in cuts], at[own], "right") - 1
                    inside = (k >= 0) & (at[own] < np.array([e for _, e, _ in cuts])[k])
                    to[own[inside]] = np.array([t for _, _, t in cuts])[k[inside]]
            yield pa.record_batch([*batch.columns, pa.array(to.astype(np.int32))], names=[*_NAMES, "target"])

    def again(group: pa.Table) -> pa.Table:
        release()
        what, ids, sizes = _arrays(group, "what", "id", "size")
        gap, part = what == GAP, group.column("target")[0].as_py()
        return pa.Table.from_batches([_state(part, *sweep(ids[gap], sizes[gap], ids[~gap], sizes[~gap], capacity, opens.get(part, 0)), capacity)])

    aimed = stage(swept.where(F.col("what") != PLACED).mapInArrow(target, _STATE + ", target int"), "aimed")
    met = aimed.where("target >= 0").repartition(parts, "target").groupBy("target").applyInArrow(again, _STATE)
    return aimed.where("target < 0").select(_NAMES), stage(met, "met")


def _of(state: DataFrame, what: int) -> DataFrame:
    return state.where(F.col("what") == what).select("id", *["sid"] * (what == PLACED), "size")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with a ``length`` column.

    A length that is null, under 1 or over the capacity can't be placed: both are null there. Equal rows are separate
    pieces. An empty table stays empty. Other columns pass; the names _pid, sequence_id and offset are taken.
    """
    kept = [c for c in pieces.columns if c not in ("_pid", "sequence_id", "offset")]
    rows = stage(pieces.select(kept).withColumn("length", F.col("length").cast("long")).withColumn("_pid", F.monotonically_increasing_id()), "pieces")  # fixed once written
    size = rows.where(F.col("length").between(1, capacity)).select(F.col("_pid").alias("id"), F.col("length").alias("size"))
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    bounds = sorted({capacity, *(capacity // b for b in BANDS)}, reverse=True)[1:] + [0]
    large = size.where(F.col("size") > bounds[0])
    placed = [large.select("id", F.col("id").alias("sid"), F.lit(0).cast("long").alias("size"))]
    gaps = large.select("id", (F.lit(capacity) - F.col("size")).alias("size")).where("size > 0")
    left = size.limit(0)
    for high, low in zip(bounds, bounds[1:]):
        open_ = left.unionByName(size.where((F.col("size") <= high) & (F.col("size") > low)))
        while True:
            swept = _swept(gaps, open_, parts, capacity)
            # two numbers for each range
            found = swept.where(F.col("what") != PLACED).groupBy("part").pivot("what", [OPEN, GAP]).sum("size").fillna(0).collect()
            totals = {r["part"]: (r[str(OPEN)], r[str(GAP)]) for r in found}
            placed.append(_of(swept, PLACED))
            gaps, left = _of(swept, GAP), _of(swept, OPEN)
            if any(need for need, _ in totals.values()):
                rest, met = _dealt(swept, totals, parts, capacity)
                placed.append(_of(met, PLACED))
                gaps, left = _of(rest.unionByName(met.where(F.col("what") == GAP)), GAP), _of(met, OPEN)
            if low or left.isEmpty():
                break
            open_ = left
    places = placed[0]
    for more in placed[1:]:
        places = places.unionByName(more)
    places = places.select(F.col("id").alias("_pid"), F.col("sid").alias("sequence_id"), F.col("size").alias("offset"))
    return rows.join(places, "_pid", "left").select(*kept, "sequence_id", "offset")


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, spaced: bool = False, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: ids and the end id, cut only where they are over the capacity."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in kind.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, spaced)
        for whole in it:
            trim()
            for i, j, ids, offsets in encoded(encoder, whole.column("text"), end_id):
                n = -(-np.diff(offsets) // capacity)  # every document has its end id at least
                first = np.cumsum(n) - n
                of = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(of)) - first[of]
                start = piece * capacity
                length = np.minimum(np.diff(offsets)[of] - start, capacity)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), (offsets[of] + start) * 4
                parts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                columns = [whole.column("doc_id").take(pa.array(i + of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.record_batch(columns + [pa.array([bytes(x) for x in parts], pa.binary())] * with_ids, names=names)

    return clean(docs).mapInArrow(run, kind)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces. Null text: the end id alone. Null and repeated doc_ids are pieces like others."""
    return pack(pieces(docs, vocabulary, end_id, capacity, with_ids=with_ids), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: word-end vocabulary, end id 0, sequences of 2048."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
