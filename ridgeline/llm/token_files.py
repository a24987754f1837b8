"""Token-ID output: documents' token ids in rANS blocks that decode independently of each other.

``write`` tokenizes documents in ascending doc_id order, counts all symbols, and writes two Parquet folders: ``table`` (the
shared frequencies) and ``blocks`` (a row for each block, a self-contained binary file image with header, document index,
checkpoints, stream and checksums). Spark's commit protocol makes each file appear whole or not at all, so a lost
executor costs a retry only. ``read`` decodes blocks in parallel.

Null text: no ids but the end id. Null doc_id: kept, before all others, in blocks of their own (``null_ids``). Equal ids:
ordered by text. Empty table: no block. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import rans
from ridgeline.llm.common import clean, fresh, passing, shuffle_partitions, stage, trim
from ridgeline.llm.tokens import encoder as shared_encoder
from ridgeline.llm.tokens import encoded

BLOCK_TOKENS = 1 << 19
_SLICE = 1024
_TOKENS = "part int, at long, doc_id long, n long, ids binary"
_BLOCKS = "null_ids boolean, start long, n_docs long, n_tokens long, block binary"


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool) -> DataFrame:
    """(part, at, doc_id, n, ids): ids with the end id, in order of part and at; written to the shared folder."""
    spark = docs.sparkSession
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = shared_encoder(vocabulary, spaced), 0, TaskContext.get().partitionId()
        for batch in it:
            trim()
            for i, j, ids, offsets in encoded(encoder, batch.column("text"), end_id):
                raw, size = memoryview(ids.tobytes()), encoder.dtype.itemsize
                each = [bytes(raw[a * size : b * size]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.record_batch([pa.array(np.full(j - i, part, np.int32)), pa.array(at + offsets[:-1]), batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets)), pa.array(each, pa.binary())], schema=schema)
                at += int(offsets[-1])

    ordered = clean(docs).repartitionByRange(2 * shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, _TOKENS), "tokens", dictionary=False)


def count_symbols(tokens: DataFrame, dtype: np.dtype, n_symbols: int) -> np.ndarray:
    """Counts of all symbols over all documents: summed in each task, then by slices of the vocabulary."""
    slices = -(-n_symbols // _SLICE)
    schema = pa.schema([("slice", pa.int32()), ("share", pa.int32()), ("counts", pa.binary())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slices * _SLICE, np.int64)
        for batch in it:
            column = batch.column(0)
            _, offsets, data = column.buffers()
            cut = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            total += np.bincount(np.frombuffer(data, np.uint8)[cut[0] : cut[-1]].view(dtype), minlength=len(total))
        share = TaskContext.get().partitionId() % 64
        for s in np.flatnonzero(total.reshape(slices, _SLICE).any(1)):
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([share], pa.int32()), pa.array([total[s * _SLICE : (s + 1) * _SLICE].tobytes()], pa.binary())], schema=schema)

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in part.column("counts"))
        return pa.table({"slice": part.column("slice").slice(0, 1), "share": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())}, schema=schema)

    kind = "slice int, share int, counts binary"
    sums = tokens.select("ids").mapInArrow(count, kind).groupBy("slice", "share").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind)
    counts = np.zeros(slices * _SLICE, np.int64)
    for row in sums.collect():  # one row of 8 KB for each 1024 symbols of the vocabulary
        counts[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], np.int64)
    return counts


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, spaced: bool = True, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``path``/table and ``path``/blocks."""
    spark = docs.sparkSession
    encoder = shared_encoder(vocabulary, spaced)
    dtype, size = encoder.dtype, max(encoder.tokenizer.get_vocab_size(), end_id + 1)
    tokens = tokenize(docs, vocabulary, end_id, spaced)
    table = rans.Table.of_counts(count_symbols(tokens, dtype, size))
    packed = table.to_bytes()
    parts = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each partition
    offset, total = {}, 0
    for row in parts:
        offset[row["part"]] = total
        total += row["n"]
    schema = pa.schema([("null_ids", pa.bool_()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.binary())])

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table.from_bytes(packed)
        rows: list[tuple[int | None, bytes]] = []
        begin = size_ = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in rows), dtype)
            none = rows[0][0] is None
            blob = rans.encode(ids, shared, [i or 0 for i, _ in rows], [len(x) // dtype.itemsize for _, x in rows], begin)
            return pa.record_batch([pa.array([none]), pa.array([begin], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], schema=schema)

        for batch in it:
            for part, at, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                start = offset[part] + at
                if rows and (start != begin + size_ or size_ >= block_tokens or (rows[0][0] is None) != (doc_id is None)):
                    yield block()
                    rows, size_ = [], 0
                if not rows:
                    begin = start
                rows.append((doc_id, ids))
                size_ += n
        if rows:
            yield block()

    spark.createDataFrame([(bytearray(packed),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(blocks, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files; checksums are verified."""
    packed = bytes(spark.read.parquet(f"{path}/table").first()["frequencies"])
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in kind.split(", ")]

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.from_bytes(packed)
        for batch in it:
            for none, blob in zip(batch.column("null_ids").to_pylist(), batch.column("block")):
                block = rans.Block.parse(blob.as_py(), table)
                ids = block.ids(table)
                cut = np.concatenate(([0], np.cumsum(block.lengths, dtype=np.int64)))
                raw = memoryview(ids.astype("<u4").tobytes())
                each = [raw[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:])]
                columns = [pa.array([None] * len(each) if none else block.doc_ids, pa.int64()), pa.array(block.start + cut[:-1]), pa.array(np.diff(cut)), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in each], pa.binary()))
                yield pa.record_batch(columns, names=names)

    return spark.read.parquet(f"{path}/blocks").select("null_ids", "block").mapInArrow(decode, kind)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: byte-level vocabulary, end id 2."""
    path = fresh(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "byte_bpe_50k.json", 2)
    passing(spark, path)
    return read(spark, path)
