"""Structured Streaming twins of the append-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema, files_a_trigger: int = 5) -> DataFrame:
    """New Parquet files of a log, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("recursiveFileLookup", True).parquet(path)


def latest_by_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key so far: state is one row a key, in update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def counters(stream: DataFrame, *keys: str) -> DataFrame:
    """Running counts by key."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling event-time windows; rows later than ``late`` behind the newest are dropped and their state is freed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def pending_stream(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a stream whose key a static table has no ``ok`` for."""
    return stream.join(done.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Drain what there is into a memory table and stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert(df: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table with the last row of each key: each batch is merged and written as a new version, then named current."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{epoch - 1}")
            batch = old.unionByName(batch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rest = [c for c in batch.columns if c != key]
        batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    query = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
