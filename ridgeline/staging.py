"""Tables written to the folder that the driver and all executors share, and read again.

Lineage ends at a staged table, so lost executors cost a re-read and no plan holds another's. What is staged goes with the
session: the file system deletes it when the driver's JVM ends, ``discard`` sooner.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DERIVED: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session in one process may do without, and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ridgeline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/ridgeline/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """What is written at ``path`` goes when the driver's JVM ends."""
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)


def stage(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write ``df`` and read it again. ``dictionary``: no use where values are long and hardly repeat; those are compressed lightly, too."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd" if dictionary else "snappy").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    passing(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            fs, at = _file(df.sparkSession, path)
            fs.delete(at, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``."""
    fs, at = _file(spark, path)
    return fs.getContentSummary(at).getLength()


def derived(spark: SparkSession, sources: list[str], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A staged table that all queries of a session share, built again when a source has changed."""
    marks = []
    for source in sources:
        fs, at = _file(spark, source)
        marks.append((source, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()))
    key = (spark.sparkContext.applicationId, name, *marks)
    if key in _DERIVED:
        fs, at = _file(spark, _DERIVED[key]._staged_at)
        if not fs.exists(at):
            del _DERIVED[key]
    if key not in _DERIVED:
        _DERIVED[key] = stage(build(), name)
    return _DERIVED[key]
