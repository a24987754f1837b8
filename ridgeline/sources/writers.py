"""Sinks: index tables with a compatibility record, result documents, CSV and Markdown reports, append-only logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(tables: dict[str, DataFrame], path: str, dim: int | None = None, model: str | None = None) -> None:
    """Each table under its name, and ``meta`` with the vectors' size and model."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(dim, model)], "dim int, model string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str, name: str, dim: int | None = None, model: str | None = None) -> DataFrame:
    """A table of an index; a size or a recorded model that differs is an error."""
    meta = spark.read.schema("dim int, model string").json(f"{path}/meta").first()
    if dim is not None and meta["dim"] is not None and meta["dim"] != dim:
        raise ValueError(f"index has vectors of {meta['dim']}, not {dim}")
    if model is not None and meta["model"] is not None and meta["model"] != model:
        raise ValueError(f"index was built with {meta['model']}, not {model}")
    return spark.read.parquet(f"{path}/{name}")


def result_documents(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, query, output_items, output_ids): one document a query, items by rank. hits: (qid, id, rank, text, score)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("chunk_id"), "text", "score"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), x["score"].alias("score")))
    per = hits.groupBy("qid").agg(items.alias("output_items"))
    none = F.array().cast("array<struct<chunk_id:string,text:string,score:double>>")
    rows = queries.join(per, "qid", "left").withColumn("output_items", F.coalesce("output_items", none))
    return rows.select(F.col("qid").alias("id"), "query", "output_items", F.transform("output_items", lambda x: x["chunk_id"]).alias("output_ids"))


def ranked_items(items: DataFrame) -> DataFrame:
    """Items with an id and a text that are not blank."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return items.where(~blank("chunk_id") & ~blank("text"))


def json_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def csv_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for results of a size to read."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report's table as Markdown."""
    rows = df.limit(limit).collect()
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def pending(rows: DataFrame, log: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows that the log has no ``ok`` for yet: what a resumed run has to do."""
    return rows.join(log.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def run_name(name: str) -> str:
    """A run's name as a folder name."""
    return re.sub(r"[^A-Za-z0-9_.,-]", "_", name).strip("._-") or "run"
