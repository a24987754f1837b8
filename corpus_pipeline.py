"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return the columns of
documents; the last returns packed pieces. ``run`` writes each stage to the shared folder and reads it again.

A row is a document of its own: rows with a null doc_id, or with one that other rows have, too, are judged and kept or dropped by
themselves, never with the rows of that id. Stages that drop number the rows first; these numbers are the operators' doc_ids.
Null and empty texts are not toxic, no copies, contaminated by nothing and hold no personal data; packing gives them the end id. An
empty table passes all stages. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, jaccard, packing, pii, toxicity
from ridgeline.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold of their language. Learns from the labelled rows of its input."""
    model = toxicity.fit_with_languages(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.classify(docs, model, *COLUMNS[1:])
    return scored.where(~toxicity.rejected(scored, model)).select(COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``_row``, a number for each row that stays the same: the file's and the place in it.

    Rows that come from no file are written first.
    """
    try:
        files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    except AnalysisException:
        docs = stage(docs.select(COLUMNS), "rows", dictionary=False)
        files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    order = F.row_number().over(Window.orderBy("_file")).cast("long")  # one row for each file
    files = stage(files.select("_file", F.shiftleft(order, 40).alias("_first")), "files")
    rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(files, "_file").withColumn("_row", F.col("_first") + F.col("_at")).drop("_file", "_first", "_at")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links connect: the one with the smallest doc_id, null ones last; rows without words all stay."""
    rows = numbered(docs)
    groups = jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    groups = stage(groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    several = groups.where("_row <> _group").select("_group").distinct()
    members = groups.join(several, "_group", "left_semi")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = members.join(rows.select("_row", "doc_id"), "_row").groupBy("_group").agg(F.min_by("_row", order).alias("_row"))
    # written, so that its size is known when the join is planned: texts are shuffled only if it is too large to broadcast
    gone = stage(members.select("_row").join(first.select("_row"), "_row", "left_anti"), "gone")
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = numbered(docs)
    found = decontaminate.contained(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(found.select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars is the new length (null for a null text)."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("personal_data", private), ("packing", packed)]

#: Trained models and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
