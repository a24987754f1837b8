"""Ranking helpers: total orders, first-seen choice, relaxed passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with their rank; equal scores (to six places) go by id. Spark limits each task's share before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round(F.col(score), 6).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relaxed(candidates: DataFrame, passes: list[Column], key: Column, k: int, relax_threshold: int) -> DataFrame:
    """Multi-pass choice in one plan: the first k by (pass, rank), of rows with equal keys the first.

    ``passes``: conditions from strict to lax. With a threshold the second counts only where the first gives fewer distinct keys.
    """
    found = candidates.withColumn("_key", key).withColumn("_strict", passes[0])
    if relax_threshold:
        strict = F.size(F.collect_set(F.when(F.col("_strict"), F.col("_key"))).over(Window.partitionBy("qid")))
        found = found.withColumn("_relax", F.least(strict, F.lit(k)) < relax_threshold)
    else:
        found = found.withColumn("_relax", F.lit(True))
    number = F.when(F.col("_strict"), 1)
    if len(passes) > 2:
        number = number.when(F.col("_relax") & passes[1], 2)
    number = number.when(passes[-1], 3)
    first = Window.partitionBy("qid", "_key").orderBy("_pass", "rank")
    found = found.withColumn("_pass", number).where("_pass IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("qid").orderBy("_pass", "rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_key", "_strict", "_relax", "_n")
