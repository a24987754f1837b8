"""Contiguous text windows around ranked chunks of a section, and flattening them to ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Subgraph
from ridgeline.functions import text as T
from ridgeline.staging import stage


def positions(nodes: DataFrame) -> DataFrame:
    """Chunks with ``at``, their place among the section's chunks in order of the integers in their ids, and ``n``, how many there are."""
    own = Window.partitionBy("section_id")
    chunks = nodes.where("node_type = 'chunk'")
    return chunks.withColumn("at", F.row_number().over(own.orderBy(T.chunk_order(F.col("node_id")))) - 1).withColumn("n", F.count("*").over(own))


def spans(ranked: DataFrame, nodes: DataFrame, config: Subgraph = Subgraph()) -> DataFrame:
    """(qid, section_id, node_id, rank, score, at, lo, hi): the span of each anchor; other nodes than chunks have none.

    From the section's start to ``tail_after`` chunks past the anchor, or around the anchor if that is over ``max_window_chunks``.
    """
    anchors = ranked.select("qid", "node_id", "rank", "score").join(positions(nodes).select("node_id", "section_id", "at", "n"), "node_id")
    last = F.col("n") - 1
    end = F.least(F.col("at") + config.tail_after, last)
    long = end + 1 > config.max_window_chunks
    lo = F.when(long, F.greatest(F.lit(0), F.col("at") - config.fallback_before)).otherwise(F.lit(0))
    hi = F.when(long, F.least(F.col("at") + config.fallback_after, last)).otherwise(end)
    return anchors.select("qid", "section_id", "node_id", "rank", "score", "at", lo.alias("lo"), hi.alias("hi"))


def anchored(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the sections that have an anchor: windows need no others."""
    own = nodes.select("node_id", "section_id").join(ranked.select("node_id").distinct(), "node_id", "left_semi").select("section_id").distinct()
    return nodes.join(own, "section_id", "left_semi")


def merge(found: DataFrame) -> DataFrame:
    """(qid, section_id, lo, hi, score, anchors): spans of a section that touch or overlap become one; anchors by rank."""
    order = Window.partitionBy("qid", "section_id").orderBy("lo", "rank")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= before + 1, 0).otherwise(1)).over(order)
    rows = found.withColumn("_before", before).withColumn("_island", island)
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"])
    return rows.groupBy("qid", "section_id", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("score").alias("score"), F.min("rank").alias("rank"), anchors.alias("anchors")).drop("_island")


def assemble(ranked: DataFrame, nodes: DataFrame, config: Subgraph = Subgraph()) -> DataFrame:
    """(qid, window_id, section_id, rank, score, anchors, members, from_start, title, text): windows by score, of equals the earlier anchor's."""
    nodes = stage(anchored(ranked, nodes), "anchored")
    merged = merge(spans(ranked, nodes, config))
    chunks = positions(nodes).select(F.col("section_id").alias("_s"), "node_id", "at", "text")
    inside = (F.col("section_id") == F.col("_s")) & F.col("at").between(F.col("lo"), F.col("hi"))
    own = F.array_sort(F.collect_list(F.struct("at", "node_id", "text")))
    keys = ["qid", "section_id", "lo", "hi", "score", "rank", "anchors"]
    found = merged.withColumnRenamed("rank", "_rank").join(chunks, inside).groupBy(*[k if k != "rank" else "_rank" for k in keys]).agg(own.alias("_m"))
    members = F.transform("_m", lambda x: x["node_id"])
    titles = nodes.groupBy(F.col("section_id").alias("_t")).agg(F.min_by("text", "pos").alias("_first"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "_rank", "lo")
    out = found.join(titles, F.col("section_id") == F.col("_t")).withColumn("rank", F.row_number().over(order))
    window_id = F.concat(F.col("section_id"), F.lit("::"), members[0], F.lit(".."), F.element_at(members, -1))
    return out.select("qid", window_id.alias("window_id"), "section_id", "rank", "score", "anchors", members.alias("members"), (F.col("lo") == 0).alias("from_start"), F.split("_first", "\n")[0].alias("title"), F.array_join(F.transform("_m", lambda x: x["text"]), "\n").alias("text"))


def items(windows: DataFrame, sections: DataFrame) -> DataFrame:
    """Windows as output items: (qid, rank, chunk_id, section_id, parent_section_id, title, score, anchor_node_ids, window_node_ids, from_start, text)."""
    above = sections.select("section_id", F.col("parent_id").alias("parent_section_id"))
    return windows.join(above, "section_id", "left").select("qid", "rank", F.col("window_id").alias("chunk_id"), "section_id", "parent_section_id", "title", "score", F.col("anchors").alias("anchor_node_ids"), F.col("members").alias("window_node_ids"), "from_start", "text")


def flatten(windows: DataFrame, order: str = "doc") -> DataFrame:
    """(qid, node_id, rank): ids of windows in order, each once. ``anchors_first``: every window's anchors before all members."""
    if order == "anchors_first":
        anchors = windows.select("qid", "rank", F.lit(0).alias("part"), F.posexplode("anchors").alias("pos", "node_id"))
        members = windows.select("qid", "rank", F.lit(1).alias("part"), F.posexplode("members").alias("pos", "node_id"))
        rows = anchors.unionByName(members)
    elif order == "doc":
        rows = windows.select("qid", "rank", F.lit(0).alias("part"), F.posexplode("members").alias("pos", "node_id"))
    else:
        raise ValueError(f"unknown order {order}")
    first = rows.groupBy("qid", "node_id").agg(F.min(F.struct("part", "rank", "pos")).alias("k"))
    return first.select("qid", "node_id", F.row_number().over(Window.partitionBy("qid").orderBy("k")).alias("rank"))
