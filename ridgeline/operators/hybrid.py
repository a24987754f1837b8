"""Two-stage retrieval: documents from a first ranking, then the walk inside those documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Drill, Expand, Score
from ridgeline.functions import text as T
from ridgeline.operators import walk
from ridgeline.staging import stage


def first_documents(hits: DataFrame, m: int = 5) -> DataFrame:
    """(qid, doc_id, doc_rank): the first m documents in order of their first hit. hits: (qid, doc_id, rank)."""
    first = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("qid").orderBy("first", "doc_id")
    return first.withColumn("doc_rank", F.row_number().over(order)).where(F.col("doc_rank") <= m).select("qid", "doc_id", "doc_rank")


def restrict(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (with doc_id) of each query's documents; adds qid."""
    return rows.join(candidates.select("qid", "doc_id"), "doc_id")


def document_map(sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, doc_id) of sections and text nodes: a section's own document or the one its id names; a node's section's, or the one its id names.

    sections: (section_id, doc_id); nodes: (node_id, section_id).
    """
    own = sections.select(F.col("section_id").alias("id"), F.coalesce("doc_id", T.doc_of_section(F.col("section_id"))).alias("doc_id")).where("doc_id <> ''")
    by_section = own.select(F.col("id").alias("section_id"), F.col("doc_id").alias("_doc"))
    held = nodes.select("node_id", "section_id").join(by_section, "section_id", "left")
    return own.unionByName(held.select(F.col("node_id").alias("id"), F.coalesce("_doc", T.doc_of_chunk(F.col("node_id"))).alias("doc_id")).where("doc_id <> ''"))


def own_nodes(documents: DataFrame, mapped: DataFrame) -> DataFrame:
    """(qid, node) of all sections and text nodes of each query's documents. documents: (qid, doc_id); mapped: (id, doc_id)."""
    return documents.select("qid", "doc_id").join(mapped, "doc_id").select("qid", F.col("id").alias("node")).distinct()


def own_edges(allowed: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, src, dst, rel, edge_pos): edges with both ends among each query's nodes."""
    a = allowed.select("qid", F.col("node").alias("src"))
    b = allowed.select("qid", F.col("node").alias("dst"))
    return edges.join(a, "src").join(b, ["qid", "dst"], "left_semi")


def seeds_or_roots(seeds: DataFrame, roots: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, node, rank): seeds; for queries without any the best roots; without those the sections that stand for the documents.

    documents: (qid, section_id, doc_rank).
    """
    a = walk.ranked_seeds(seeds)
    b = roots.select("qid", F.col("section_id").alias("node"), "rank").join(a.select("qid").distinct(), "qid", "left_anti")
    have = a.unionByName(b)
    c = documents.select("qid", F.col("section_id").alias("node"), F.col("doc_rank").alias("rank")).join(have.select("qid").distinct(), "qid", "left_anti")
    return have.unionByName(c)


def restricted_walk(documents: DataFrame, sections: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, mapped: DataFrame, top_k: int = 10, drill: Drill = Drill(), expand: Expand = Expand(), score: Score = Score()) -> walk.Walk:
    """The walk inside each query's documents: scores, roots, extremes and edges are those of these documents alone.

    documents: (qid, doc_id, doc_rank); sections, nodes and edges as the walk takes them; mapped: (id, doc_id).
    """
    documents = stage(documents, "documents")
    allowed = stage(own_nodes(documents, mapped), "allowed")
    scope = stage(walk.scoped(documents, sections, queries), "scope")
    seeds = walk.drill(sections, queries, drill, scope)
    tops = sections.where("level = 0").select("section_id", "doc_id")
    seeds = seeds_or_roots(seeds, walk.scoped_roots(scope, drill), documents.join(tops, "doc_id").select("qid", "section_id", "doc_rank"))
    return walk.run(sections, nodes, edges, queries, drill, expand, score, top_k, seeds, allowed)
