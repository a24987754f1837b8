"""Tables of a corpus derived from documents, as the retrieval operators take them.

Sections: ``D{doc}`` (level 0), one of level 1 for every eight non-blank lines, one of level 2 for every four. The first line of
each eight belongs to the level-1 section, the others to level 2. A line is a chunk, a list item if it looks like a list, a
caption if it looks like one. Documents with equal text are linked from the first to each other one.

``corpus`` names the tables that are built once a session and read by all queries, as an index would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.functions import vectors as V
from ridgeline.operators import bm25, build
from ridgeline.staging import derived, size_of, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Below this many bytes a core a table may be one row group, which one task would read alone.
SPREAD_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), read where it is. Only a small table whose rows lie in fewer splits than cores is dealt evenly once and staged, so that all cores work on it."""
    path, cores = f"{sf_dir}/documents.parquet", spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    if size_of(spark, path) > SPREAD_BYTES * cores or _splits(spark, sf_dir) >= cores:
        return rows
    return derived(spark, [path], "documents", lambda: rows.repartition(2 * cores))


def _splits(spark: SparkSession, sf_dir: str) -> int:
    """Splits of the documents' files that have rows: a row group is never cut."""
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    return _derived(spark, sf_dir, "splits", lambda: table(spark, sf_dir, "documents").agg(F.count_distinct(*at).alias("n"))).first()["n"]


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): documents as passages."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text): non-blank lines, numbered from 0; no shuffle, the split stays in its row."""
    return _lines(documents(spark, sf_dir))


def _lines(docs: DataFrame) -> DataFrame:
    kept = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(kept).alias("pos", "text"))


def _derived(spark: SparkSession, sf_dir: str, name: str, build_: Callable[[], DataFrame]) -> DataFrame:
    return derived(spark, [f"{sf_dir}/documents.parquet"], name, build_)


# What follows takes ``of``: (doc_id, text), the documents that a query has found (``picked``), of which alone the table is then made.


def picked(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``docs``, staged."""
    some = stage(docs.select("doc_id").distinct(), "ids")
    return stage(documents(spark, sf_dir).join(some, "doc_id", "left_semi"), "picked")


def links(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(first, doc_id): each document with the first of equal text, staged; texts meet by their SHA-256. ``of``: only links whose first is one of these."""
    hashed = lambda docs: docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h"))

    def made() -> DataFrame:
        docs = hashed(documents(spark, sf_dir))
        if of is not None:
            docs = stage(docs.join(stage(hashed(of).select("h").distinct(), "hashes"), "h", "left_semi"), "hashed")
        least = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        return docs.join(least, "h").where("doc_id <> first").select("first", "doc_id")

    if of is None:
        return _derived(spark, sf_dir, "links", made)
    return _links_of(made(), of)


def _links_of(links_: DataFrame, docs: DataFrame) -> DataFrame:
    return links_.join(docs.select(F.col("doc_id").alias("first")).distinct(), "first", "left_semi")


def linked(spark: SparkSession, sf_dir: str, docs: DataFrame, hops: int) -> DataFrame:
    """(doc_id) of ``docs`` and all that links lead to in so many hops: a walk of as many edges stays in them, since only links leave a document."""
    found = frontier = stage(docs.select("doc_id").distinct(), "frontier")
    for _ in range(hops):
        near = frontier.select(F.col("doc_id").alias("first")).join(links(spark, sf_dir), "first").select("doc_id").distinct()
        frontier = stage(near.join(found, "doc_id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def text_nodes(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(node_id, section_id, node_type, text, pos, doc_id), staged."""
    return stage(_text_nodes(of), "nodes") if of is not None else _derived(spark, sf_dir, "nodes", lambda: _text_nodes(documents(spark, sf_dir)))


def nodes_once(of: DataFrame) -> DataFrame:
    """What ``text_nodes`` has of staged documents, for one reader: not staged beside the texts that it is made of."""
    return _text_nodes(of)


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, doc_id, text) of all nodes, for one pass over them: not staged."""
    return _text_nodes(documents(spark, sf_dir)).select("node_id", "doc_id", "text")


def tree(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(section_id, level, parent_id, child_pos, doc_id): sections without their texts."""
    return _tree(documents(spark, sf_dir) if of is None else of)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, level, parent_id, child_pos, doc_id, local_text, subtree_text), staged."""
    return _derived(spark, sf_dir, "sections", lambda: _with_subtrees(_sections(tree(spark, sf_dir), text_nodes(spark, sf_dir))))


def edges(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, links_: DataFrame | None = None) -> DataFrame:
    """(src, dst, rel, edge_pos), staged; places of edges order those of one source. ``of``: documents of the sources. ``links_``: all links, if they are staged already."""

    def made() -> DataFrame:
        docs = documents(spark, sf_dir) if of is None else of
        own = links(spark, sf_dir, of) if links_ is None else _links_of(links_, docs)
        return _edges(_tree(docs), _text_nodes(docs), own)

    return stage(made(), "edges") if of is not None else _derived(spark, sf_dir, "edges", made)


def section_vectors(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Sections with e_local and e_subtree, staged."""

    def made() -> DataFrame:
        rows = sections(spark, sf_dir) if of is None else _with_subtrees(_sections(_tree(of), _text_nodes(of)))  # read once: not staged beside the vectors
        found = V.hashed_tf(V.hashed_tf(rows, "local_text", "e_local"), "subtree_text", "e_subtree")
        return found.drop("subtree_text")

    return stage(made(), "section-vectors") if of is not None else _derived(spark, sf_dir, "section-vectors", made)


def node_vectors(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(node_id, section_id, node_type, doc_id, embedding), staged."""
    made = lambda nodes: V.hashed_tf(nodes, "text", "embedding").drop("text", "pos")
    return stage(made(_text_nodes(of)), "node-vectors") if of is not None else _derived(spark, sf_dir, "node-vectors", lambda: made(text_nodes(spark, sf_dir)))


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding), staged."""
    return _derived(spark, sf_dir, "passage-vectors", lambda: V.hashed_tf(passages(spark, sf_dir), "text", "embedding").drop("text"))


def passage_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.build(passages(spark, sf_dir), lambda df, name: _derived(spark, sf_dir, f"passage-{name}", lambda: df))


def line_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    lines_ = line_texts(spark, sf_dir).select(F.col("node_id").alias("id"), "text")
    return bm25.build(lines_, lambda df, name: _derived(spark, sf_dir, f"line-{name}", lambda: df), passages(spark, sf_dir))  # a line's id is its document's with its place


def corpus(spark: SparkSession, sf_dir: str) -> None:
    """Build all staged tables of a folder."""
    for one in (edges, section_vectors, node_vectors, passage_vectors, passage_index, line_index):
        one(spark, sf_dir)


def _text_nodes(docs: DataFrame) -> DataFrame:
    """(node_id, section_id, node_type, text, pos, doc_id)."""
    block, part = F.floor(F.col("pos") / 8), F.floor((F.col("pos") % 8) / 4)
    own = F.concat(F.lit("D"), F.col("doc_id"), F.lit("."), block)
    kind = F.when(T.is_caption(F.col("text")), "caption").when(T.is_bullet_list(F.col("text")), "list_item").otherwise("chunk")
    section = F.when(F.col("pos") % 8 == 0, own).otherwise(F.concat(own, F.lit(".s"), part))
    node = F.concat(own, F.lit("."), F.col("pos"))
    return _lines(docs).select(node.alias("node_id"), section.alias("section_id"), kind.alias("node_type"), "text", "pos", "doc_id")


def _tree(docs: DataFrame) -> DataFrame:
    """(section_id, level, parent_id, child_pos, doc_id): a document's sections follow from how many lines it has, in its row."""
    doc = F.concat(F.lit("D"), F.col("doc_id"))
    counted = docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: T.strip(x) != "")).alias("n"))
    root = counted.select(doc.alias("section_id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("child_pos"), "doc_id")
    blocks = counted.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 8).cast("int"))).alias("b"))
    one = F.concat(doc, F.lit("."), F.col("b"))
    first = blocks.select(one.alias("section_id"), F.lit(1).alias("level"), doc.alias("parent_id"), F.col("b").alias("child_pos"), "doc_id")
    parts = blocks.select("doc_id", "b", F.explode(F.expr("filter(array(0, 1), s -> (s = 0 AND n > 8 * b + 1) OR (s = 1 AND n > 8 * b + 4))")).alias("s"))
    second = parts.select(F.concat(one, F.lit(".s"), F.col("s")).alias("section_id"), F.lit(2).alias("level"), one.alias("parent_id"), F.col("s").alias("child_pos"), "doc_id")
    return root.unionByName(first).unionByName(second)


def _sections(tree_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tree with local_text: the texts of a section's nodes, in order."""
    local = nodes.groupBy("section_id").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY pos)").alias("local_text"))
    return tree_.join(local, "section_id", "left").withColumn("local_text", F.coalesce("local_text", F.lit("")))


def _with_subtrees(found: DataFrame) -> DataFrame:
    return found.join(build.subtree_texts(found), "section_id")


def _edges(tree_: DataFrame, nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """(src, dst, rel, edge_pos): places of edges order those of one source. Nothing of it needs a section's text."""
    down = tree_.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("section_id").alias("dst"), F.lit("HAS_SUBSECTION").alias("rel"), F.col("child_pos").cast("long").alias("edge_pos"))
    held = nodes.select(F.col("section_id").alias("src"), F.col("node_id").alias("dst"), F.when(F.col("node_type") == "list_item", "HAS_ITEM").otherwise("HAS_CHUNK").alias("rel"), (F.col("pos") + 1000).cast("long").alias("edge_pos"))
    across = links_.select(F.concat(F.lit("D"), F.col("first")).alias("src"), F.concat(F.lit("D"), F.col("doc_id")).alias("dst"), F.lit("LINKS_TO").alias("rel"), (F.col("doc_id") + 1000000).alias("edge_pos"))
    return down.unionByName(held).unionByName(across)
