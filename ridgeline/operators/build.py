"""Graphs of papers and of structured chunks: sections, chunks and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.staging import stage

SEPARATOR = " ::: "
NODE = ["id", "type", "text", "level", "order", "doc_id"]


def paper_graph(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers with parallel arrays of section names and paragraphs.

    The document is a section of level 0; the abstract and each named section hang below. A name ``A ::: B`` belongs under the last earlier
    section of that name ``A``, else under the document. Paragraphs are chunks in order. papers: (id, title, abstract, full_text).
    """
    doc = papers.select(F.col("id").alias("doc_id"), "title", "abstract", F.col("full_text.section_name").alias("names"), F.col("full_text.paragraphs").alias("paragraphs"))
    root = doc.select(F.col("doc_id").alias("id"), F.lit("Section").alias("type"), F.coalesce("title", F.lit("")).alias("text"), F.lit(0).alias("level"), F.lit(0).alias("order"), "doc_id")
    with_abstract = doc.where(T.strip(F.col("abstract")) != "")
    abstract = with_abstract.select(F.concat("doc_id", F.lit(".abstract")).alias("id"), F.lit("Section").alias("type"), F.lit("Abstract").alias("text"), F.lit(1).alias("level"), F.lit(-1).alias("order"), "doc_id")
    abstract_chunk = with_abstract.select(F.concat("doc_id", F.lit("_abstract")).alias("id"), F.lit("Chunk").alias("type"), F.col("abstract").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("order"), "doc_id")
    n = F.least(F.size("names"), F.size("paragraphs"))
    zipped = F.arrays_zip(F.slice("names", 1, n).alias("name"), F.slice("paragraphs", 1, n).alias("paragraphs"))
    rows = doc.select("doc_id", F.posexplode(zipped).alias("s", "z")).select("doc_id", "s", F.coalesce("z.name", F.lit("")).alias("name"), "z.paragraphs")
    rows = rows.withColumn("section", F.concat_ws(".", "doc_id", "s")).withColumn("parts", F.split("name", SEPARATOR))
    # the whole path but its last part names the parent; of several the last before this one
    rows = rows.withColumn("above", F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 1, F.size("parts") - 1), SEPARATOR)))
    known = rows.select(F.col("doc_id").alias("_d"), F.col("name").alias("_n"), F.col("s").alias("_s"), F.col("section").alias("_p"))
    parent = rows.join(known, (F.col("doc_id") == F.col("_d")) & (F.col("above") == F.col("_n")) & (F.col("_s") < F.col("s")), "left").groupBy("section").agg(F.max_by("_p", "_s").alias("_found"))
    rows = rows.join(parent, "section", "left").withColumn("parent", F.coalesce("_found", "doc_id"))
    section = rows.select(F.col("section").alias("id"), F.lit("Section").alias("type"), F.element_at("parts", -1).alias("text"), F.size("parts").alias("level"), F.col("s").alias("order"), "doc_id")
    paragraphs = rows.select("doc_id", "section", F.posexplode("paragraphs").alias("p", "text")).where(T.strip(F.col("text")) != "")
    chunk = paragraphs.select(F.concat_ws(".", "section", "p").alias("id"), F.lit("Chunk").alias("type"), "text", F.lit(None).cast("int").alias("level"), F.col("p").alias("order"), "doc_id")
    nodes = root
    for part in (abstract, abstract_chunk, section, chunk):
        nodes = nodes.unionByName(part)

    def edges(df: DataFrame, src, dst, rel: str, at) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), at.cast("long").alias("edge_pos"))

    found = edges(with_abstract, F.col("doc_id"), F.concat("doc_id", F.lit(".abstract")), "HAS_SUBSECTION", F.lit(-1))
    found = found.unionByName(edges(with_abstract, F.concat("doc_id", F.lit(".abstract")), F.concat("doc_id", F.lit("_abstract")), "HAS_CHUNK", F.lit(0)))
    found = found.unionByName(edges(rows, F.col("parent"), F.col("section"), "HAS_SUBSECTION", F.col("s")))
    return nodes, found.unionByName(edges(paragraphs, F.col("section"), F.concat_ws(".", "section", "p"), "HAS_CHUNK", F.col("p")))


def chunk_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of structured chunks: each prefix of a section path is a section, numbered under its parent by first appearance.

    chunks: (pmcid, source_type, section_path, paragraph_index, chunk_index, chunk_id, text). Chunks without a path hang on the
    document, those of the abstract on ``pmcid.abstract``. Paths may be of any length: a round names one level of sections.
    """
    rows = chunks.withColumn("at", F.struct("paragraph_index", "chunk_index"))
    path = F.when(F.col("source_type") == "abstract", F.array(F.lit("abstract"))).otherwise(F.coalesce("section_path", F.array().cast("array<string>")))
    rows = rows.withColumn("path", path)
    prefixes = rows.select("pmcid", "at", "source_type", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("path"))), lambda k: F.slice("path", 1, k))).alias("path")).where(F.size("path") > 0)
    found = prefixes.groupBy("pmcid", "path").agg(F.min("at").alias("first"), F.first("source_type").alias("source_type"))
    found = found.withColumn("above", F.expr("slice(path, 1, size(path) - 1)")).withColumn("level", F.size("path"))
    number = F.row_number().over(Window.partitionBy("pmcid", "above", F.col("source_type") == "abstract").orderBy("first")) - 1
    found = found.withColumn("step", F.when(F.col("source_type") == "abstract", "abstract").otherwise(number.cast("string")))
    found = stage(found, "prefixes")
    ids = found.where("level = 1").select("pmcid", "path", "first", "level", F.concat_ws(".", "pmcid", "step").alias("id"), F.col("pmcid").alias("parent"))
    level, deepest = stage(ids, "level"), found.agg(F.max("level")).first()[0] or 0
    ids = level
    for k in range(2, deepest + 1):  # an id is its parent's and a number
        up = level.select("pmcid", F.col("path").alias("above"), F.col("id").alias("parent"))
        level = stage(found.where(F.col("level") == k).join(up, ["pmcid", "above"]).select("pmcid", "path", "first", "level", F.concat_ws(".", "parent", "step").alias("id"), "parent"), "level")
        ids = ids.unionByName(level)
    root = rows.select("pmcid").distinct()
    held = rows.join(ids.select("pmcid", "path", F.col("id").alias("section")), ["pmcid", "path"], "left").withColumn("section", F.coalesce("section", "pmcid"))
    nodes = root.select(F.col("pmcid").alias("id"), F.lit("Section").alias("type"), F.lit("").alias("text"), F.lit(0).alias("level"), F.col("pmcid").alias("doc_id"))
    nodes = nodes.unionByName(ids.select("id", F.lit("Section").alias("type"), F.element_at("path", -1).alias("text"), "level", F.col("pmcid").alias("doc_id")))
    nodes = nodes.unionByName(held.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("type"), "text", F.lit(None).cast("int").alias("level"), F.col("pmcid").alias("doc_id")))
    order = F.row_number().over(Window.partitionBy("src").orderBy("first")) - 1
    tree = ids.select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("HAS_SUBSECTION").alias("rel"), "first")
    kept = held.select(F.col("section").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("rel"), F.col("at").alias("first"))
    return nodes, tree.unionByName(kept).withColumn("edge_pos", order.cast("long")).drop("first")


def ancestors(tree: DataFrame) -> DataFrame:
    """(section_id, above, key): every section with itself and all that are above it, and the places on the way down from there.

    tree: (section_id, parent_id, child_pos). A round goes one level up for all sections at once and ends at the roots, however deep.
    """
    up = stage(tree.select(F.col("section_id").alias("_s"), F.col("parent_id").alias("_p"), F.col("child_pos").cast("long").alias("_c")), "tree")
    here = stage(up.select(F.col("_s").alias("section_id"), F.col("_s").alias("above"), F.array().cast("array<bigint>").alias("key")), "ancestors")
    found = here
    while True:
        above = here.join(up, F.col("above") == F.col("_s")).where("_p IS NOT NULL")
        here = stage(above.select("section_id", F.col("_p").alias("above"), F.concat(F.array("_c"), "key").alias("key")), "ancestors")
        if here.isEmpty():
            return found
        found = found.unionByName(here)


def subtree_texts(sections: DataFrame) -> DataFrame:
    """(section_id, subtree_text): local texts of a section and all below it in pre-order, blank ones left out.

    sections: (section_id, parent_id, child_pos, local_text), a forest of any depth.
    """
    rows = ancestors(sections).join(sections.select("section_id", "local_text"), "section_id")
    kept = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("key", "local_text"))), lambda x: x["local_text"]), lambda t: t != "")
    return rows.groupBy(F.col("above").alias("section_id")).agg(F.array_join(kept, "\n").alias("subtree_text"))


def section_paths(sections: DataFrame, name: str = "section_id") -> DataFrame:
    """(section_id, path): ``name`` of all sections from the root to this one."""
    names = sections.select(F.col("section_id").alias("above"), F.col(name).alias("_name"))
    rows = ancestors(sections).join(names, "above")
    steps = F.transform(F.array_sort(F.collect_list(F.struct((-F.size("key")).alias("at"), "_name"))), lambda x: x["_name"])
    return rows.groupBy("section_id").agg(steps.alias("path"))


def evidence(papers: DataFrame) -> DataFrame:
    """(qid, doc_id, evidence) of all annotators' evidence, each normalised text once in its first spelling. papers: (id, qas)."""
    qas = F.arrays_zip(F.col("qas.question_id").alias("question_id"), F.col("qas.answers").alias("answers"))
    rows = papers.select(F.col("id").alias("doc_id"), F.explode(qas).alias("q"))
    own = F.flatten(F.transform("q.answers.answer", lambda x: x["evidence"]))
    each = rows.select("doc_id", F.concat_ws("__", "doc_id", "q.question_id").alias("qid"), F.posexplode(own).alias("pos", "evidence"))
    kept = each.withColumn("n", T.normalize_evidence(F.col("evidence"))).where("n <> ''")
    return kept.groupBy("qid", "doc_id", "n").agg(F.min_by("evidence", "pos").alias("evidence"), F.min("pos").alias("pos")).drop("n")


def embedded(df: DataFrame, encoder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds vectors; equal texts are encoded once, blank ones have none."""
    distinct = df.select(F.col(text).alias("_t")).where(T.strip(F.col("_t")) != "").distinct()
    return df.join(encoder(distinct, "_t", out), F.col(text) == F.col("_t"), "left").drop("_t")
