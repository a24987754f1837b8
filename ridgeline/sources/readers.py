"""Readers: graph JSON, JSON lines under three policies, prediction folders, delimited files, articles, id lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as T

NODES = "id string, type string, text string, attributes struct<label:string,chunk_id:string,type:string,level:string,order:double,doc_id:string,dataset:string,split:string,section_id:string>"
EDGES = "source string, target string, type string"
QUERIES = "id string, query string"
ITEM = "struct<chunk_id:string,text:string,score:double,window_node_ids:array<string>>"
PREDICTIONS = f"id string, query string, output_ids array<string>, output_items array<{ITEM}>, output array<string>"


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).option("multiLine", True).json(path)


def sections_of(nodes: DataFrame) -> DataFrame:
    """Sections with an integer level; others are dropped."""
    level = F.expr("try_cast(attributes.level AS int)")
    return nodes.where("type = 'Section'").withColumn("level", level).where("level IS NOT NULL").select(F.col("id").alias("section_id"), "level", F.col("attributes.doc_id").alias("doc_id"), F.col("text").alias("heading"))


def text_nodes_of(nodes: DataFrame) -> DataFrame:
    """Chunks without page numbers, and list items under ``chunk_<chunk_id>``."""
    kind = F.when(F.col("type") == "Chunk", "chunk").when(F.col("type") == "ListItem", "list_item")
    parent = F.when(F.col("type") == "ListItem", F.concat(F.lit("chunk_"), "attributes.chunk_id"))
    rows = nodes.withColumn("node_type", kind).where("node_type IS NOT NULL").where(~((F.col("node_type") == "chunk") & T.is_page_number(F.col("text"))))
    return rows.select(F.col("id").alias("node_id"), "node_type", F.coalesce("text", F.lit("")).alias("text"), parent.alias("parent_id"), F.col("attributes.order").alias("ord"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, rel, edge_pos) in the order of the file, which is read as one array."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{EDGES.replace(' ', ':').replace(',:', ',')}>>").alias("e"))
    return whole.select(F.posexplode("e").alias("edge_pos", "e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("rel"), F.col("edge_pos").cast("long"))


def link(sections: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections with parent_id and child_pos, text nodes with section_id, parent_id and their final type).

    The last edge that names a child wins. A list item without a section of its own takes its parent's.
    """
    s = sections.select("section_id")
    tree = edges.where("rel = 'HAS_SUBSECTION'").join(s.withColumnRenamed("section_id", "src"), "src", "left_semi").join(s.withColumnRenamed("section_id", "dst"), "dst", "left_semi")
    parents = tree.groupBy(F.col("dst").alias("section_id")).agg(F.max_by("src", "edge_pos").alias("parent_id"), F.max("edge_pos").alias("child_pos"))
    held = edges.where("rel = 'HAS_CHUNK'").join(s.withColumnRenamed("section_id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.max_by("src", "edge_pos").alias("section_id"))
    items = edges.where("rel = 'HAS_ITEM'").join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.max_by("src", "edge_pos").alias("item_parent"))
    captions = edges.where("rel = 'CAPTIONS'").select(F.col("src").alias("node_id"), F.lit(True).alias("is_caption")).distinct()
    full = nodes.join(held, "node_id", "left").join(items, "node_id", "left").join(captions, "node_id", "left").withColumn("parent_id", F.coalesce("item_parent", "parent_id"))
    own = held.select(F.col("node_id").alias("parent_id"), F.col("section_id").alias("parent_section"))
    full = full.join(own, "parent_id", "left").withColumn("section_id", F.coalesce("section_id", F.when(F.col("node_type") == "list_item", F.col("parent_section"))))
    linked = full.select("node_id", "section_id", F.when(F.col("is_caption"), "caption").otherwise(F.col("node_type")).alias("node_type"), "text", "parent_id", "ord")
    return sections.join(parents, "section_id", "left"), linked


def cleaned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw nodes without noise (sections all stay), and edges whose ends are left."""
    kept = nodes.withColumn("text", T.strip_page_number(T.normalize_ws(F.col("text")))).where((F.col("type") == "Section") | ~T.is_noise(F.col("text")))
    ids = kept.select("id")
    ends = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, ends


def id_text(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = nodes.where(F.col("type").isin(types)) if types else nodes
    return rows.select("id", T.strip(F.col("text")).alias("text")).where("id IS NOT NULL AND id <> '' AND text <> ''")


def json_lines(spark: SparkSession, path: str, schema: str, policy: str = "strict") -> DataFrame:
    """``strict``: a bad line is an error; ``skip``: bad lines are left out and a missing file is empty."""
    if policy == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def validated_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries; a row without id or query is an error."""
    rows = json_lines(spark, path, QUERIES)
    missing = F.col("id").isNull() | F.col("query").isNull()
    return rows.select(F.when(missing, F.raise_error(F.lit("a query needs id and query"))).otherwise(F.col("id")).alias("qid"), "query")


def predictions(spark: SparkSession, folder: str, windows: bool = False) -> DataFrame:
    """(qid, ids) of a folder of JSON files, one a query; with ``windows`` ids is an array of arrays, without empty ones."""
    rows, qid = _prediction_rows(spark, folder), F.col("qid")
    if windows:
        members = F.transform("output_items", lambda x: F.when(F.size(x["window_node_ids"]) > 0, x["window_node_ids"]).otherwise(F.array(x["chunk_id"])))
        return rows.select(qid.alias("qid"), F.filter(members, lambda m: F.size(F.array_compact(m)) > 0).alias("ids"))
    return rows.select(qid.alias("qid"), F.coalesce("output_ids", F.array_compact(F.transform("output_items", lambda x: x["chunk_id"]))).alias("ids"))


def prediction_items(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, id, text, score, rank) of a folder of predictions; items without an id are left out, texts and scores may be missing."""
    rows = _prediction_rows(spark, folder).select("qid", F.filter(F.coalesce("output_items", F.array().cast(f"array<{ITEM}>")), lambda x: F.coalesce(F.trim(x["chunk_id"]), F.lit("")) != "").alias("x"))
    return rows.select("qid", F.posexplode("x").alias("pos", "x")).select("qid", F.col("x.chunk_id").alias("id"), F.coalesce("x.text", F.lit("")).alias("text"), "x.score", (F.col("pos") + 1).alias("rank"))


def run_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, texts) of ``Q*.json`` files: the field ``output``; files that can't be read or have none are left out."""
    rows = _prediction_rows(spark, folder, "Q*.json", "DROPMALFORMED").where("output IS NOT NULL")
    return rows.select("qid", F.col("output").alias("texts"))


def method_results(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, query, chunks) of a method's files: ``output``, else the texts of ``output_items`` that are not blank.

    An id that differs from the file's name is an error, and so is a file with neither field.
    """
    rows = _prediction_rows(spark, folder)
    texts = F.filter(F.transform("output_items", lambda x: x["text"]), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    named = F.regexp_replace("_file", r"\.json$", "")
    wrong = (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim("id") != named)
    chunks = F.coalesce("output", texts)
    problem = F.when(wrong, F.concat(F.lit("id differs from the name of "), "_file")).when(chunks.isNull(), F.concat("_file", F.lit(" has neither output nor output_items")))
    return rows.select(F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(named).alias("qid"), F.trim(F.coalesce("query", F.lit(""))).alias("query"), chunks.alias("chunks"))


def adapted(rows: DataFrame) -> DataFrame:
    """(id, query, output_items, output_ids) of hybrid predictions whatever their fields are called.

    rows: (id, question_id, query, question, output_items, results, output_ids); items keep all their fields.
    """
    items = F.coalesce("output_items", "results")
    ids = F.coalesce("output_ids", F.array_compact(F.transform(items, lambda x: x["chunk_id"])))
    return rows.select(F.coalesce("id", "question_id").alias("id"), F.coalesce("query", "question").alias("query"), items.alias("output_items"), ids.alias("output_ids"))


def _prediction_rows(spark: SparkSession, folder: str, pattern: str = "*.json", mode: str = "PERMISSIVE") -> DataFrame:
    rows = spark.read.schema(PREDICTIONS).option("multiLine", True).option("mode", mode).option("pathGlobFilter", pattern).json(folder).withColumn("_file", F.col("_metadata.file_name"))
    rows = rows.where(~F.col("_file").isin("config.json") & ~F.col("_file").endswith(".debug.json"))
    return rows.withColumn("qid", F.coalesce("id", F.regexp_replace("_file", r"\.json$", "")))


def json_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, qid, replica, raw) of all JSON files below a folder that are named ``Q…`` or ``Q…_N``; raw is the whole text."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    name = F.col("_metadata.file_name")
    grammar = r"^(Q[0-9A-Za-z]+)(?:_([0-9]+))?\.json$"
    found = rows.select(F.col("_metadata.file_path").alias("file"), F.nullif(F.regexp_extract(name, grammar, 1), F.lit("")).alias("qid"), F.nullif(F.regexp_extract(name, grammar, 2), F.lit("")).cast("int").alias("replica"), F.col("value").alias("raw"))
    return found.where("qid IS NOT NULL")


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """(qid, query, mapping, file) of payload files, named by their qid without a replica; letters A to E only; of several the last file."""
    rows = json_files(spark, root).where("replica IS NULL")
    body = F.from_json("raw", "id string, query string, private_mapping map<string,string>")
    rows = rows.withColumn("b", body).where(F.col("b.id").rlike("^Q[0-9A-Za-z]+$"))
    mapping = F.map_filter(F.coalesce("b.private_mapping", F.create_map().cast("map<string,string>")), lambda k, _: k.isin("A", "B", "C", "D", "E"))
    return rows.groupBy(F.col("b.id").alias("qid")).agg(F.max_by(F.struct(F.coalesce("b.query", F.lit("")).alias("query"), mapping.alias("mapping"), "file"), "file").alias("x")).select("qid", "x.*")


def expected_qids(spark: SparkSession, root: str) -> DataFrame:
    """(qid, place): the qids of all payload files by their numbers."""
    rows = json_files(spark, root).where("replica IS NULL").select("qid").distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(T.qid_order(F.col("qid")))))  # one row for each payload


def question_ids(rows: DataFrame) -> DataFrame:
    """(qid, type, pmids): distinct ids of each question, sorted, and its first type that is not empty. rows: (qid, type, pmid, pos)."""
    kind = F.nullif(F.trim("type"), F.lit(""))
    ids = F.sort_array(F.collect_set(F.nullif(F.trim("pmid"), F.lit(""))))
    return rows.groupBy("qid").agg(F.min_by(kind, F.when(kind.isNotNull(), F.col("pos"))).alias("type"), ids.alias("pmids"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids) of rows with id or question_id; blank ids are left out."""
    rows = json_lines(spark, path, "id string, question_id string, gold_chunk_ids array<string>")
    return rows.select(F.coalesce("id", "question_id").alias("qid"), F.filter(F.coalesce("gold_chunk_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias("ids"))


def delimited(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> DataFrame:
    """Named columns of a comma or tab file, gzip or not, by any of their aliases in any case. The separator is the first line's more frequent one."""
    head = re.sub(r'"(?:[^"]|"")*"', "", (spark.read.text(path).first() or [""])[0].lstrip("﻿"))  # separators in quotes are none
    sep = "\t" if head.count("\t") > head.count(",") else ","
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    by_name = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    picked = []
    for name, aliases in columns.items():
        found = [F.trim(F.col(f"`{by_name[a.lower()]}`")) for a in [name, *aliases] if a.lower() in by_name]
        if not found:
            raise ValueError(f"{path} has no column for {name}")
        picked.append(F.coalesce(*found).alias(name))
    return rows.select(picked)


def id_map(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pmid, pmcid) of the wanted pmids, the first pmcid that is not empty. rows: (pmid, pmcid, pos)."""
    kept = rows.join(wanted.select("pmid").distinct(), "pmid", "left_semi").withColumn("pmcid", T.normalize_pmcid(F.col("pmcid"))).where("pmcid IS NOT NULL")
    return kept.groupBy("pmid").agg(F.min_by("pmcid", "pos").alias("pmcid"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file with one on each line, by first place."""
    rows = spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("pos")).where("id <> ''")
    return rows.groupBy("id").agg(F.min("pos").alias("pos"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, status, title, paragraphs, has_article_tag, has_body, n_sec, error) of JATS XML files."""
    from ridgeline.operators.python_ops import jats_article

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), jats_article(F.decode("content", "utf-8")).alias("a")).select("file", "bytes", "a.*")


def structured_chunks(found: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(pmcid, article_title, source_type, section_path, paragraph_index, chunk_index, chunk_id, text) from ``articles``."""
    pmcid = F.regexp_extract("file", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    rows = found.where("status = 'valid'").select(pmcid.alias("pmcid"), F.col("title").alias("article_title"), F.explode("paragraphs").alias("p"))
    rows = rows.select("pmcid", "article_title", F.col("p.source").alias("source_type"), F.col("p.path").alias("section_path"), F.col("p.idx").alias("paragraph_index"), F.posexplode(T.chunk_windows(F.col("p.text"), size, overlap)).alias("chunk_index", "text"))
    name = F.concat_ws("::", "pmcid", "source_type", F.array_join("section_path", " > "), F.concat(F.lit("p"), "paragraph_index", F.lit(":c"), "chunk_index"))
    return rows.withColumn("chunk_id", name)


def qasper_chunks(papers: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, section, text): the abstract and each paragraph of parallel section arrays, up to the shorter one."""
    abstract = papers.where(T.strip(F.col("abstract")) != "").select(F.col("id").alias("doc_id"), F.concat("id", F.lit("_abstract")).alias("chunk_id"), F.lit("Abstract").alias("section"), F.col("abstract").alias("text"))
    n = F.least(F.size("full_text.section_name"), F.size("full_text.paragraphs"))
    zipped = F.arrays_zip(F.slice("full_text.section_name", 1, n).alias("name"), F.slice("full_text.paragraphs", 1, n).alias("paragraphs"))
    body = papers.select(F.col("id").alias("doc_id"), F.posexplode(zipped).alias("s", "z"))
    body = body.select("doc_id", "s", F.col("z.name").alias("section"), F.posexplode("z.paragraphs").alias("p", "text")).where(T.strip(F.col("text")) != "")
    return abstract.unionByName(body.select("doc_id", F.concat_ws(".", "doc_id", "s", "p").alias("chunk_id"), "section", "text"))


def marked_labels(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    """(pair_id, axis, label, problem) of a Markdown form: ``## pair``, then ``axis:`` lines with one box checked among A, B, equal."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    order = Window.partitionBy("file").orderBy("pos")  # forms that persons fill in, each by itself
    pair = F.last(F.nullif(F.regexp_extract("line", r"^##\s+(\S+)", 1), F.lit("")), True).over(order)
    axis = F.last(F.nullif(F.regexp_extract(F.lower("line"), "^\\W*(" + "|".join(axes) + r")\b", 1), F.lit("")), True).over(order)
    checked = F.regexp_extract("line", r"(?i)\[x\]\s*(A|B|equal)", 1)
    found = rows.select(pair.alias("pair_id"), axis.alias("axis"), checked.alias("label"), F.col("line").rlike(r"\[[ xX]\]").alias("box")).where("box")
    per = found.groupBy("pair_id", "axis").agg(F.array_compact(F.collect_list(F.nullif("label", F.lit("")))).alias("l"))
    return per.select("pair_id", "axis", F.when(F.size("l") == 1, F.col("l")[0]).alias("label"), F.when(F.size("l") != 1, F.concat(F.size("l").cast("string"), F.lit(" boxes checked"))).alias("problem"))
