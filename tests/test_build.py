"""Graphs from papers and structured chunks."""

from ridgeline.functions import vectors as V
from ridgeline.operators import build
from ridgeline.operators import python_ops as P
from ridgeline.sources import readers

PAPER = "id string, title string, abstract string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, qas struct<question:array<string>,question_id:array<string>,answers:array<struct<answer:array<struct<evidence:array<string>>>>>>"


def papers(spark):
    qas = (["q?"], ["k1"], [([(["Same  text", "same text"],), (["Other"],)],)])
    return spark.createDataFrame([("D", "T", "abs", (["A", "A ::: B", "C ::: D", "extra"], [["p0", " "], ["p1"], ["p2"]]), qas)], PAPER)


def test_paper_graph(spark):
    nodes, edges = build.paper_graph(papers(spark))
    assert {r["id"]: (r["type"], r["level"]) for r in nodes.collect()} == {
        "D": ("Section", 0), "D.abstract": ("Section", 1), "D_abstract": ("Chunk", None), "D.0": ("Section", 1), "D.1": ("Section", 2), "D.2": ("Section", 2),
        "D.0.0": ("Chunk", None), "D.1.0": ("Chunk", None), "D.2.0": ("Chunk", None),
    }
    tree = {r["dst"]: r["src"] for r in edges.collect()}
    assert tree == {"D.abstract": "D", "D_abstract": "D.abstract", "D.0": "D", "D.1": "D.0", "D.2": "D", "D.0.0": "D.0", "D.1.0": "D.1", "D.2.0": "D.2"}


def test_evidence_keeps_the_first_spelling(spark):
    rows = build.evidence(papers(spark)).orderBy("pos").collect()
    assert [(r["qid"], r["evidence"]) for r in rows] == [("D__k1", "Same  text"), ("D__k1", "Other")]


def test_paper_chunks(spark):
    assert sorted(r["chunk_id"] for r in readers.qasper_chunks(papers(spark)).collect()) == ["D.0.0", "D.1.0", "D.2.0", "D_abstract"]


def test_articles_to_graph(spark, tmp_path):
    (tmp_path / "PMC1.xml").write_text("<article><front><article-title>T</article-title><abstract><p>Ab</p></abstract></front><body><p>free</p><sec><title>X</title><p>one</p><sec><title>Y</title><p>two</p></sec></sec><sec><title>Z</title><p>three</p></sec></body></article>")
    (tmp_path / "PMC2.xml").write_text("<broken")
    found = readers.articles(spark, str(tmp_path))
    assert {r["status"] for r in found.collect()} == {"valid", "missing_article_tag"}
    chunks = readers.structured_chunks(found)
    nodes, edges = build.chunk_graph(chunks)
    sections = {r["id"]: r["text"] for r in nodes.where("type = 'Section'").collect()}
    assert sections == {"PMC1": "", "PMC1.abstract": "abstract", "PMC1.0": "X", "PMC1.0.0": "Y", "PMC1.1": "Z"}
    tree = {r["dst"]: r["src"] for r in edges.where("rel = 'HAS_SUBSECTION'").collect()}
    assert tree == {"PMC1.abstract": "PMC1", "PMC1.0": "PMC1", "PMC1.0.0": "PMC1.0", "PMC1.1": "PMC1"}
    assert edges.where("rel = 'HAS_CHUNK' AND src = 'PMC1'").count() == 0  # paragraphs outside sections are none


def test_equal_texts_are_encoded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " ")], "i int, text string")
    rows = {r["i"]: r["embedding"] for r in build.embedded(df, V.hashed_tf).collect()}
    assert rows[1] == rows[2] and sum(rows[1]) == 2 and rows[3] is None


def test_page():
    rows = P.page_rows("<h1>A</h1><p>x <b>y</b></p><h2>B</h2><p>z")
    assert [(r["kind"], r["path"], r["text"]) for r in rows] == [("h1", ["A"], "A"), ("p", ["A"], "x y"), ("h2", ["A", "B"], "B"), ("p", ["A", "B"], "z")]
