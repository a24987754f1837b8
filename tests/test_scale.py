"""What queries may not build or shuffle, and that what they do instead gives the same."""

import pytest

from pyspark.sql import functions as F

from ridgeline.config import Score
from ridgeline.functions import text as T
from ridgeline.operators import bm25, walk, windows
from ridgeline.plans import queries as Q
from ridgeline.plans import tables as D

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def built(monkeypatch):
    """Names of the tables of all documents that were asked for."""
    names, derived = [], D.derived
    monkeypatch.setattr(D, "derived", lambda spark, sources, name, build: names.append(name) or derived(spark, sources, name, build))
    return names


@pytest.mark.parametrize("name", ["bfs_expand", "restricted_edges"])
def test_no_texts_of_all_sections_for_a_walk(spark, built, name):
    Q.QUERIES[name](spark, DIR)
    assert not {"nodes", "sections", "edges", "section-vectors", "node-vectors"} & set(built)


def test_scores_in_tasks_equal_joined_ones(spark, monkeypatch):
    """Blocks and steps of any size, queries of equal terms, one that is null, one without terms."""
    monkeypatch.setattr(bm25, "STEP", 7)
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 3 + i % 9))) for i in range(60)] + [(60, ""), (61, None)]
    asked = [(1, "w1 w2 w2"), (2, "w2 w1"), (3, "w7 absent"), (4, "the"), (None, "w3"), (5, "w1 w4 w9 w10")]
    index = bm25.build(spark.createDataFrame(texts, "id long, text string").repartition(3))
    queries = spark.createDataFrame(asked, "qid int, query string")
    joined = bm25.Index(index.rows, index.stats, keyed=False)
    found = lambda df: sorted(((r["qid"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect()), key=str)
    assert index.keyed and found(bm25.top_k(index, queries, 4)) == found(bm25.top_k(joined, queries, 4))
    monkeypatch.setattr(bm25.dense, "BLOCK_BYTES", 100)
    assert "hashpartitioning(qid" not in bm25._best(index, queries, 4, bm25.Bm25(), 100)._jdf.queryExecution().executedPlan().toString()
    assert {r["qid"] for r in bm25._best(index, queries, 4, bm25.Bm25(), 100).collect()} == {1, 2, 3, 5, None}


def test_terms_of_ranked_queries_are_counted_once(spark, monkeypatch):
    """Rare terms of queries that were just ranked take no pass of their own; those of others do; both are the same."""
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 3 + i % 9))) for i in range(60)]
    index, fresh = (bm25.build(spark.createDataFrame(texts, "id long, text string")) for _ in range(2))
    queries = spark.createDataFrame([(1, "w1 w2 absent"), (2, "w7 w3 w1"), (3, "absent")], "qid int, query string")
    passes, counts = [], bm25._counts
    monkeypatch.setattr(bm25, "_counts", lambda *a: passes.append(1) or counts(*a))
    bm25.top_k(index, queries, 4)
    found = sorted(map(tuple, bm25.rare_terms(index, queries, 2).collect()))
    assert len(passes) == 1 and found == sorted(map(tuple, bm25.rare_terms(fresh, queries, 2).collect())) and len(passes) == 2
    other = spark.createDataFrame([(1, "w9 w1")], "qid int, query string")
    assert sorted(map(tuple, bm25.rare_terms(index, other, 2).collect())) == sorted(map(tuple, bm25.rare_terms(fresh, other, 2).collect())) and len(passes) == 4


def test_repeated_ids_are_joined(spark):
    """Rows of one id and length are one passage, as in the SQL: such an index is not keyed."""
    index = bm25.build(spark.createDataFrame([(1, "a1 b1"), (1, "a1 c1"), (2, "b1"), (3, "c1")], "id long, text string"))
    assert not index.keyed and index.stats.first()["n_docs"] == 3
    assert {(r["term"], r["df"]) for r in bm25.term_stats(index).collect()} == {("a1", 1), ("b1", 2), ("c1", 2)}


def test_windows_are_made_of_documents_with_ranked_nodes(spark, monkeypatch):
    """What the walk reaches beside them is read for its scores alone; windows of the sections with anchors are those of all nodes."""
    sizes, text_nodes = [], D.text_nodes

    def counted(spark, d, of=None):
        found = text_nodes(spark, d, of)
        sizes.append(found.select("doc_id").distinct().count())
        return found

    ranked, found = Q._node_scores(spark, DIR, Q.Score())
    monkeypatch.setattr(D, "text_nodes", counted)
    monkeypatch.setattr(Q, "_node_scores", lambda *_: (ranked, found))
    made = Q._windows(spark, DIR)
    assert sizes == [ranked.select(Q._named(F.col("node_id"))).distinct().count()] and sizes[0] < found.count()
    monkeypatch.setattr(windows, "anchored", lambda ranked, nodes: nodes)
    every = windows.assemble(ranked, text_nodes(spark, DIR))
    rows = lambda df: sorted(map(str, df.collect()))
    assert made.count() and rows(made) == rows(every)


def test_links_of_a_walk_are_hashed_once(spark, monkeypatch):
    asked, links = [], D.links
    monkeypatch.setattr(D, "links", lambda spark, d, of=None: asked.append(of) or links(spark, d, of))
    Q.QUERIES["bfs_expand"](spark, DIR)
    assert asked and not any(asked)


def test_lines_that_answer_are_found_once_and_dealt(spark, monkeypatch):
    """Two readers of the gold lines share one staged table, made by tasks that share the pairs; the rows are those of each pair looked at."""
    names, derived = [], Q.derived
    monkeypatch.setattr(Q, "derived", lambda spark, sources, name, build: names.append(name) or derived(spark, sources, name, build))
    found = Q._gold_held(spark, DIR)
    assert "gold-held" in names and Q._gold_held(spark, DIR) is found
    held = Q._gold(spark, DIR).withColumnRenamed("id", "doc_id")
    pairs = held.join(D.queries(spark, DIR), "qid").join(D.text_nodes(spark, DIR).select("doc_id", "node_id", "text"), "doc_id")
    want = pairs.where(T.overlap_ratio(F.col("text"), F.col("query")) >= 0.3).select("qid", "node_id", "doc_id")
    assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = Q._lines_held(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "regexp_replace" not in plan.split("Join")[0]


def test_vectors_of_pairs_end_before_the_join_with_levels(spark):
    """A pair of a query and a node goes on with its similarity, not with two vectors; scores are as they were."""
    nodes = spark.createDataFrame([("n1", "s1", "chunk", [1.0, 0.0]), ("n2", "s2", "caption", [1.0, 1.0]), ("n3", "s9", "chunk", None)], "node_id string, section_id string, node_type string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid int, qvec array<double>")
    levels = spark.createDataFrame([("s1", 1), ("s2", 2)], "section_id string, level int")
    far = spark.createDataFrame([(q, n, 2) for q in (1, 2) for n in ("n1", "n2", "n3")], "qid int, node string, dist int")
    found = walk.node_scores(nodes, queries, levels, far, Score())
    above = found._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[0]
    assert "embedding" not in above and "qvec" not in above
    got = {(r["qid"], r["node_id"]): round(r["score"], 6) for r in found.collect()}
    # similarity + 0.3 x type + 0.15 x level - 0.2 x hops
    assert got == {(1, "n1"): 0.795, (2, "n1"): -0.205, (1, "n2"): 0.397107, (2, "n2"): 0.397107, (1, "n3"): -1.205, (2, "n3"): -1.205}


def test_a_walk_in_few_documents_stages_vectors_alone(spark, built, monkeypatch):
    """Neither the lines nor the sections' texts of the picked documents lie in the shared folder beside the documents and the vectors."""
    names, stage = [], D.stage
    monkeypatch.setattr(D, "stage", lambda df, name, *a: names.append(name) or stage(df, name, *a))
    Q.QUERIES["hybrid_walk"](spark, DIR)
    assert {"picked", "section-vectors", "node-vectors"} <= set(names) and not {"nodes", "sections"} & {*names, *built}
