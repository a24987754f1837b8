"""Readers, writers and streams on small files."""

import json

import pytest

from ridgeline.operators import bm25
from ridgeline.sources import readers, writers
from ridgeline.streaming import log


def test_graph_files(spark, tmp_path):
    nodes = [
        {"id": "r", "type": "Section", "text": "R", "attributes": {"level": 0}},
        {"id": "s", "type": "Section", "text": "S", "attributes": {"level": 1}},
        {"id": "bad", "type": "Section", "attributes": {}},
        {"id": "chunk_1", "type": "Chunk", "text": "hello there"},
        {"id": "p", "type": "Chunk", "text": "12"},
        {"id": "i", "type": "ListItem", "text": "item", "attributes": {"chunk_id": "1"}},
        {"id": "c", "type": "Chunk", "text": "a caption"},
    ]
    edges = [("r", "s", "HAS_SUBSECTION"), ("s", "chunk_1", "HAS_CHUNK"), ("s", "c", "HAS_CHUNK"), ("c", "f", "CAPTIONS")]
    (tmp_path / "n.json").write_text(json.dumps(nodes))
    (tmp_path / "e.json").write_text(json.dumps([dict(zip(("source", "target", "type"), e)) for e in edges]))
    raw = readers.graph_nodes(spark, str(tmp_path / "n.json"))
    e = readers.graph_edges(spark, str(tmp_path / "e.json"))
    assert [tuple(r)[:3] for r in e.orderBy("edge_pos").collect()] == edges
    sections, texts = readers.link(readers.sections_of(raw), readers.text_nodes_of(raw), e)
    assert {r["section_id"]: r["parent_id"] for r in sections.collect()} == {"r": None, "s": "r"}
    found = {r["node_id"]: (r["section_id"], r["node_type"]) for r in texts.collect()}
    assert found == {"chunk_1": ("s", "chunk"), "i": ("s", "list_item"), "c": ("s", "caption")}


def test_json_lines_policies(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id": "a", "query": "x"}\n\nnot json\n')
    assert [r["id"] for r in readers.json_lines(spark, str(path), readers.QUERIES, "skip").collect()] == ["a"]
    assert readers.json_lines(spark, str(tmp_path / "none"), readers.QUERIES, "skip").count() == 0
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), readers.QUERIES).collect()


def test_predictions(spark, tmp_path):
    (tmp_path / "Q1.json").write_text(json.dumps({"id": "Q1", "output_ids": ["a", "b"]}))
    (tmp_path / "Q2.json").write_text(json.dumps({"output_items": [{"chunk_id": "c"}]}))
    (tmp_path / "config.json").write_text("{}")
    assert {r["qid"]: r["ids"] for r in readers.predictions(spark, str(tmp_path)).collect()} == {"Q1": ["a", "b"], "Q2": ["c"]}


def test_delimited_by_alias(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("PubMed\tPMC_ID\n1\tpmc7\n2\t\n")
    rows = readers.delimited(spark, str(path), {"pmid": ["pubmed"], "pmcid": ["pmc", "pmc_id"]})
    from pyspark.sql import functions as F

    mapped = readers.id_map(rows.withColumn("pos", F.monotonically_increasing_id()), rows)
    assert [tuple(r) for r in mapped.collect()] == [("1", "PMC7")]


def test_marked_labels(spark, tmp_path):
    path = tmp_path / "f.md"
    path.write_text("## p001\nrelevance:\n- [x] A\n- [ ] B\nsufficiency:\n- [x] A\n- [x] B\n")
    rows = {(r["pair_id"], r["axis"]): (r["label"], r["problem"]) for r in readers.marked_labels(spark, str(path), ["relevance", "sufficiency"]).collect()}
    assert rows == {("p001", "relevance"): ("A", None), ("p001", "sufficiency"): (None, "2 boxes checked")}


def test_index_round_trip(spark, tmp_path):
    passages = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id int, text string")
    writers.save_index({"terms": bm25.term_stats(bm25.build(passages))}, str(tmp_path / "i"), dim=64, model="m")
    assert writers.load_index(spark, str(tmp_path / "i"), "terms", 64, "m").count() == 2
    with pytest.raises(ValueError):
        writers.load_index(spark, str(tmp_path / "i"), "terms", 32)


def test_result_documents(spark):
    hits = spark.createDataFrame([("q", "c2", 2, "вторая строка", 0.5), ("q", "c1", 1, "first", 0.9)], "qid string, id string, rank int, text string, score double")
    doc = writers.result_documents(hits, spark.createDataFrame([("q", "?"), ("r", "!")], "qid string, query string")).orderBy("id").collect()
    assert doc[0]["output_ids"] == ["c1", "c2"] and doc[0]["output_items"][1]["text"] == "вторая строка" and doc[1]["output_ids"] == []


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "ok", 1), ("p1", "error", 2), ("p2", "ok", 3)], "pair_id string, status string, seq int")
    writers.append_log(rows, str(tmp_path / "log"))
    stream = log.read_log(spark, str(tmp_path / "log"), rows.schema)
    log.run_available(log.latest_by_key(stream, "pair_id", "seq"), "latest_t", str(tmp_path / "c1"))
    assert {r["pair_id"]: r["status"] for r in spark.table("latest_t").collect()} == {"p1": "error", "p2": "ok"}
    log.run_available(log.counters(stream, "status"), "counters_t", str(tmp_path / "c2"))
    assert {r["status"]: r["n"] for r in spark.table("counters_t").collect()} == {"ok": 2, "error": 1}
    log.upsert(stream, str(tmp_path / "t"), "pair_id", "seq", str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "t/v0")).count() == 2
    todo = spark.createDataFrame([("p1",), ("p3",)], "pair_id string")
    assert [r["pair_id"] for r in writers.pending(todo, rows).collect()] == ["p3"]
