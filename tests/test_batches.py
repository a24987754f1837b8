"""What tasks make of Arrow batches against the Column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import batches
from ridgeline.functions import text as T
from ridgeline.operators import bm25
from ridgeline.plans import queries as Q
from ridgeline.plans import tables as D

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    pieces = [*"aZ_9 ёЁяЖ\n\t-.é中İıſK Σς\u0085  　\u001c\U0001f600Ѐѐ", "стола", "Настройками", "тестах", "run2 ", " bibref3 ", "BİBREF1", "xFigRef12 ", " TABREF7. ", "ref"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, " ", "ё", "слов" * 5000]
    return spark.createDataFrame(list(enumerate(rows)), "i int, text string").repartition(3).persist()


@pytest.mark.parametrize("step", [1, 64, 4 << 20])
def test_tokens_and_normalised_texts(texts, monkeypatch, step):
    monkeypatch.setattr(batches, "STEP_BYTES", step)
    rows = texts.select(T.tokenize(F.col("text")).alias("k"), T.normalize_evidence(F.col("text")).alias("n"), batches.lowered(F.col("text")).alias("l"), batches.half_normalized(F.col("text")).alias("h")).toArrow()
    low, half = rows.column("l").combine_chunks(), rows.column("h").combine_chunks()
    found = [[] for _ in range(rows.num_rows)]
    for at, part in batches.steps(low):
        row, token = batches.tokens(part)
        for r, t in zip(row.tolist(), token.to_pylist()):
            found[at + r].append(t)
    assert found == rows.column("k").to_pylist()
    assert batches.normalized(half).to_pylist() == rows.column("n").to_pylist()


def test_no_tokens_staged_for_an_index(spark):
    """Where ids are keys, an index holds no second copy of the texts."""
    for index in (D.passage_index(spark, DIR), D.line_index(spark, DIR)):
        assert index.keyed and index.texts is not None
        assert {f for f in index.rows.inputFiles()} == {f for f in D.documents(spark, DIR).inputFiles()}


def test_rare_terms_of_texts_equal_those_of_rows(spark):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 3 + i % 9))) for i in range(60)] + [(60, ""), (61, None)]
    index = bm25.build(spark.createDataFrame(rows, "id long, text string"))
    asked = spark.createDataFrame([(1, "w1 w2 w7"), (2, "absent w3 w4"), (3, "the")], "qid int, query string")
    for limit in (40, 1 << 20):
        found = bm25._frequencies(index, spark.createDataFrame([("w1",), ("w9",), ("absent",)], "term string"), limit)
        assert {tuple(r) for r in found.collect()} == {(r["term"], r["df"]) for r in bm25.term_stats(index).where("term IN ('w1', 'w9')").collect()}
    joined = bm25.Index(index.rows, index.stats, keyed=False)
    take = lambda x: sorted(map(tuple, bm25.rare_terms(x, asked, 2).collect()))
    assert take(index) == take(joined)


def test_runs_rank_once(spark, monkeypatch):
    """The hits of plain BM25 are those that the heuristic starts from."""
    made, top_k = [], bm25.top_k
    monkeypatch.setattr(bm25, "top_k", lambda *a, **k: made.append(1) or top_k(*a, **k))
    Q._all_runs(spark, DIR)
    assert len(made) == 1


def test_links_of_some_documents(spark, tmp_path):
    """Links from some documents are those of the whole table whose first is one of them, made without the others' links."""
    rows = [(i, f"text {i % 5}\nline") for i in range(20)] + [(20, None), (21, None), (22, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    some = D.picked(spark, str(tmp_path), spark.createDataFrame([(i,) for i in (0, 3, 7, 20, 22)], "doc_id long"))
    found = {tuple(r) for r in D.links(spark, str(tmp_path), some).collect()}
    assert found == {tuple(r) for r in D.links(spark, str(tmp_path)).where("first IN (0, 3, 7, 20, 22)").collect()} and len(found) == 6


def test_spread_table_is_not_copied(spark, tmp_path):
    """A table that all cores can read at once is read where it is."""
    for name, parts in (("many", 8), ("one", 1)):
        spark.range(800).selectExpr("id AS doc_id", "'t' AS text").repartition(parts).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert all(f"{tmp_path}" in f for f in D.documents(spark, f"{tmp_path}/{name}").inputFiles()) == (parts == 8)
