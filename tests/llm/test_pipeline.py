"""The pipeline's stages against brute force on a small corpus."""

import corpus_pipeline as C
from ridgeline.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.select(C.COLUMNS).schema)
        assert docs.columns == C.COLUMNS, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "near_duplicates":
            sets = {d: decontaminate.shingles(t) for d, t in after.items()}
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b]:
                        assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
        elif name == "decontamination":
            for t in after.values():
                for item in map(decontaminate.shingles, bench):
                    assert len(item & decontaminate.shingles(t)) < 0.8 * len(item)
        before = after
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(before)
    for s in {r["sequence_id"] for r in packed}:
        assert sum(r["length"] for r in packed if r["sequence_id"] == s) <= 2048


ROWS = "doc_id long, text string, lang string, source string, n_chars long, toxic int"


def kept(stage, spark, rows):
    docs = spark.createDataFrame([(i, t, "en", None, 1, 7) for i, t in rows], ROWS)
    found = stage(spark, docs, SF)
    assert found.columns == C.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 20)
    clean = "one plain text about nothing that anyone would test"
    rows = [(1, f"before {item} after"), (1, clean), (None, f"and {item}"), (None, clean), (2, None), (2, ""), (3, "short")]
    assert kept(C.decontaminated, spark, rows) == sorted([(1, clean), (None, clean), (2, None), (2, ""), (3, "short")], key=str)
    copies = [(5, clean), (4, clean), (4, clean), (None, clean), (4, "another text that is like no other one here"), (None, "a third text of a row without an id at all"), (6, None), (6, None)]
    assert kept(C.near_duplicates, spark, copies) == sorted([(4, clean), (4, copies[4][1]), (None, copies[5][1]), (6, None), (6, None)], key=str)


def test_rows_without_ids_alone(spark):
    text = "a text of more than five words that comes twice"
    assert kept(C.near_duplicates, spark, [(None, text), (None, text)]) == [(None, text)]


def test_nothing_passes_all_stages(spark):
    docs = spark.createDataFrame([], ROWS)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
