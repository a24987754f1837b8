"""Text functions against the expected values of the fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.functions import vectors as V


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for i, v in enumerate(values)))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("виджетами", "виджет"), ("чтобы", "чтоб"), ("event", "event"), ("дом", "дом")])
def test_stem(spark, word, stem):
    assert one(spark, T.tokenize, word) == [stem]


def test_query_terms_leave_stop_words_out(spark):
    assert one(spark, T.query_terms, "The index of the Index a b1") == ["index", "b1"]


@pytest.mark.parametrize("text,want", [(" a\t\tb \r\n  c ", "a b \nc"), ("", ""), (None, "")])
def test_normalize_ws(spark, text, want):
    assert one(spark, T.normalize_ws, text) == want


@pytest.mark.parametrize("text,want", [("12 Hello world", "Hello world"), ("12 345", "12 345")])
def test_page_number(spark, text, want):
    assert one(spark, T.strip_page_number, text) == want


@pytest.mark.parametrize("text,want", [("abc123", 0.5), ("   ", 0.0)])
def test_alpha_ratio(spark, text, want):
    assert one(spark, T.alpha_ratio, text) == want


@pytest.mark.parametrize("text,want", [(None, True), (" ", True), ("12", True), (".", True), ("Plain prose is kept here.", False)])
def test_noise(spark, text, want):
    assert one(spark, T.is_noise, text) is want


@pytest.mark.parametrize("name,want", [("stable baseline/1", "stable_baseline_1"), ("...", "run")])
def test_run_name(spark, name, want):
    assert one(spark, T.run_name, name) == want


@pytest.mark.parametrize("chunk,section", [("D_abstract", "D.abstract"), ("D.1.2", "D.1"), ("zzz", "zzz")])
def test_section_key(spark, chunk, section):
    assert one(spark, T.section_key, chunk) == section


def test_hygiene(spark):
    assert one(spark, T.is_caption, "Figure 3 - flow")
    assert one(spark, T.is_bullet_list, "- a\n- b\n- c")
    assert one(spark, T.is_table_header, "Name Type Size Owner Date")
    assert one(spark, T.is_heading, "Settings of the editor")
    assert not one(spark, T.is_heading, "It ends.")
    assert one(spark, T.is_incomplete, "as shown (см.")


def test_chunk_order(spark):
    df = spark.createDataFrame([("x.1.10",), ("x.1.2",), ("abc",)], "id string")
    assert [r["id"] for r in df.orderBy(T.chunk_order(F.col("id"))).collect()] == ["x.1.2", "x.1.10", "abc"]


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], None, -1), ([1.0, 0.0], [0.0, 0.0], -1), ([1.0, 0.0], [5.0, 0.0], 1)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert math.isclose(df.select(V.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"], want)


def test_hashed_vectors_skip_blank_texts(spark):
    rows = V.hashed_tf(spark.createDataFrame([("a b a",), ("  ",), (None,)], "t string"), "t", "v").collect()
    assert sum(rows[0]["v"]) == 3 and rows[1]["v"] is None and rows[2]["v"] is None


def test_labels(spark):
    df = spark.createDataFrame([("A", "AB"), ("A", "BA"), ("equal", "AB"), ("x", "AB")], "l string, p string")
    assert [r["x"] for r in df.select(T.normalize_label(F.col("l"), F.col("p")).alias("x")).collect()] == ["first", "second", "equal", None]
