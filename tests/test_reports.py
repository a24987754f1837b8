"""Answers of judges, prompts and payloads; readers of prediction and payload folders."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.operators import judge, reports
from ridgeline.operators import python_ops as P
from ridgeline.sources import readers

GOOD = [
    '{"relevance":"A","cleanliness":"B","sufficiency":"equal"}',
    '```json\n{"relevance": "A", "cleanliness": "B", "sufficiency": "equal"}\n```',
    '```\n{"relevance":"A","cleanliness":"B","sufficiency":"equal"}\n```',
    'Here it is:\n\n{"relevance":"A","cleanliness":"B","sufficiency":"equal"}',
    '{"relevance":"A","cleanliness":"B","sufficiency":"equal"}\n\nAnything else?',
    '\n  {\n    "relevance": "A",\n    "cleanliness": "B",\n    "sufficiency": "equal"\n  }\n',
    '\ufeff{"relevance":"A","cleanliness":"B","sufficiency":"equal","_note":"a } \\" brace"}',
]
BAD = [
    ('{"relevance":"A","cleanliness":"B"}', "missing axis: sufficiency"),
    ('{"relevance":"yes","cleanliness":"B","sufficiency":"equal"}', "invalid value for relevance: 'yes'"),
    ("No comparison is possible.", "no JSON object found"),
    ('{bad {"relevance":"A"}}', "JSON decode error"),
    ('{"relevance": "A', "no JSON object found"),
]


@pytest.mark.parametrize("text", GOOD)
def test_answers_in_any_wrapping(text):
    assert P.judge_labels(text, judge.AXES) == ({"relevance": "A", "cleanliness": "B", "sufficiency": "equal"}, None)


@pytest.mark.parametrize("text,error", BAD)
def test_answers_with_an_error(text, error):
    labels, found = P.judge_labels(text, judge.AXES)
    assert labels is None and found.startswith(error)


def test_answers_as_a_column(spark):
    df = spark.createDataFrame([(GOOD[1],), (BAD[2][0],), (None,)], "t string")
    rows = df.select(P.judge_answers(F.col("t"), judge.AXES).alias("a")).select("a.*").collect()
    assert rows[0]["labels"]["cleanliness"] == "B" and rows[1]["error"] == rows[2]["error"] == "no JSON object found"


def answer(**other):
    scores = dict.fromkeys("ABCDE", 3)
    return {"relevance": scores, "usefulness_for_logic": scores, "noise": scores, "overall": scores, "winner": "A", "ranking": list("ABCDE"), "failure_letters": [], "confidence": "low", "rationales": {}} | other


@pytest.mark.parametrize(
    "mode,found,error",
    [
        ("fiveway", answer(), None),
        ("fiveway", answer(winner="", failure_letters=["E"]), None),
        ("fiveway", answer(winner="F"), "'winner'"),
        ("fiveway", answer(ranking=list("ABCDD")), "'ranking'"),
        ("fiveway", answer(noise=dict.fromkeys("ABCDE", 6)), "'noise'"),
        ("fiveway", answer(noise=dict.fromkeys("ABCD", 1)), "'noise'"),
        ("fiveway", answer(failure_letters=["X"]), "'failure_letters'"),
        ("fiveway", answer(more=1), "Unexpected extra keys: more"),
        ("fiveway", {"winner": "A"}, "Missing keys"),
        ("fiveway_reasoning", answer(), "Missing keys: sufficiency_for_reasoning,coherence"),
        ("pairwise", {"decision": "", "reason": "same"}, None),
        ("pairwise", {"decision": "C", "reason": "r"}, "'decision'"),
        ("pairwise", {"decision": "A", "reason": " "}, "'reason'"),
    ],
)
def test_what_is_wrong_with_an_answer(spark, mode, found, error):
    got = spark.createDataFrame([(json.dumps(found), mode)], "r string, m string").select(reports.problem(F.col("r"), F.col("m"))).first()[0]
    assert got is None if error is None else got.startswith(error)


def test_runs_from_records(spark):
    five, pair = dict(zip("ABCDE", "vwxyz")), {"A": "v", "B": "w"}
    payloads = spark.createDataFrame([("Q1", "?", five), ("Q2", "!", pair)], "qid string, query string, mapping map<string,string>")
    records = [
        ("Q1", None, "m", "OK", json.dumps({"parsed_json": answer(coherence=dict.fromkeys("ABCDE", 1))}), None, "a"),
        ("Q1", 2, "m", "OK", json.dumps(answer()), None, "b"),
        ("Q1", 3, "m", "ERROR", json.dumps({"status": "ERROR"}), None, "c"),
        ("Q2", None, "m", "ERROR", "{}", '{"decision": "Draw", "reason": "alike"}', "d"),
        ("Q2", 1, "m", None, json.dumps({"judge_response": {"decision": "B", "reason": "r"}}), None, "e"),
        ("Q2", 2, "m", "OK", "{}", None, "f"),
    ]
    runs = reports.runs(spark.createDataFrame(records, "qid string, replica int, model string, status string, raw string, raw_object string, file string"), payloads)
    rows = {r["file"]: r for r in reports.wide(runs).collect()}
    assert [rows[f]["parse_ok"] for f in "abcdef"] == [True, True, False, True, True, False]
    assert rows["a"]["winner_method"] == "v" and rows["a"]["ranking_methods"] == "v,w,x,y,z" and rows["a"]["coherence_C"] == 1 and rows["b"]["overall_E"] == 3
    assert rows["d"]["parse_error"] == "SALVAGED_FROM_ERROR" and rows["d"]["decision_letter"] == "" and rows["e"]["decision_method"] == "w"
    assert {r["file"] for r in runs.where(reports.is_tie(runs)).collect()} == {"d"}
    assert reports.long(runs).count() == 15
    best = {r["letter"]: r for r in reports.consensus_rows(reports.long(runs)).collect()}
    assert best["A"]["n_judges"] == 2 and best["A"]["coherence"] == 1 and not best["A"]["is_failure"]


def test_prompts(spark):
    rows = spark.createDataFrame([("q1", " ask ", {"A": "a", "B": "b"}), ("q2", "x", {"A": "a", "C": "c"}), ("q3", "x", None)], "qid string, query string, contexts map<string,string>")
    found = {r["qid"]: r for r in reports.prompts(rows, "Judge.").collect()}
    assert found["q1"]["mode"] == "pairwise" and found["q1"]["messages"][1]["content"] == "QUERY:\nask\n\nCANDIDATE A:\na\n\nCANDIDATE B:\nb"
    assert found["q2"]["mode"] == found["q3"]["mode"] == "multiway"
    shapes = ['[{"role":"user","content":"x"}]', '{"messages":[{"role":"system","content":"x"}]}', '{"input":[{"role":"developer","content":"x"}]}']
    df = spark.createDataFrame([(s,) for s in shapes], "p string").select(reports.normalized_messages(F.col("p")).alias("m"))
    assert [r["m"][0]["role"] for r in df.collect()] == ["user", "system", "developer"]
    for bad in ('{"other": []}', '[{"role":"robot","content":"x"}]', '[{"role":"user"}]'):
        with pytest.raises(Exception, match="a prompt is|a message has"):
            spark.createDataFrame([(bad,)], "p string").select(reports.normalized_messages(F.col("p"))).collect()


def test_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    files = {
        "Q10.json": {"id": "Q10", "query": "ten", "private_mapping": {"A": "m", "Z": "n"}, "output": ["one", "two"]},
        "Q2.json": {"id": "Q2", "output_items": [{"chunk_id": "c", "text": "t", "score": 0.5}, {"chunk_id": " ", "text": "u"}, {"text": " "}]},
        "deep/Q2_3.json": {"id": "Q2"},
        "deep/other.json": {"id": "x"},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    found = {(r["qid"], r["replica"]) for r in readers.json_files(spark, str(tmp_path)).collect()}
    assert found == {("Q10", None), ("Q2", None), ("Q2", 3)}
    assert [r["qid"] for r in readers.expected_qids(spark, str(tmp_path)).orderBy("place").collect()] == ["Q2", "Q10"]
    assert {r["qid"]: r["mapping"] for r in readers.payloads(spark, str(tmp_path)).collect()} == {"Q10": {"A": "m"}, "Q2": {}}
    assert [tuple(r) for r in readers.prediction_items(spark, str(tmp_path)).collect()] == [("Q2", "c", "t", 0.5, 1)]
    assert {r["qid"]: r["texts"] for r in readers.run_texts(spark, str(tmp_path)).collect()} == {"Q10": ["one", "two"]}
    assert {r["qid"]: r["chunks"] for r in readers.method_results(spark, str(tmp_path)).collect()} == {"Q10": ["one", "two"], "Q2": ["t", "u"]}
    (tmp_path / "Q7.json").write_text(json.dumps({"id": "Q8", "output": []}))
    with pytest.raises(Exception, match="id differs"):
        readers.method_results(spark, str(tmp_path)).collect()


def test_small_functions(spark):
    df = spark.createDataFrame([("D.1.2", "Q5R012", " 7 ", "a_vs_b"), ("D_abstract", "Q3", "7.5", "ab"), ("x.y", "none", "", None)], "c string, q string, n string, v string")
    rows = df.select(T.doc_of_chunk(F.col("c")).alias("d"), T.qid_order(F.col("q"))["number"].alias("q"), T.safe_int(F.col("n")).alias("i"), T.safe_double(F.col("n")).alias("f"), T.comparison_parts(F.col("v")).alias("v"), T.section_order(F.concat(F.lit("sch"), "n")).alias("s")).collect()
    assert [r["d"] for r in rows] == ["D", "D", "x"] and [r["q"] for r in rows] == [12, 3, 10**9]
    assert [r["i"] for r in rows] == [7, None, None] and [r["f"] for r in rows] == [7, 7.5, None]
    assert rows[0]["v"]["second"] == "b" and rows[1]["v"] is None
    names = spark.createDataFrame([("D.abstract",), ("D.3",), ("D.x",), ("doc-ch12",)], "s string").select(T.doc_of_section(F.col("s")).alias("d"), T.section_order(F.col("s")).alias("o")).collect()
    assert [r["d"] for r in names] == ["D", "D", "D.x", "doc-ch12"] and [r["o"] for r in names] == [999_999] * 3 + [12]


def test_no_context():
    assert P.clean_and_cap([" ", "tiny"]) == (P.NO_CONTEXT, 6, 0, False)


def test_article_rules():
    xml = "<article><front><article-title>T</article-title><abstract>bare <i>text</i>s</abstract></front><body><p>free</p><sec><sec><title>Y</title><p>two</p></sec><p>one<b>b</b></p></sec><sec><title>Z</title><p>three</p></sec></body></article>"
    found = P.article(xml)
    assert found["paragraphs"] == [("abstract", ["Abstract"], 0, "bare text s"), ("body", ["Untitled Section"], 0, "one b"), ("body", ["Untitled Section", "Y"], 1, "two"), ("body", ["Z"], 2, "three")]
    assert (found["status"], found["n_sec"], found["has_body"]) == ("valid", 3, True)
    assert [P.article(x)["status"] for x in ("", "<other/>", "<article", "<article/>")] == ["empty", "missing_article_tag", "parse_error", "missing_body"]
