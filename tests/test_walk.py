"""Walk, windows and metrics on the toy indexes of the fixtures."""

import math

import pytest

from ridgeline.config import Drill, Expand, Score
from ridgeline.operators import evaluate, judge, walk, windows
from ridgeline.operators import python_ops as P

E0, E1 = [1.0, 0.0], [0.0, 1.0]
SECTION = "section_id string, parent_id string, child_pos int, level int, local_text string, e_local array<double>, e_subtree array<double>"


def indexed(spark, rows):
    return spark.createDataFrame(rows, SECTION), spark.createDataFrame([(1, E0)], "qid int, qvec array<double>")


def seeds(spark, rows, **kw):
    return sorted(r["section_id"] for r in walk.drill(*indexed(spark, rows), Drill(**kw)).collect())


def test_drill_goes_as_deep_as_the_tree(spark):
    rows = [(f"s{k}", f"s{k - 1}" if k > 1 else None, 0, k, "", E1, E0) for k in range(1, 13)]
    assert seeds(spark, [*rows, ("deep", "s12", 0, 13, "text", E0, E0)]) == ["deep"]


def test_drill_takes_the_section_itself(spark):
    assert seeds(spark, [("A", None, 0, 1, "a", E0, E0), ("B", None, 1, 1, "b", E1, E1)]) == ["A"]


@pytest.mark.parametrize("mode", ["absolute", "percentile", "rank"])
def test_drill_descends_without_local_text(spark, mode):
    assert seeds(spark, [("P", None, 0, 1, "", E1, E0), ("C", "P", 0, 2, "c", E0, E0)], threshold_mode=mode) == ["C"]


def test_roots_by_subtree(spark):
    rows = [("X", None, 0, 1, "x", E1, E1), ("Y", None, 1, 1, "y", E0, E0), ("Z", None, 2, 2, "z", E0, E0)]
    assert [r["section_id"] for r in walk.roots(*indexed(spark, rows)).orderBy("rank").collect()] == ["Y", "X"]


@pytest.fixture(scope="module")
def chain(spark):
    rows = [("s", "a", "contains", 0), ("a", "b", "contains", 1), ("b", "c", "contains", 2), ("s", "x", "see_also", 3)]
    return spark.createDataFrame([(1, "s", 1)], "qid int, node string, rank int"), spark.createDataFrame(rows, "src string, dst string, rel string, edge_pos int")


def test_expand_by_depth(chain):
    assert {r["node"]: r["dist"] for r in walk.expand(*chain, Expand(max_depth=2)).collect()} == {"s": 0, "a": 1, "b": 2, "x": 1}


def test_expand_by_relation(chain):
    found = walk.expand(*chain, Expand(max_depth=10, allowed_relations=("contains",)))
    assert {r["node"] for r in found.collect()} == {"s", "a", "b", "c"}


def test_expand_with_a_limit(chain):
    nodes, edges = walk.expand_capped(*chain, Expand(max_depth=4, max_nodes=2))
    assert sorted(r["node"] for r in nodes.collect()) == ["a", "s"]
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("s", "a")]


def test_limited_expansion_equals_a_loop(spark):
    import random

    rng = random.Random(4)
    for case in range(3):
        edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "r", i) for i in range(30)]
        limit = rng.randrange(2, 9)
        seen, frontier, dist = ["n0"], ["n0"], {"n0": 0}
        for depth in (1, 2, 3):
            after = []
            for node in frontier:
                for src, dst, _, _ in edges:
                    if src == node and dst not in dist and len(dist) < limit:
                        dist[dst] = depth
                        after.append(dst)
            frontier = after
        df = spark.createDataFrame(edges, "src string, dst string, rel string, edge_pos int")
        nodes, _ = walk.expand_capped(spark.createDataFrame([(1, "n0", 1)], "qid int, node string, rank int"), df, Expand(max_depth=3, max_nodes=limit))
        assert {r["node"]: r["dist"] for r in nodes.collect()} == dist


def test_node_scores(spark):
    nodes = spark.createDataFrame([("n_chunk", "S", "chunk", E0), ("n_caption", "S", "caption", E1)], "node_id string, section_id string, node_type string, embedding array<double>")
    q = spark.createDataFrame([(1, E0)], "qid int, qvec array<double>")
    levels = spark.createDataFrame([("S", 2)], "section_id string, level int")
    dist = spark.createDataFrame([(1, "n_chunk", 1), (1, "ghost", 1)], "qid int, node string, dist int")
    full = walk.node_scores(nodes, q, levels, dist, Score(level_bonus={2: 0.2})).collect()
    assert [r["node_id"] for r in full] == ["n_chunk"] and math.isclose(full[0]["score"], 1 + 0.3 * 0.6 + 0.15 * 0.2 - 0.2)
    plain = {r["node_id"]: r["score"] for r in walk.node_scores(nodes, q, levels, None, Score(mode="text_only")).collect()}
    assert plain == {"n_chunk": 1.0, "n_caption": 0.0}


@pytest.mark.parametrize("at,span", [(3, (0, 5)), (5, (0, 7)), (6, (4, 8)), (9, (7, 9))])
def test_window_span(spark, at, span):
    nodes = spark.createDataFrame([(f"x.{i}", "S", "chunk", f"t{i}", i) for i in range(10)], "node_id string, section_id string, node_type string, text string, pos int")
    ranked = spark.createDataFrame([(1, f"x.{at}", 1, 1.0)], "qid int, node_id string, rank int, score double")
    row = windows.spans(ranked, nodes).first()
    assert (row["lo"], row["hi"]) == span


def test_windows_merge(spark):
    df = spark.createDataFrame([(1, "S", "a", 1, 1.0, 0, 0, 3), (1, "S", "b", 2, 0.9, 4, 4, 6), (1, "S", "c", 3, 0.8, 9, 9, 10)], "qid int, section_id string, node_id string, rank int, score double, at int, lo int, hi int")
    assert sorted((r["lo"], r["hi"]) for r in windows.merge(df).collect()) == [(0, 6), (9, 10)]


def test_flatten(spark):
    df = spark.createDataFrame([(1, 1, ["b"], ["a", "b"]), (1, 2, ["c"], ["b", "c"])], "qid int, rank int, anchors array<string>, members array<string>")
    ids = lambda order: [r["node_id"] for r in windows.flatten(df, order).orderBy("rank").collect()]
    assert ids("doc") == ["a", "b", "c"] and ids("anchors_first") == ["b", "c", "a"]


def test_metrics(spark):
    run = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(["x", "g1", "y", "g2"])], "qid int, id string, rank int")
    gold = spark.createDataFrame([(1, g) for g in ("g1", "g2", "g3")], "qid int, id string")
    m = evaluate.metrics(run, gold).first()
    assert math.isclose(m["recall_5"], 2 / 3) and m["mrr"] == 0.5 and m["noise"] == 0.5
    assert round(m["ndcg"], 4) == 0.4982


def test_section_metrics_can_pass_one(spark):
    run = spark.createDataFrame([(1, "D.0.0", 1), (1, "D.0.1", 2)], "qid int, id string, rank int")
    m = evaluate.metrics(run, spark.createDataFrame([(1, "D.0.5")], "qid int, id string"), same_section=True).first()
    assert m["recall_5"] == 1 and round(m["ndcg"], 4) == 1.6309 and m["noise"] == 0.5


def test_budget_skips_what_does_not_fit(spark):
    sizes = [900, 1500, 1000, 101, 100]
    items = spark.createDataFrame([("m", 1, str(i), i, "w " * n) for i, n in enumerate(sizes, 1)], "method string, qid int, id string, rank int, text string")
    assert [r["id"] for r in judge.pack(items, 2000).orderBy("rank").collect()] == ["1", "3", "5"]


def test_clean_cap_stops_at_the_first():
    from ridgeline.config import CleanCap

    text, tokens, kept, cut = P.clean_and_cap(["w " * n for n in (900, 1500, 1000)], CleanCap(token_budget=2000))
    assert (kept, cut) == (1, True) and tokens == 900


def test_votes(spark):
    df = spark.createDataFrame([(4, 1, 1), (3, 3, 0), (0, 4, 2)], "first int, second int, equal int")
    assert [r["outcome"] for r in judge.outcomes(df).collect()] == ["first", "tie", "second"]


def test_first_object():
    assert P.first_object('x ```json\n{"a": {"b": "}"}}\n```') == '{"a": {"b": "}"}}'
    assert P.first_object("none {broken") is None


def test_windows_of_long_text(spark):
    from pyspark.sql import functions as F

    from ridgeline.functions import text as T

    texts = ["word " * 1000, "", "short", None, "x" * 3000, "a b\n\n c"]
    found = [r["w"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.chunk_windows(F.col("t")).alias("w")).collect()]
    assert all(len(p) <= 1200 for p in found[0]) and found[1:4] == [[], ["short"], []] and found[5] == ["a b c"]
    assert [len(p) for p in found[4]] == [1200, 1200, 1000] and len(found[0]) == 5 and found[0][0].endswith("word")
