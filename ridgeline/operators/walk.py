"""Structured walk: seeds by drill-down, bounded expansion, scoring, section candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Drill, Expand, Score
from ridgeline.functions import text as T
from ridgeline.functions import vectors as V
from ridgeline.operators import dense, ranking
from ridgeline.staging import stage

#: Hops of a node that the walk did not reach, and the score of a node that does not exist.
FAR, MISSING = 999, -999.0


def roots(sections: DataFrame, queries: DataFrame, config: Drill = Drill()) -> DataFrame:
    """(qid, section_id, subtree, rank): the best level-1 sections, the only ones that every query is scored against."""
    level = sections.where("level = 1").select(F.col("section_id").alias("id"), F.col("e_subtree").alias("embedding"))
    return dense.top_k(level, queries, config.top_r).select("qid", F.col("id").alias("section_id"), F.col("score").alias("subtree"), "rank")


def _both(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("section_id").alias("id"), F.explode(F.array("e_local", "e_subtree")).alias("embedding"))


def drill(sections: DataFrame, queries: DataFrame, config: Drill = Drill(), scope: DataFrame | None = None) -> DataFrame:
    """(qid, section_id, local): seeds, from the roots down to where nothing is left to open, however deep.

    A section with text is a seed if its own similarity is high enough and not far below its best child's; else its best
    children are opened. A tree level is one join from the open sections to their children, which alone are
    scored; each level is staged. The percentile mode needs the extremes of all scores: one pass of block products.
    sections: (section_id, parent_id, child_pos, level, local_text, e_local, e_subtree); queries: (qid, qvec);
    scope: (qid, section_id, level, local, subtree) if each query has sections of its own, whose trees are in it whole.
    """
    rows = sections.select("section_id", "parent_id", "child_pos", (T.strip(F.col("local_text")) != "").alias("has_text"), "e_local", "e_subtree")
    limits = None
    if config.threshold_mode == "percentile":
        limits = stage(dense.extremes(_both(sections), queries) if scope is None else _extremes(scope), "limits")
    first = roots(sections, queries, config) if scope is None else scoped_roots(scope, config)

    def scored(pairs: DataFrame) -> DataFrame:
        local, subtree = V.cosine(F.col("qvec"), F.col("e_local")), V.cosine(F.col("qvec"), F.col("e_subtree"))
        found = pairs.join(queries.select("qid", "qvec"), "qid").withColumn("local", F.round(local, 6)).withColumn("subtree", F.round(subtree, 6)).drop("e_local", "e_subtree", "qvec")
        return found.join(limits, "qid", "left") if limits is not None else found

    def scaled(x: Column) -> Column:
        return x if limits is None else F.when(F.col("qmax") > F.col("qmin"), (x - F.col("qmin")) / (F.col("qmax") - F.col("qmin"))).otherwise(x)

    siblings = Window.partitionBy("qid", "parent_id")
    if config.threshold_mode == "rank":
        taken = F.col("pos") <= F.greatest(F.lit(1), F.ceil(F.col("n") * config.rank_top_p))
    else:
        taken = (F.col("pos") <= config.top_k) & (scaled(F.col("best")) >= config.tau_child)
    open_ = stage(scored(first.select("qid", "section_id").join(rows, "section_id")), "open")
    reached, seeds = open_.select("qid", "section_id"), None
    while True:
        children = scored(open_.select("qid", F.col("section_id").alias("parent_id")).join(rows, "parent_id"))
        children = children.withColumn("n", F.count("*").over(siblings)).withColumn("pos", F.row_number().over(siblings.orderBy(F.col("subtree").desc(), "child_pos"))).withColumn("best", F.max("subtree").over(siblings))
        children = stage(children, "children")
        best = children.groupBy("qid", F.col("parent_id").alias("section_id")).agg(F.max("subtree").alias("best_child"))
        seed = F.col("has_text") & (scaled(F.col("local")) >= config.tau_local) & (F.col("local") >= F.coalesce("best_child", F.lit(-1.0)) - config.margin)
        own = open_.join(best, ["qid", "section_id"], "left").where(seed).select("qid", "section_id", "local")
        seeds = own if seeds is None else seeds.unionByName(own)
        stops = own.select("qid", F.col("section_id").alias("parent_id"))
        below = children.where(taken).join(stops, ["qid", "parent_id"], "left_anti").join(reached, ["qid", "section_id"], "left_anti")
        open_ = stage(below.drop("n", "pos", "best"), "open")
        if open_.isEmpty():
            return seeds.distinct()
        reached = reached.unionByName(open_.select("qid", "section_id"))


def scoped(documents: DataFrame, sections: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, section_id, level, local, subtree) of the sections of each query's documents. documents: (qid, doc_id); sections with doc_id."""
    pairs = documents.select("qid", "doc_id").join(sections.select("section_id", "doc_id", "level", "e_local", "e_subtree"), "doc_id").join(queries.select("qid", "qvec"), "qid")
    local, subtree = V.cosine(F.col("qvec"), F.col("e_local")), V.cosine(F.col("qvec"), F.col("e_subtree"))
    return pairs.select("qid", "section_id", "level", F.round(local, 6).alias("local"), F.round(subtree, 6).alias("subtree"))


def scoped_roots(scope: DataFrame, config: Drill = Drill()) -> DataFrame:
    """(qid, section_id, subtree, rank): the best level-1 sections of each query's own."""
    return ranking.top_k(scope.where("level = 1").select("qid", "section_id", "subtree"), config.top_r, score="subtree", tie="section_id")


def _extremes(scope: DataFrame) -> DataFrame:
    known = scope.select("qid", F.explode(F.array("local", "subtree")).alias("v")).where("v > -1")
    return known.groupBy("qid").agg(F.min("v").alias("qmin"), F.max("v").alias("qmax"))


def ranked_seeds(seeds: DataFrame) -> DataFrame:
    """(qid, node, rank): seeds by similarity, then id."""
    order = Window.partitionBy("qid").orderBy(F.col("local").desc(), "section_id")
    return seeds.select("qid", F.col("section_id").alias("node"), F.row_number().over(order).alias("rank"))


def expand(seeds: DataFrame, edges: DataFrame, config: Expand = Expand()) -> DataFrame:
    """(qid, node, dist): nodes within ``max_depth`` hops, without a limit on their number; each level is staged and has new nodes only.

    seeds: (qid, node, rank); edges: (src, dst, rel, edge_pos).
    """
    edges = _allowed(edges, config).select("src", F.col("dst").alias("node"))
    found = frontier = stage(seeds.select("qid", "node").distinct().withColumn("dist", F.lit(0)), "frontier")
    for d in range(1, config.max_depth + 1):
        near = frontier.select("qid", F.col("node").alias("src")).join(edges, "src").select("qid", "node").distinct()
        frontier = stage(near.join(found.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("dist", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _allowed(edges: DataFrame, config: Expand) -> DataFrame:
    return edges.where(F.col("rel").isin(*config.allowed_relations)) if config.allowed_relations else edges


def expand_capped(seeds: DataFrame, edges: DataFrame, config: Expand = Expand(), allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (qid, node, dist, rank), traversed edges (qid, src, dst, rel, dist)) with at most ``max_nodes`` nodes a query.

    ``allowed``: (qid, node) if each query may only walk on nodes of its own.

    A level is one join: edges of the frontier in order of (frontier rank, edge place); each new node is known by the first
    edge that reaches it; the first that fit under the limit join. Edges count up to the one that found the last node.
    """
    edges = _allowed(edges, config)
    nodes = frontier = stage(seeds.select("qid", "node", F.lit(0).alias("dist"), F.col("rank").cast("long").alias("rank")), "frontier")
    traversed = None
    for d in range(1, config.max_depth + 1):
        have = nodes.groupBy("qid").agg(F.count("*").alias("have"), F.max("rank").alias("last")).where(F.col("have") < config.max_nodes)
        scan = frontier.select("qid", F.col("node").alias("src"), "rank").join(have, "qid").join(edges, "src")
        if allowed is not None:
            scan = scan.join(allowed.select("qid", F.col("node").alias("dst")), ["qid", "dst"], "left_semi")
        at = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "edge_pos", "dst"))
        known = nodes.select("qid", F.col("node").alias("dst"), F.lit(True).alias("known"))
        scan = scan.withColumn("at", at).join(known, ["qid", "dst"], "left")
        first = F.col("known").isNull() & (F.row_number().over(Window.partitionBy("qid", "dst").orderBy("at")) == 1)
        scan = scan.withColumn("first", first).withColumn("k", F.when(F.col("first"), F.sum(F.col("first").cast("long")).over(Window.partitionBy("qid").orderBy("at"))))
        room = config.max_nodes - F.col("have")
        # the edge that finds the last node that fits is the last one counted
        scan = scan.withColumn("cut", F.min(F.when(F.col("k") == room, F.col("at"))).over(Window.partitionBy("qid"))).where(F.col("cut").isNull() | (F.col("at") <= F.col("cut")))
        level = stage(scan.select("qid", "src", "dst", "rel", "k", "last"), "level")
        rows = level.select("qid", "src", "dst", "rel", F.lit(d).alias("dist"))
        traversed = rows if traversed is None else traversed.unionByName(rows)
        frontier = level.where("k IS NOT NULL").select("qid", F.col("dst").alias("node"), F.lit(d).alias("dist"), (F.col("last") + F.col("k")).alias("rank"))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    return nodes, traversed


def node_scores(nodes: DataFrame, queries: DataFrame, levels: DataFrame, distances: DataFrame | None, config: Score = Score()) -> DataFrame:
    """(qid, node_id, section_id, node_type, score).

    nodes: (node_id, section_id, node_type, embedding); levels: (section_id, level); distances: (qid, node, dist), of
    which only the nodes in it are scored, or None for all nodes.
    """
    if distances is None:
        found = dense.scores(nodes.select(F.col("node_id").alias("id"), "embedding"), queries).withColumnRenamed("id", "node_id")
        pairs = found.join(nodes.select("node_id", "section_id", "node_type"), "node_id").withColumn("dist", F.lit(FAR)).withColumnRenamed("score", "sim")
    else:
        pairs = distances.withColumnRenamed("node", "node_id").join(nodes, "node_id").join(queries.select("qid", "qvec"), "qid")
        # vectors end here: the join with levels would shuffle two of them for each pair
        pairs = pairs.select("qid", "node_id", "section_id", "node_type", "dist", V.cosine(F.col("qvec"), F.col("embedding")).alias("sim"))
    sim = F.col("sim")
    if config.mode == "text_only":
        return pairs.select("qid", "node_id", "section_id", "node_type", sim.alias("score"))

    def bonus(values: dict, key):
        pairs_ = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
        return F.coalesce(F.element_at(F.create_map(*pairs_), key), F.lit(0.0)) if pairs_ else F.lit(0.0)

    scored = pairs.join(levels.select("section_id", "level"), "section_id", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    total = config.w_text * sim + config.w_type * bonus(config.type_bonus, F.col("node_type")) + config.w_level * bonus({int(k): v for k, v in config.level_bonus.items()}, F.col("level")) - config.w_dist * F.col("dist")
    return scored.select("qid", "node_id", "section_id", "node_type", total.alias("score"))


def top_nodes(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def section_candidates(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, section_id, score, node_ids, title, text): best score, ranked nodes in order, all of the section's text."""
    own = ranked.groupBy("qid", "section_id").agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("node_ids"))
    texts = nodes.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return own.join(texts, "section_id").select("qid", "section_id", "score", "node_ids", F.split("text", "\n")[0].alias("title"), "text")


def ordered_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with ``rank``: by score, of equals by the number in the section's id."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), T.section_order(F.col("section_id")), "section_id")
    return candidates.withColumn("rank", F.row_number().over(order))


@dataclass(frozen=True)
class Walk:
    """What one walk of all queries gives: staged tables by step."""

    seeds: DataFrame  # (qid, node, rank)
    nodes: DataFrame  # (qid, node, dist, rank)
    edges: DataFrame  # (qid, src, dst, rel, dist): traversed, with both ends among the nodes
    ranked: DataFrame  # (qid, node_id, section_id, node_type, score, rank)


def run(sections: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, drill_: Drill = Drill(), expand_: Expand = Expand(), score: Score = Score(), top_k: int = 20, seeds: DataFrame | None = None, allowed: DataFrame | None = None) -> Walk:
    """The whole walk: drill-down finds seeds, bounded expansion goes on from them, what it reaches is scored and ranked.

    ``seeds`` and ``allowed``: for walks inside some documents of each query.
    """
    seeds = stage(ranked_seeds(drill(sections, queries, drill_)) if seeds is None else seeds, "seeds")
    reached, traversed = expand_capped(seeds, edges, expand_, allowed)
    ranked = stage(top_nodes(node_scores(nodes, queries, sections, reached, score), top_k), "ranked")
    return Walk(seeds, reached, graph_context(traversed, reached), ranked)


def diagnostics(walk: Walk) -> DataFrame:
    """(qid, seeds, nodes, edges, max_dist, ranked, score_min, score_max, score_mean, types, relations): one row a query with seeds.

    types and relations: ``name:count`` of the ranked nodes' types and of the traversed edges, by name.
    """
    def histogram(rows: DataFrame, name: str, out: str) -> DataFrame:
        counted = rows.groupBy("qid", name).agg(F.count("*").alias("n")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), "n"))).alias("h"))
        return counted.select("qid", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",").alias(out))

    found = walk.seeds.groupBy("qid").agg(F.count("*").alias("seeds"))
    found = found.join(walk.nodes.groupBy("qid").agg(F.count("*").alias("nodes"), F.max("dist").alias("max_dist")), "qid", "left")
    found = found.join(walk.edges.groupBy("qid").agg(F.count("*").alias("edges")), "qid", "left")
    stats = [F.count("*").alias("ranked"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean")]
    found = found.join(walk.ranked.groupBy("qid").agg(*stats), "qid", "left")
    found = found.join(histogram(walk.ranked, "node_type", "types"), "qid", "left").join(histogram(walk.edges, "rel", "relations"), "qid", "left")
    return found.fillna(0, ["nodes", "edges", "ranked", "max_dist"]).fillna("", ["types", "relations"])


def graph_context(traversed: DataFrame, visited: DataFrame) -> DataFrame:
    """Edges whose ends are both visited."""
    a = visited.select("qid", F.col("node").alias("src"))
    b = visited.select("qid", F.col("node").alias("dst"))
    return traversed.join(a, ["qid", "src"], "left_semi").join(b, ["qid", "dst"], "left_semi")
