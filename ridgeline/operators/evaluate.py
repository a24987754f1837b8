"""Retrieval metrics for all queries and runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as T


def ideal(n: Column) -> Column:
    """Discounted gain of n hits in the first n places."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))


def metrics(run: DataFrame, gold: DataFrame, k: int = 10, same_section: bool = False) -> DataFrame:
    """(qid, recall_5, recall_10, mrr, ndcg, noise, retrieved) of every query with gold; a query without hits has zeros.

    run: (qid, id, rank); gold: (qid, id). Sections stand for chunks with ``same_section``. Every hit earns gain, repeated ones as well,
    so nDCG by section can pass 1.
    """
    unit = T.section_key(F.col("id").cast("string")) if same_section else F.col("id").cast("string")
    g = gold.select("qid", unit.alias("unit")).distinct()
    sizes = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    rows = run.select("qid", unit.alias("unit"), "rank").join(g.withColumn("hit", F.lit(True)), ["qid", "unit"], "left")
    hit = F.col("hit")
    per = rows.groupBy("qid").agg(
        F.count_distinct(F.when(hit & (F.col("rank") <= 5), F.col("unit"))).alias("h5"),
        F.count_distinct(F.when(hit & (F.col("rank") <= 10), F.col("unit"))).alias("h10"),
        F.count_distinct(F.when(hit & (F.col("rank") <= k), F.col("unit"))).alias("hk"),
        F.count(F.when(F.col("rank") <= k, 1)).alias("top"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.count("*").alias("retrieved"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(per, "qid", "left").select(
        "qid",
        z(F.col("h5") / F.col("n_gold")).alias("recall_5"),
        z(F.col("h10") / F.col("n_gold")).alias("recall_10"),
        z(1 / F.col("first")).alias("mrr"),
        z(F.col("dcg") / ideal(F.least(F.col("n_gold"), F.lit(k)).cast("int"))).alias("ndcg"),
        z(F.when(F.col("top") > 0, (F.col("top") - F.col("hk")) / F.col("top"))).alias("noise"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
    )


def macro(per_query: DataFrame, places: int = 6) -> DataFrame:
    """One row: means over queries."""
    names = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), places).alias(c) for c in names])


def window_metrics(windows: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall_5, recall_10, mrr, ndcg, noise): a window is relevant if it holds a gold id; ideal gain by number of gold ids.

    windows: (qid, rank, members).
    """
    g = gold.groupBy("qid").agg(F.collect_set("id").alias("gold"))
    rows = g.join(windows, "qid", "left").withColumn("hit", F.coalesce(F.arrays_overlap("members", "gold"), F.lit(False)))

    def union(n: int) -> Column:
        ids = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= n, F.col("members")))))
        return F.size(F.array_intersect(ids, F.first("gold"))) / F.first(F.size("gold"))

    hit = F.col("hit")
    return rows.groupBy("qid").agg(
        union(5).alias("recall_5"),
        union(10).alias("recall_10"),
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0))) / ideal(F.least(F.first(F.size("gold")), F.lit(k))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.avg(F.when(F.col("rank") <= k, F.when(hit, 0.0).otherwise(1.0))), F.lit(0.0)).alias("noise"),
    )


def novelty(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall_5, recall_10, mrr, ndcg, noise, retrieved): only an item that brings a new unit earns gain; places past k don't count for mrr.

    run: (qid, rank, units): the gold units that an item matches; gold: (qid, unit).
    """
    sizes = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    firsts = run.select("qid", "rank", F.explode("units").alias("unit")).groupBy("qid", "unit").agg(F.min("rank").alias("rank"))
    gains = firsts.groupBy("qid", "rank").agg(F.count("*").alias("new"))
    per = gains.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("new"))).alias("h5"),
        F.sum(F.when(F.col("rank") <= 10, F.col("new"))).alias("h10"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.count(F.when(F.col("rank") <= k, 1)).alias("gainful"),
    )
    tops = run.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("retrieved"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(per, "qid", "left").join(tops, "qid", "left").select(
        "qid",
        z(F.col("h5") / F.col("n_gold")).alias("recall_5"),
        z(F.col("h10") / F.col("n_gold")).alias("recall_10"),
        z(1 / F.col("first")).alias("mrr"),
        z(F.col("dcg") / ideal(F.least(F.col("n_gold"), F.lit(k)).cast("int"))).alias("ndcg"),
        z((F.col("retrieved") - F.coalesce("gainful", F.lit(0))) / F.col("retrieved")).alias("noise"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
    )


def overlap(runs: DataFrame, k: int = 10) -> DataFrame:
    """(run_a, run_b, queries, overlap_mean, overlap_median, jaccard_mean, jaccard_median): shared ids of all pairs of runs, over queries both have.

    runs: (run, qid, id, rank).
    """
    tops = runs.where(F.col("rank") <= k).groupBy("run", "qid").agg(F.collect_set("id").alias("ids"))
    a, b = tops.select(F.col("run").alias("run_a"), "qid", F.col("ids").alias("a")), tops.select(F.col("run").alias("run_b"), "qid", F.col("ids").alias("b"))
    pairs = a.join(b, "qid").where("run_a < run_b")
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    pairs = pairs.withColumn("o", both / k).withColumn("j", F.when(either > 0, both / either).otherwise(0.0))
    return pairs.groupBy("run_a", "run_b").agg(F.count("*").alias("queries"), F.avg("o").alias("overlap_mean"), F.median("o").alias("overlap_median"), F.avg("j").alias("jaccard_mean"), F.median("j").alias("jaccard_median"))


#: How an item can answer: by its id, its section, its text, or its document.
CRITERIA = ["strict_chunk", "source_id", "same_section", "contains_evidence", "text_overlap_30", "same_doc"]


def _gold_units(criterion: str) -> Column:
    if criterion in ("strict_chunk", "source_id"):
        return F.array_distinct("gold_ids")
    if criterion == "same_section":
        return F.array_distinct(F.transform("gold_ids", T.section_key))
    if criterion == "same_doc":
        return F.array("doc_id")
    if criterion in ("contains_evidence", "text_overlap_30"):
        return F.array_distinct(F.filter(F.transform("evidence", T.normalize_evidence), lambda n: n != ""))
    raise ValueError(f"unknown criterion {criterion}")


def _matched_units(criterion: str) -> Column:
    none = F.array().cast("array<string>")
    if criterion in ("strict_chunk", "source_id"):
        return F.when(F.array_contains("units", F.col("id")), F.array("id")).otherwise(none)
    if criterion == "same_section":
        return F.when(F.array_contains("units", T.section_key(F.col("id"))), F.array(T.section_key(F.col("id")))).otherwise(none)
    if criterion == "same_doc":
        return F.when(T.doc_key(F.col("id")) == F.col("doc_id"), F.array("doc_id")).otherwise(none)
    if criterion == "contains_evidence":
        held = T.normalize_evidence(F.col("text"))
        return F.filter("units", lambda n: F.contains(held, n) | F.contains(n, held))
    answers = F.filter("evidence", lambda e: (T.normalize_evidence(e) != "") & (T.overlap_ratio(F.col("text"), e) >= 0.3))
    return F.array_distinct(F.transform(answers, T.normalize_evidence))


def diagnose(items: DataFrame, contexts: DataFrame, criterion: str, k: int = 10) -> DataFrame:
    """(qid, recall_5, recall_10, mrr, ndcg, noise, retrieved) by one of CRITERIA, a row for each context; zeros without gold units.

    Only units that an item is the first to match earn gain; places past k count for recall alone.
    items: (qid, id, text, rank), ids as strings; contexts: (qid, doc_id, gold_ids, evidence), the last two arrays.
    """
    own = contexts.withColumn("units", _gold_units(criterion))
    run = items.join(own, "qid").select("qid", "rank", _matched_units(criterion).alias("units"))
    found = novelty(run, own.select("qid", F.explode("units").alias("unit")), k)
    return contexts.select("qid").join(found, "qid", "left").fillna(0)


def false_negatives(items: DataFrame, contexts: DataFrame, k: int = 10) -> DataFrame:
    """(qid, strict, same_section, overlap): recall at ten of queries that strict matching calls a miss and a softer criterion does not."""
    def recall(criterion: str, name: str) -> DataFrame:
        return diagnose(items, contexts, criterion, k).select("qid", F.col("recall_10").alias(name))

    rows = recall("strict_chunk", "strict").join(recall("same_section", "same_section"), "qid").join(recall("text_overlap_30", "overlap"), "qid")
    return rows.where("strict = 0 AND (same_section > 0 OR overlap > 0)")


def restricted(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries that the gold table names, with gold ids or without."""
    return queries.join(gold.select("qid").distinct(), "qid", "left_semi")


def with_predictions(gold: DataFrame, run: DataFrame) -> DataFrame:
    """(qid, ids, missing): every gold query with its ranked ids, none and missing where the run has no such query."""
    per = run.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ids"))
    found = gold.select("qid").distinct().join(per, "qid", "left")
    return found.select("qid", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.col("ids").isNull().alias("missing"))


def gold_lists(gold: DataFrame) -> DataFrame:
    """(qid, ids, docs): distinct ids and documents of each query that has any, sorted. gold: (qid, id, doc_id)."""
    return gold.groupBy("qid").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.sort_array(F.collect_set("doc_id")).alias("docs"))


def changed_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, before, after, removed): rows by type in two versions of a table."""
    count = lambda df, n: df.groupBy("type").agg(F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), "type", "full").fillna(0, ["before", "after"])
    return both.withColumn("removed", F.col("before") - F.col("after"))


def truncation(texts: DataFrame, limit: int, sample: int = 2500) -> DataFrame:
    """(sampled, truncated, share): texts over ``limit`` tokens among the ``sample`` with the smallest hash of their id. texts: (id, text)."""
    some = texts.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample)
    over = F.count(F.when(T.count_tokens(F.col("text")) > limit, 1))
    return some.agg(F.count("*").alias("sampled"), over.alias("truncated")).withColumn("share", F.when(F.col("sampled") > 0, F.col("truncated") / F.col("sampled")).otherwise(0.0))
