"""Judging: budgeted contexts, blind pairs, votes, agreement, costs, scores of several methods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import text as T

AXES = ["relevance", "sufficiency", "cleanliness"]
VOTES_TO_WIN = 4
#: Stands for a pair that was not judged because both contexts are the same, and for votes without a winner.
SKIPPED, TIE = "__SKIPPED_IDENTICAL__", "__TIE_OR_EMPTY__"


def pack(items: DataFrame, budget: int = 2000) -> DataFrame:
    """(method, qid, id, rank, tokens): items in order of rank as long as they fit; one that doesn't is skipped, later ones may fit.

    items: (method, qid, id, rank, text). A fold over each query's ordered items.
    """
    rows = items.withColumn("tokens", T.count_tokens(F.col("text"))).where(T.strip(F.col("text")) != "")
    ordered = rows.groupBy("method", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("all"))
    kind = "struct<total:int,kept:array<struct<rank:int,id:string,tokens:int>>>"
    start = F.struct(F.lit(0).alias("total"), F.array().alias("kept")).cast(kind)

    def add(state: Column, x: Column) -> Column:
        item = F.struct(x["rank"].cast("int").alias("rank"), x["id"].cast("string").alias("id"), x["tokens"].alias("tokens"))
        more = F.struct((state["total"] + x["tokens"]).alias("total"), F.concat(state["kept"], F.array(item)).alias("kept"))
        return F.when(state["total"] + x["tokens"] <= budget, more).otherwise(state)

    kept = ordered.select("method", "qid", F.aggregate("all", start, add)["kept"].alias("kept"))
    return kept.select("method", "qid", F.posexplode("kept").alias("pos", "x")).select("method", "qid", F.col("x.id").alias("id"), (F.col("pos") + 1).alias("rank"), F.col("x.tokens").alias("tokens"))


def pack_summary(packed: DataFrame, items: DataFrame) -> DataFrame:
    """(method, queries, avg_items, avg_truncated, avg_tokens)."""
    given = items.groupBy("method", "qid").agg(F.count("*").alias("given"))
    per = packed.groupBy("method", "qid").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    rows = given.join(per, ["method", "qid"], "left").fillna(0, ["n", "tokens"])
    return rows.groupBy("method").agg(F.count("*").alias("queries"), F.avg("n").alias("avg_items"), F.avg(F.col("given") - F.col("n")).alias("avg_truncated"), F.avg("tokens").alias("avg_tokens"))


def token_stats(packed: DataFrame, budget: int = 2000) -> DataFrame:
    """(method, queries, mean, median, least, most, near_budget): tokens of contexts; share with 80 % of the budget or more."""
    per = packed.groupBy("method", "qid").agg(F.sum("tokens").alias("t"))
    return per.groupBy("method").agg(F.count("*").alias("queries"), F.avg("t").alias("mean"), F.median("t").alias("median"), F.min("t").alias("least"), F.max("t").alias("most"), F.avg(F.when(F.col("t") >= 0.8 * budget, 1.0).otherwise(0.0)).alias("near_budget"))


def contexts(items: DataFrame) -> DataFrame:
    """(method, qid, context): stripped texts that are not blank, in order, with a blank line between."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: T.strip(x["text"])), lambda t: t != "")
    return items.groupBy("method", "qid").agg(F.array_join(texts, "\n\n").alias("context"))


def pairs(contexts_: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(pair_id, comparison_id, qid, perm, method_a, method_b, context_a, context_b), both orders of each comparison and query.

    comparisons: (idx, first, second), a handful of rows. Pairs are numbered by comparison, query and order.
    """
    first = contexts_.select(F.col("method").alias("first"), "qid", F.col("context").alias("context_1"))
    second = contexts_.select(F.col("method").alias("second"), "qid", F.col("context").alias("context_2"))
    rows = F.broadcast(comparisons).join(first, "first").join(second, ["second", "qid"])
    rows = rows.withColumn("perm", F.explode(F.array(F.lit("AB"), F.lit("BA"))))
    ab = F.col("perm") == "AB"
    # numbers run over comparisons in order; within one they follow the queries, so no window spans all rows
    place = F.row_number().over(Window.partitionBy("idx").orderBy("qid", "perm"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("idx").agg(F.count("*").alias("n")).select("idx", before.alias("_before"))
    number = (F.col("_before") + place).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return rows.join(F.broadcast(starts), "idx").select(
        F.concat(F.lit("p"), padded, F.lit("_"), F.col("qid"), F.lit("_"), F.col("perm")).alias("pair_id"),
        F.concat("first", F.lit("_vs_"), "second").alias("comparison_id"),
        "qid",
        "perm",
        F.when(ab, F.col("first")).otherwise(F.col("second")).alias("method_a"),
        F.when(ab, F.col("second")).otherwise(F.col("first")).alias("method_b"),
        F.when(ab, F.col("context_1")).otherwise(F.col("context_2")).alias("context_a"),
        F.when(ab, F.col("context_2")).otherwise(F.col("context_1")).alias("context_b"),
    )


def latest(decisions: DataFrame) -> DataFrame:
    """The last row of each pair and judge in a log with ``seq``."""
    return decisions.groupBy("judge", "pair_id").agg(F.max_by(F.struct(*[c for c in decisions.columns if c not in ("judge", "pair_id")]), "seq").alias("_x")).select("judge", "pair_id", "_x.*")


def votes(pairs_: DataFrame, decisions: DataFrame) -> DataFrame:
    """(comparison_id, qid, axis, first, second, equal, n) over judges and orders. decisions: (judge, pair_id, status, labels map)."""
    rows = pairs_.select("pair_id", "comparison_id", "qid", "perm").join(decisions.where("status = 'ok'"), "pair_id").select("comparison_id", "qid", "perm", F.explode("labels").alias("axis", "label"))
    rows = rows.withColumn("vote", T.normalize_label(F.col("label"), F.col("perm"))).where(F.col("vote").isNotNull() & F.col("axis").isin(AXES))
    return rows.groupBy("comparison_id", "qid", "axis").agg(*[F.count(F.when(F.col("vote") == v, 1)).alias(v) for v in ("first", "second", "equal")], F.count("*").alias("n"))


def outcomes(counted: DataFrame) -> DataFrame:
    """Adds ``outcome``: a side with VOTES_TO_WIN votes wins, else it is a tie."""
    return counted.withColumn("outcome", F.when(F.col("first") >= VOTES_TO_WIN, "first").when(F.col("second") >= VOTES_TO_WIN, "second").otherwise("tie"))


def win_rates(decided: DataFrame) -> DataFrame:
    """(comparison_id, axis, win_a, tie, win_b, n_queries); axis overall: the mean of the axes."""
    share = lambda v: F.avg(F.when(F.col("outcome") == v, 1.0).otherwise(0.0))
    per = decided.groupBy("comparison_id", "axis").agg(share("first").alias("win_a"), share("tie").alias("tie"), share("second").alias("win_b"), F.count("*").alias("n_queries"))
    overall = per.groupBy("comparison_id").agg(F.avg("win_a").alias("win_a"), F.avg("tie").alias("tie"), F.avg("win_b").alias("win_b"), F.max("n_queries").alias("n_queries")).withColumn("axis", F.lit("overall"))
    return per.unionByName(overall)


def labels_long(decisions: DataFrame) -> DataFrame:
    """(judge, pair_id, axis, label) of decisions that are ok."""
    return decisions.where("status = 'ok'").select("judge", "pair_id", F.explode("labels").alias("axis", "label")).where(F.col("axis").isin(AXES) & F.col("label").isin("A", "B", "equal"))


def inter_judge(decisions: DataFrame, judges: int) -> DataFrame:
    """(axis, all_agree, total, rate): pairs that all judges labelled."""
    per = labels_long(decisions).groupBy("pair_id", "axis").agg(F.count("*").alias("n"), F.count_distinct("label").alias("d")).where(F.col("n") == judges)
    return per.groupBy("axis").agg(F.count(F.when(F.col("d") == 1, 1)).alias("all_agree"), F.count("*").alias("total")).withColumn("rate", F.col("all_agree") / F.col("total"))


def permutation_consistency(pairs_: DataFrame, decisions: DataFrame) -> DataFrame:
    """(judge, axis, consistent, total, rate): does the answer in one order mirror that in the other."""
    rows = labels_long(decisions).join(pairs_.select("pair_id", "comparison_id", "qid", "perm"), "pair_id")
    side = lambda p: F.max(F.when(F.col("perm") == p, F.col("label")))
    both = rows.groupBy("judge", "axis", "comparison_id", "qid").agg(side("AB").alias("ab"), side("BA").alias("ba")).where("ab IS NOT NULL AND ba IS NOT NULL")
    same = F.count(F.when(F.col("ba") == T.invert_label(F.col("ab")), 1))
    return both.groupBy("judge", "axis").agg(same.alias("consistent"), F.count("*").alias("total")).withColumn("rate", F.col("consistent") / F.col("total"))


def operations(decisions: DataFrame, prices: DataFrame) -> DataFrame:
    """(judge, calls, ok, failed, retries, input_tokens, output_tokens, total_tokens, latency_ms, cost), and a row TOTAL.

    prices: (judge, input_usd, output_usd) for a million tokens. decisions: (judge, status, attempts, input_tokens, output_tokens, total_tokens, latency_ms).
    """
    rows = decisions.join(F.broadcast(prices), "judge", "left").fillna(0, ["input_tokens", "output_tokens", "input_usd", "output_usd", "latency_ms"])
    total = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    cost = F.col("input_tokens") * F.col("input_usd") / 1e6 + F.col("output_tokens") * F.col("output_usd") / 1e6
    found = rows.rollup("judge").agg(
        F.count("*").alias("calls"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("ok"),
        F.count(F.when(F.coalesce(F.col("status") != "ok", F.lit(True)), 1)).alias("failed"),
        F.count(F.when(F.col("attempts") > 1, 1)).alias("retries"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(total).alias("total_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum(cost).alias("cost"),
    )
    return found.withColumn("judge", F.coalesce("judge", F.lit("TOTAL")))


def agreement(manual: DataFrame, decisions: DataFrame) -> DataFrame:
    """(judge, axis, n, direct, inverted, suspicious): agreement with manual labels as they are and with A and B swapped.

    manual: (pair_id, axis, manual). A judge that does better swapped, and under half as it is, is suspicious.
    """
    rows = labels_long(decisions).join(manual, ["pair_id", "axis"])
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = rows.groupBy("judge", "axis").agg(F.count("*").alias("n"), share(F.col("label") == F.col("manual")).alias("direct"), share(T.invert_label(F.col("label")) == F.col("manual")).alias("inverted"))
    return per.withColumn("suspicious", (F.col("inverted") > F.col("direct")) & (F.col("direct") < 0.5))


def accepted(agreed: DataFrame, least: float = 0.7, judges: int = 2) -> DataFrame:
    """(mean, good, accepted): are there enough judges whose mean agreement is high enough."""
    per = agreed.groupBy("judge").agg(F.avg("direct").alias("mean"))
    return per.agg(F.avg("mean").alias("mean"), F.count(F.when(F.col("mean") >= least, 1)).alias("good")).withColumn("accepted", F.col("good") >= judges)


def confusion(manual: DataFrame, decisions: DataFrame) -> DataFrame:
    """(axis, manual, label, n)."""
    return labels_long(decisions).join(manual, ["pair_id", "axis"]).groupBy("axis", "manual", "label").agg(F.count("*").alias("n"))


def fiveway_summary(runs: DataFrame) -> DataFrame:
    """(method, n, mean, std): pooled scores; the deviation of one score is 0. runs: (qid, judge, method, metric, score)."""
    std = F.when(F.count("score") > 1, F.stddev_samp("score")).otherwise(0.0)
    return runs.groupBy("method", "metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), std.alias("std"))


def consensus(choices: DataFrame) -> DataFrame:
    """(qid, winner, votes, n): a method with more than half of the votes and more than any other, else TIE.

    choices: (qid, judge, method), a null or empty method is a vote for none.
    """
    rows = choices.withColumn("method", F.when(F.coalesce("method", F.lit("")) == "", TIE).otherwise(F.col("method")))
    counted = rows.groupBy("qid", "method").agg(F.count("*").alias("v"))
    order = Window.partitionBy("qid").orderBy(F.col("v").desc(), "method")
    own = Window.partitionBy("qid")
    ranked = counted.withColumn("n", F.sum("v").over(own)).withColumn("next", F.lead("v", 1, 0).over(order)).withColumn("r", F.row_number().over(order)).where("r = 1")
    wins = (F.col("v") * 2 > F.col("n")) & (F.col("v") > F.col("next"))
    return ranked.select("qid", F.when(wins, F.col("method")).otherwise(TIE).alias("winner"), F.col("v").alias("votes"), "n")


def distribution(choices: DataFrame) -> DataFrame:
    """(qid, breakdown): ``method:votes;`` in order of votes, then name."""
    rows = choices.withColumn("method", F.when(F.coalesce("method", F.lit("")) == "", TIE).otherwise(F.col("method")))
    counted = rows.groupBy("qid", "method").agg(F.count("*").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), "method", "v")))
    return counted.groupBy("qid").agg(F.concat(F.array_join(F.transform(ordered, lambda x: F.concat(x["method"], F.lit(":"), x["v"].cast("string"))), ";"), F.lit(";")).alias("breakdown"))


def with_skips(expected: DataFrame, choices: DataFrame) -> DataFrame:
    """(qid, decision, share): the most frequent choice of each expected query; SKIPPED with share 1 where nothing was judged."""
    counted = choices.groupBy("qid", "method").agg(F.count("*").alias("v"))
    own, order = Window.partitionBy("qid"), Window.partitionBy("qid").orderBy(F.col("v").desc(), "method")
    top = counted.withColumn("share", F.col("v") / F.sum("v").over(own)).withColumn("r", F.row_number().over(order)).where("r = 1")
    return expected.join(top, "qid", "left").select("qid", F.coalesce("method", F.lit(SKIPPED)).alias("decision"), F.coalesce("share", F.lit(1.0)).alias("share"))


def integrity(methods: DataFrame, expected: int) -> DataFrame:
    """(method, qids, missing, complete): queries that some method has and this one lacks."""
    every = methods.select("qid").distinct()
    full = methods.select("method").distinct().join(F.broadcast(every.agg(F.count("*").alias("total"))))
    have = methods.groupBy("method").agg(F.count_distinct("qid").alias("qids"))
    return have.join(full, "method").select("method", "qids", (F.col("total") - F.col("qids")).alias("missing"), ((F.col("qids") == F.col("total")) & (F.col("total") == expected)).alias("complete"))


def rekeyed(labels: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels by old pair_id under the new one of the same comparison, query and order; a label without one is an error."""
    keys = ["comparison_id", "qid", "perm"]
    joined = labels.join(old.select("pair_id", *keys), "pair_id").join(new.select(F.col("pair_id").alias("new_id"), *keys), keys, "left")
    checked = F.when(F.col("new_id").isNull(), F.raise_error(F.concat(F.lit("no new pair for "), "pair_id"))).otherwise(F.col("new_id"))
    return joined.withColumn("rekeyed_from", F.col("pair_id")).withColumn("pair_id", checked).drop("new_id")


def cost_estimate(pairs_: DataFrame, prices: DataFrame, output_tokens: int = 120) -> DataFrame:
    """(judge, calls, input_tokens, usd): contexts' tokens at each judge's price and a fixed answer."""
    tokens = pairs_.agg(F.count("*").alias("calls"), F.sum(T.count_tokens(F.col("context_a")) + T.count_tokens(F.col("context_b"))).alias("input_tokens"))
    return prices.join(F.broadcast(tokens)).select("judge", "calls", "input_tokens", (F.col("input_tokens") * F.col("input_usd") / 1e6 + F.col("calls") * output_tokens * F.col("output_usd") / 1e6).alias("usd"))


def coverage(questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """(qid, n_pmids, n_pmcs, ratio, lenient, strict). questions: (qid, pmid); mapping: (pmid, pmcid), first of each pmid."""
    found = questions.distinct().join(mapping, "pmid", "left")
    rows = found.groupBy("qid").agg(F.count_distinct("pmid").alias("n_pmids"), F.count_distinct("pmcid").alias("n_pmcs"))
    rows = rows.withColumn("ratio", F.when(F.col("n_pmids") > 0, F.col("n_pmcs") / F.col("n_pmids")).otherwise(0.0))
    return rows.withColumn("lenient", F.col("n_pmcs") >= 1).withColumn("strict", (F.col("n_pmcs") >= 2) | (F.col("ratio") >= 0.5))
