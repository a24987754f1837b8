"""Scores of several methods by letter: payloads and prompts for judges, their answers, and the tables of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.operators import judge

LETTERS = ["A", "B", "C", "D", "E"]
METRICS = ["relevance", "usefulness_for_logic", "coherence", "noise", "overall"]
ROLES = ["system", "user", "assistant", "developer"]
#: Words of a decision that mean a tie, and what an answer of each kind must have.
TIE_WORDS = ["tie", "equal", "same", "draw"]
FIVEWAY_KEYS = ["relevance", "noise", "overall", "winner", "ranking", "failure_letters", "confidence", "rationales"]
_SCORES = "map<string,string>"
_ANSWER = f"decision string, reason string, winner string, confidence string, ranking array<string>, failure_letters array<string>, rationales map<string,string>, relevance {_SCORES}, usefulness_for_logic {_SCORES}, answerability {_SCORES}, sufficiency_for_reasoning {_SCORES}, coherence {_SCORES}, noise {_SCORES}, overall {_SCORES}"


# Payloads and prompts


def canonical(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Queries with the text that a table of queries gives for their id, their own where it has none. texts: (qid, query)."""
    other = texts.select("qid", F.nullif(F.trim("query"), F.lit("")).alias("_query"))
    return queries.join(other, "qid", "left").withColumn("query", F.coalesce("_query", "query")).drop("_query")


def in_every_method(methods: DataFrame) -> DataFrame:
    """(qid): queries that every method has. methods: (method, qid)."""
    total = methods.agg(F.count_distinct("method").alias("total"))
    return methods.groupBy("qid").agg(F.count_distinct("method").alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select("qid")  # one row


def payloads(contexts: DataFrame, queries: DataFrame, seed: str = "42") -> DataFrame:
    """(qid, query, contexts_for_judge, private_mapping): each query's methods under letters, in an order that its id and the seed decide.

    contexts: (method, qid, context), five methods at most; only queries that every method has. The order is that of SHA-256
    of seed, query and method, so that it is the same on any engine.
    """
    kept = contexts.join(in_every_method(contexts), "qid", "left_semi")
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string"), "method"), 256)
    rows = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "method", "context"))).alias("x"))
    letters = F.slice(F.array(*map(F.lit, LETTERS)), 1, F.size("x"))
    shown = F.map_from_arrays(letters, F.transform("x", lambda v: v["context"]))
    hidden = F.map_from_arrays(letters, F.transform("x", lambda v: v["method"]))
    return rows.join(queries.select("qid", "query"), "qid").select("qid", "query", shown.alias("contexts_for_judge"), hidden.alias("private_mapping"))


def prompt_mode(contexts: Column) -> Column:
    """``pairwise`` where a payload has exactly A and B of the letters, else ``multiway``."""
    present = F.filter(F.map_keys(contexts), lambda k: k.isin(LETTERS))
    return F.when(F.sort_array(present) == F.array(F.lit("A"), F.lit("B")), "pairwise").otherwise("multiway")


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``mode`` and ``candidates``, (letter, text) of the mode's letters, missing ones empty.

    rows may have contexts_for_judge, retrieved_contexts, contexts or candidates, maps by letter; the first that is not null counts.
    """
    known = [F.col(c) for c in ("contexts_for_judge", "retrieved_contexts", "contexts", "candidates") if c in rows.columns]
    found = F.coalesce(*known, F.create_map().cast(_SCORES))
    mode = F.when(F.coalesce(*known).isNull(), "multiway").otherwise(prompt_mode(found))
    letters = F.when(mode == "pairwise", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(*map(F.lit, LETTERS)))
    texts = F.transform(letters, lambda k: F.struct(k.alias("letter"), F.coalesce(F.try_element_at(found, k), F.lit("")).alias("text")))
    return rows.withColumn("mode", mode).withColumn("candidates", texts)


def prompts(rows: DataFrame, instructions: str) -> DataFrame:
    """(qid, mode, messages): a system message and a user message with the query and its candidates. rows: payloads."""
    body = F.array_join(F.transform("candidates", lambda c: F.concat(F.lit("CANDIDATE "), c["letter"], F.lit(":\n"), c["text"])), "\n\n")
    user = F.concat(F.lit("QUERY:\n"), T.strip(F.col("query")), F.lit("\n\n"), body)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(instructions).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return candidates(rows).select("qid", "mode", messages.alias("messages"))


def prompt_markdown(messages: Column) -> Column:
    """Messages as a document with a heading for each role."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("## "), F.upper(m["role"]), F.lit("\n\n"), m["content"])), "\n\n")


def normalized_messages(c: Column) -> Column:
    """array<struct<role, content>> of a prompt: a list, or an object with ``messages`` or ``input``; another shape, role or no content is an error."""
    kind = "array<struct<role:string,content:string>>"
    listed = F.from_json(c, kind)
    wrapped = F.from_json(c, f"messages {kind}, input {kind}")
    found = F.when(F.ltrim(c).startswith("["), listed).otherwise(F.coalesce(wrapped["messages"], wrapped["input"]))
    wrong = F.exists(found, lambda m: ~F.coalesce(m["role"].isin(ROLES), F.lit(False)) | m["content"].isNull())
    problem = F.when(found.isNull(), "a prompt is a list or has messages or input").when(wrong, "a message has no valid role or no content")
    return F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(found)


def schema_mode(messages: Column) -> Column:
    """Which answer a prompt asks for: ``fiveway_reasoning``, ``fiveway`` or ``pairwise``, by words in it."""
    full = F.array_join(F.transform(messages, lambda m: m["content"]), "\n")
    any_of = lambda *words: F.greatest(*[F.contains(full, F.lit(w)) for w in words])
    return F.when(any_of("sufficiency_for_reasoning", "coherence"), "fiveway_reasoning").when(any_of("CANDIDATE C", "CANDIDATE D", "CANDIDATE E"), "fiveway").otherwise("pairwise")


# Answers


def _whole(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[0-9]+$"), F.lit(False))


def _rated(scores: Column) -> Column:
    """Whether a map has a whole number from 0 to 5 for each letter."""
    good = lambda k: _whole(F.try_element_at(scores, F.lit(k))) & F.try_element_at(scores, F.lit(k)).isin(*"012345")
    ok = good(LETTERS[0])
    for k in LETTERS[1:]:
        ok = ok & good(k)
    return F.coalesce(ok, F.lit(False))


def problem(raw: Column, mode: Column) -> Column:
    """What is wrong with an answer in JSON for its mode; null if it is valid."""
    a = F.from_json(raw, _ANSWER)
    keys = F.json_object_keys(raw)
    lacks = lambda names: F.filter(F.array(*map(F.lit, names)), lambda k: ~F.array_contains(keys, k))

    def five(metrics: list[str], missing: Column, extra: list[str]) -> Column:
        allowed = F.array(*map(F.lit, [*FIVEWAY_KEYS, *extra]))
        unknown = F.filter(keys, lambda k: ~F.array_contains(allowed, k))
        found = F.when(F.size(missing) > 0, F.concat(F.lit("Missing keys: "), F.array_join(missing, ","))).when(F.size(unknown) > 0, F.concat(F.lit("Unexpected extra keys: "), F.array_join(F.array_sort(unknown), ",")))
        for m in ["relevance", *metrics, "noise", "overall"]:
            scores = F.coalesce(a["usefulness_for_logic"], a["answerability"]) if m == "usefulness_for_logic" else a[m]
            found = found.when(~_rated(scores), f"'{m}' must rate A to E from 0 to 5")
        found = found.when(F.coalesce(~a["winner"].isin("", *LETTERS), F.lit(True)), "'winner' must be empty or one of A-E")
        found = found.when(F.coalesce(F.sort_array(a["ranking"]) != F.array(*map(F.lit, LETTERS)), F.lit(True)), "'ranking' must have A-E, each once")
        found = found.when(F.coalesce(F.size(F.array_except(a["failure_letters"], F.array(*map(F.lit, LETTERS)))) > 0, F.lit(True)), "'failure_letters' must be letters")
        return found.when(a["rationales"].isNull(), "'rationales' must be an object")

    metric = F.when(F.array_contains(keys, "usefulness_for_logic") | F.array_contains(keys, "answerability"), F.array().cast("array<string>")).otherwise(F.array(F.lit("usefulness_for_logic")))
    plain = five(["usefulness_for_logic"], F.concat(lacks(FIVEWAY_KEYS), metric), ["usefulness_for_logic", "answerability"])
    reasoning = five(["sufficiency_for_reasoning", "coherence"], lacks([*FIVEWAY_KEYS, "sufficiency_for_reasoning", "coherence"]), ["sufficiency_for_reasoning", "coherence"])
    pair = F.when(F.coalesce(~a["decision"].isin("", "A", "B"), F.lit(True)), "'decision' must be empty, A or B").when(F.coalesce(F.trim(a["reason"]) == "", F.lit(True)), "'reason' must be a text")
    return F.when(keys.isNull(), "no JSON object").otherwise(F.when(mode == "pairwise", pair).when(mode == "fiveway", plain).otherwise(reasoning))


def judge_block(raw: Column) -> Column:
    """The answer in a record as JSON: ``parsed_json``, else ``judge_response``, else the record if it is an answer itself; null if it is none."""
    inner = [F.when(F.get_json_object(raw, f"$.{name}").startswith("{"), F.get_json_object(raw, f"$.{name}")) for name in ("parsed_json", "judge_response")]
    keys = F.json_object_keys(raw)
    has = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0
    flat = has(["decision", "reason"]) | has([*FIVEWAY_KEYS, "usefulness_for_logic"]) | has([*FIVEWAY_KEYS, "sufficiency_for_reasoning", "coherence"])
    return F.coalesce(*inner, F.when(flat, raw))


def mode_of(mapping: Column) -> Column:
    """``fiveway`` where a payload's mapping has C, D or E, else ``pairwise``."""
    return F.when(F.exists(F.map_keys(mapping), lambda k: k.isin("C", "D", "E")), "fiveway").otherwise("pairwise")


def salvaged(raw: Column) -> Column:
    """struct<decision, reason> of a failed pairwise record's text (an object in it, already found); tie words are the empty decision; null if it is none."""
    a = F.from_json(raw, "decision string, reason string")
    decision = F.trim(a["decision"])
    decision = F.when(F.lower(decision).isin(TIE_WORDS), "").otherwise(decision)
    return F.when(decision.isin("A", "B", "") & (a["reason"] != ""), F.struct(decision.alias("decision"), a["reason"].alias("reason")))


def runs(records: DataFrame, payloads_: DataFrame) -> DataFrame:
    """(qid, replica, model, query, mode, parse_ok, parse_error, file, mapping, answer): one row a record.

    records: (qid, replica, model, status, raw, raw_object, file), raw a record as JSON, raw_object the object found in a failed one's
    text; payloads_: (qid, query, mapping). Failed pairwise records are salvaged where their text has a decision.
    """
    rows = records.join(payloads_.select("qid", "query", "mapping"), "qid").withColumn("mode", mode_of(F.col("mapping"))).withColumn("_block", judge_block(F.col("raw")))
    rows = rows.withColumn("_s", F.when((F.col("mode") == "pairwise") & (F.coalesce("status", F.lit("OK")) != "OK"), salvaged(F.col("raw_object"))))
    failed = (F.coalesce("status", F.lit("OK")) != "OK") & F.col("_s").isNull()
    text = F.when(F.col("_s").isNotNull(), F.to_json("_s")).otherwise(F.col("_block"))
    error = F.when(failed, F.concat(F.lit("status="), "status")).when(F.col("_s").isNotNull(), "SALVAGED_FROM_ERROR").when(text.isNull(), "missing parsed_json/judge_response")
    ok = ~failed & text.isNotNull()
    return rows.select("qid", "replica", "model", "query", "mode", ok.alias("parse_ok"), error.alias("parse_error"), "file", "mapping", F.when(ok, F.from_json(text, _ANSWER)).alias("answer"))


def is_tie(run: DataFrame) -> Column:
    """A parsed run whose judge named nobody."""
    named = F.when(run["mode"] == "pairwise", run["answer"]["decision"]).otherwise(run["answer"]["winner"])
    return run["parse_ok"] & (F.coalesce(named, F.lit("")) == "")


def _score(name: str, letter: Column) -> Column:
    return T.safe_int(F.try_element_at(F.col(f"answer.{name}"), letter))


def wide(found: DataFrame) -> DataFrame:
    """One row a run: methods in place of letters, and overall and coherence scores by letter."""
    method = lambda letter: F.coalesce(F.try_element_at(F.col("mapping"), letter), F.lit(""))
    a = F.col("answer")
    scores = [_score(m, F.lit(k)).alias(f"{m}_{k}") for m in ("overall", "coherence") for k in LETTERS]
    named = [F.coalesce(a["decision"], F.lit("")).alias("decision_letter"), method(a["decision"]).alias("decision_method"), F.coalesce(a["winner"], F.lit("")).alias("winner_letter"), method(a["winner"]).alias("winner_method")]
    ranking = F.coalesce(a["ranking"], F.array().cast("array<string>"))
    lists = [F.array_join(F.coalesce(a["failure_letters"], F.array().cast("array<string>")), ",").alias("failure_letters"), F.array_join(ranking, ",").alias("ranking_letters"), F.array_join(F.transform(ranking, method), ",").alias("ranking_methods")]
    return found.select("qid", "replica", "model", "query", "mode", "parse_ok", "parse_error", "file", *named, a["reason"].alias("reason"), a["confidence"].alias("confidence"), *lists, *scores)


def long(found: DataFrame) -> DataFrame:
    """A row for each five-way run and letter: its method, its scores, whether it failed and why."""
    rows = found.where("mode = 'fiveway'").withColumn("letter", F.explode(F.array(*map(F.lit, LETTERS))))
    failed = F.coalesce(F.array_contains("answer.failure_letters", F.col("letter")), F.lit(False))
    method = F.coalesce(F.try_element_at(F.col("mapping"), F.col("letter")), F.lit(""))
    why = F.coalesce(F.try_element_at(F.col("answer.rationales"), F.col("letter")), F.lit(""))
    return rows.select("qid", "replica", "model", "query", "letter", method.alias("method"), "parse_ok", "parse_error", failed.alias("is_failure"), *[_score(m, F.col("letter")).alias(m) for m in METRICS], why.alias("rationale"), "file")


def consensus_rows(rows: DataFrame) -> DataFrame:
    """(qid, letter, method, n_judges, the metrics' means, is_failure, rationale) from ``long`` rows that were parsed.

    A letter fails if more than half of the judges say so; the rationale is that of the highest overall score, of equals the first run's.
    """
    order = F.struct((-F.col("overall")).alias("o"), "model", F.coalesce("replica", F.lit(-1)).alias("r"))
    best = F.min_by(F.when(F.col("overall").isNotNull(), F.col("rationale")), F.when(F.col("overall").isNotNull(), order))
    return rows.where("parse_ok").groupBy("qid", "letter", "method").agg(F.count("*").alias("n_judges"), *[F.avg(m).alias(m) for m in METRICS], (F.sum(F.col("is_failure").cast("int")) * 2 > F.count("*")).alias("is_failure"), F.coalesce(best, F.lit("")).alias("rationale"))


# Pairs


def counterparts(pairs: DataFrame) -> DataFrame:
    """(pair_id, other_id): each pair with that of the same comparison and query in the other order."""
    other = pairs.select("comparison_id", "qid", F.when(F.col("perm") == "AB", "BA").otherwise("AB").alias("perm"), F.col("pair_id").alias("other_id"))
    return pairs.join(other, ["comparison_id", "qid", "perm"]).select("pair_id", "other_id")


def worth_judging(pairs: DataFrame) -> DataFrame:
    """Pairs whose contexts differ once they are stripped."""
    return pairs.where(T.strip(F.col("context_a")) != T.strip(F.col("context_b")))


def completeness(pairs: DataFrame, comparisons: int, queries: int) -> DataFrame:
    """(comparison_id, pairs, missing_orders, total, complete): both orders of every query, and comparisons times queries times two in all."""
    both = pairs.groupBy("comparison_id", "qid").agg(F.count_distinct("perm").alias("orders"), F.count("*").alias("n"))
    per = both.groupBy("comparison_id").agg(F.sum("n").alias("pairs"), F.count(F.when(F.col("orders") < 2, 1)).alias("missing_orders"))
    total = pairs.agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).withColumn("complete", F.col("total") == comparisons * queries * 2)  # one row


def majority_against_expert(manual: DataFrame, decisions: DataFrame, pairs: DataFrame, least: int = 6) -> DataFrame:
    """(axis, n, agree, rate): what most judges say over both orders against the expert, where a comparison, query and axis has ``least`` votes.

    manual: (pair_id, axis, manual); a side wins with VOTES_TO_WIN votes, else it is equal.
    """
    keys = ["comparison_id", "qid", "axis"]
    counted = judge.votes(pairs, decisions).where(F.col("n") >= least)
    voted = judge.outcomes(counted).select(*keys, F.when(F.col("outcome") == "tie", "equal").otherwise(F.col("outcome")).alias("voted"))
    expert = manual.join(pairs.select("pair_id", "comparison_id", "qid", "perm"), "pair_id").where("perm = 'AB'").select(*keys, T.normalize_label(F.col("manual"), F.col("perm")).alias("expert"))
    return voted.join(expert, keys).groupBy("axis").agg(F.count("*").alias("n"), F.count(F.when(F.col("voted") == F.col("expert"), 1)).alias("agree")).withColumn("rate", F.col("agree") / F.col("n"))


def subset(rows: DataFrame, qids: list[str] | None = None, numbers: tuple[int, int] | None = None) -> DataFrame:
    """Rows of named queries, or of those whose number is in a range, both ends included."""
    found = rows if qids is None else rows.where(F.col("qid").isin(qids))
    return found if numbers is None else found.where(T.qid_order(F.col("qid"))["number"].between(*numbers))


def top_votes(choices: DataFrame) -> DataFrame:
    """(qid, n_runs, winner, votes, share, breakdown, has_majority) of judges' choices, as a report lists them."""
    total = choices.groupBy("qid").agg(F.count("*").alias("n_runs"))
    found = judge.consensus(choices).join(judge.distribution(choices), "qid").join(total, "qid")
    wins = F.col("winner") != judge.TIE
    return found.select("qid", "n_runs", F.when(wins, F.col("winner")).otherwise("").alias("winner"), "votes", (F.col("votes") / F.col("n_runs")).alias("share"), F.regexp_replace("breakdown", ";$", "").alias("breakdown"), wins.alias("has_majority"))
