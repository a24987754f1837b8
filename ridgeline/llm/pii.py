"""Personal data: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides. DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Further candidates come from wider patterns:
phone numbers without a plus, addresses written out with (at), and secrets assigned to a name. On every span, base ones
included, five labelers vote yes, no or nothing: shape, checks of the value, a gazetteer of names in the words before,
the characters around, and the mix of characters. EM over the counts of vote patterns (3^5 at most) estimates how
reliable each labeler is; the posteriors are soft labels for a logistic regression over features of the span, fitted on counts of feature
combinations, a few hundred at most. Both fits are single SQL expressions. A further span counts if the classifier gives
it ``ACCEPT`` or more and it does not overlap a base span.

Offsets are code points, ends exclusive. The patterns are the contract's, with possessive quantifiers and starts only where a
run starts, which match the same spans in linear time and without deep recursion.

Null text: no spans. Repeated rows and null ids stay. An empty table gives no rows. Other columns pass untouched or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["phone", "email", "secret"]
ALL_KINDS = [*KINDS, "secret"]
ACCEPT = 0.5
EM_ROUNDS, FIT_ROUNDS = 25, 200
_W = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_W}])|\G)[{_W}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
WRITTEN_EMAIL = rf"(?<![{_W}])[A-Za-z0-9._%+-]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,64}}(?:\.[A-Za-z]{{2,24}}|\x20?[\[(]dot[\])]\x20?[A-Za-z]{{2,24}})"
#: Names that announce personal data, by kind.
GAZETTEER = {
    "email": "email|e-mail|mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|host|address|server|login|from",
    "card": "card|visa|mastercard|amex|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "secret": "token|key|secret|password|passwd|pwd|apikey|api_key|access_token",
}
SECRET = rf"(?i)(?<![A-Za-z])(?:{GAZETTEER['secret']})\x20?[:=]\x20?\"?[A-Za-z0-9+/_-]{{12,}}+"
LABELERS = ["shape", "value", "gazetteer", "around", "mix"]


def _located(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches: lengths of matches and of the gaps between, summed."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"]).cast("long")
        end = start + F.length(pair["value"]).cast("long")
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, zero, add, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(value: Column) -> Column:
    """Each part at most 255, leading zeros or not."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def _none(spans: str = "array<struct<kind:string,start:bigint,end:bigint,value:string>>") -> Column:
    return F.array().cast(spans)


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind and start."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = lambda v: F.length(_digits(v))
    email = F.when(F.contains(text, F.lit("@")), _located(text, EMAIL, "email")).otherwise(_none())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_located(text, IP, "ip"), lambda s: _octets(s["value"]))).otherwise(_none())
    card = F.when(text.rlike(CARD), F.filter(_located(text, CARD, "card"), lambda s: _luhn(s["value"]))).otherwise(_none())
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_located(text, PHONE, "phone"), lambda s: n(s["value"]).between(8, 15))).otherwise(_none())
    return F.concat(email, ip, card, phone)


def further_spans(text: Column, base: Column) -> Column:
    """Candidates of the wider patterns that overlap no base span."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = [
        F.when(text.rlike(LOCAL_PHONE), _located(text, LOCAL_PHONE, "phone")).otherwise(_none()),
        F.when(F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), _located(text, WRITTEN_EMAIL, "email")).otherwise(_none()),
        F.when(text.rlike(r"[A-Za-z]\x20?[:=]"), _located(text, SECRET, "secret")).otherwise(_none()),
    ]
    return F.filter(F.concat(*parts), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _judged(text: Column, spans: Column, is_base: bool) -> Column:
    """array<struct<kind, start, end, votes, x>>: labelers' votes (0 none, 1 yes, 2 no) and the classifier's features."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def judge(s: Column) -> Column:
        kind, value = s["kind"], s["value"]
        before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 19).cast("int"), F.least(F.lit(20), s["start"]).cast("int")))
        left, right = F.substring(text, s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0)), F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        digits, letters = F.length(_digits(value)), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        size = F.length(value)
        named = F.lit(False)
        for k, names in GAZETTEER.items():
            where = F.when(kind == "secret", F.lower(value)).otherwise(before) if k == "secret" else before
            named = named | ((kind == k) & where.rlike(rf"(?:^|[^a-z])(?:{names})(?:[^a-z]|$)"))
        valid = (
            F.when(kind == "email", F.when(value.rlike(r"[.)\] ][A-Za-z]{2,24}$"), 1).otherwise(2))
            .when(kind == "phone", F.when(digits.between(8, 15), 1).otherwise(2))
            .when(kind == "secret", F.when((digits > 0) & (letters > 0), 1).otherwise(2))
            .otherwise(1 if is_base else 2)
        )
        edge = r"^$|[\s\"'(),;:!?<>#*$%&|=]"
        free = (left.rlike(edge)) & (right.rlike(edge + r"|\."))
        mix = (
            F.when(kind == "secret", F.when((digits >= 4) & (letters >= 2) & (size >= 24), 1).when((digits == 0) | (size < 20), 2).otherwise(0))
            .when(kind == "email", F.when(letters >= 4, 1).otherwise(2))
            .otherwise(F.when(digits * 2 >= size, 1).otherwise(2))
        )
        votes = F.array(F.lit(1 if is_base else 0), valid.cast("int"), F.when(named, 1).otherwise(0), F.when(free, 1).otherwise(2), mix.cast("int"))
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        x = F.array(F.lit(1.0), *[one(kind == k) for k in ALL_KINDS], F.lit(1.0 if is_base else 0.0), one(named), one(free), one(valid == 1), one(mix == 1), one(size >= 24), one(digits * 2 >= size))
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), x.alias("x"))

    return F.transform(spans, judge)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base`` and ``_further``: judged spans of each row."""
    found = docs.withColumn("_b", base_spans(F.col("text")))
    found = found.withColumn("_f", further_spans(F.col("text"), F.col("_b")))
    return found.withColumn("_base", _judged(F.col("text"), F.col("_b"), True)).withColumn("_further", _judged(F.col("text"), F.col("_f"), False)).drop("_b", "_f")


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + value(r))


def _reliabilities(rows: Column) -> Column:
    """EM over array<struct<votes, n>>: struct<prior, yes, no>, the latter two P(vote | label) by labeler."""
    n_labelers = len(LABELERS)
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))] * n_labelers).alias("yes"), F.array(*[F.array(F.lit(0.4), F.lit(0.2), F.lit(0.4))] * n_labelers).alias("no"))

    def likely(tables: Column, votes: Column) -> Column:
        return F.aggregate(F.zip_with(tables, votes, lambda t, v: F.element_at(t, v + 1)), F.lit(1.0), lambda a, p: a * p)

    def step(state: Column, _: Column) -> Column:
        def expected(r: Column) -> Column:
            yes, no = state["prior"] * likely(state["yes"], r["votes"]), (1 - state["prior"]) * likely(state["no"], r["votes"])
            return F.struct(r["votes"].alias("votes"), (r["n"] * yes / (yes + no)).alias("yes"), (r["n"] * no / (yes + no)).alias("no"))

        def maximised(q: Column) -> Column:
            total = {s: _total(q, lambda r, s=s: r[s]) for s in ("yes", "no")}
            tables = [F.array(*[F.array(*[(_total(q, lambda r, s=s, j=j, v=v: F.when(F.element_at(r["votes"], j + 1) == v, r[s]).otherwise(0.0)) + 1) / (total[s] + 3) for v in range(3)]) for j in range(n_labelers)]).alias(s) for s in ("yes", "no")]
            return F.struct(((total["yes"] + 1) / (total["yes"] + total["no"] + 2)).alias("prior"), *tables)

        return F.element_at(F.transform(F.array(F.transform(rows, expected)), maximised), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step)


def _posterior(votes: Column, model: dict) -> Column:
    """Probability of yes under literal tables."""
    sides = {}
    for s, prior in (("yes", model["prior"]), ("no", 1 - model["prior"])):
        p = F.lit(float(prior))
        for j, table in enumerate(model[s]):
            p = p * F.element_at(F.array(*[F.lit(float(t)) for t in table]), F.element_at(votes, j + 1) + 1)
        sides[s] = p
    return sides["yes"] / (sides["yes"] + sides["no"])


def _weights(rows: Column, size: int) -> Column:
    """Logistic regression by gradient steps over array<struct<x, n, q>>."""
    start = F.array_repeat(F.lit(0.0), size)
    total = _total(rows, lambda r: r["n"])

    def dot(w: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def step(w: Column, _: Column) -> Column:
        error = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), (r["n"] * (r["q"] - 1 / (1 + F.exp(-dot(w, r["x"]))))).alias("e")))
        grad = lambda e: F.transform(w, lambda wk, k: wk + 2.0 * (_total(e, lambda r: r["e"] * F.element_at(r["x"], k + 1)) / total - 1e-3 * wk))
        return F.element_at(F.transform(F.array(error), grad), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), start, step)


def fit(found: DataFrame) -> list[float]:
    """Weights of the span classifier from rows with ``_base`` and ``_further``; none without any span."""
    spans = found.select(F.explode(F.concat("_base", "_further")).alias("s")).select("s.votes", "s.x")
    counts = spans.groupBy("votes", "x").agg(F.count("*").cast("double").alias("n"))  # a few hundred rows, whatever the input
    patterns = counts.groupBy("votes").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("votes", "n")).alias("rows"))
    row = patterns.select(_reliabilities(F.array_sort("rows")).alias("m"), F.size("rows").alias("k")).first()
    if not row["k"]:
        return []
    soft = counts.withColumn("q", _posterior(F.col("votes"), row["m"].asDict())).groupBy("x").agg(F.sum("n").alias("n"), (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("q"))
    size = 1 + len(ALL_KINDS) + 7
    return list(soft.agg(F.collect_list(F.struct("x", "n", "q")).alias("rows")).select(_weights(F.array_sort("rows"), size).alias("w")).first()["w"])


def accepted(further: Column, weights: list[float]) -> Column:
    """The further spans that the classifier takes."""
    if not weights:
        return F.filter(further, lambda s: F.lit(False))
    w = F.array(*[F.lit(float(x)) for x in weights])
    score = lambda s: F.aggregate(F.zip_with(w, s["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    import math

    return F.filter(further, lambda s: score(s) >= math.log(ACCEPT / (1 - ACCEPT)))


def _joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    key = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(key), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(with_spans(rows).select("doc_id", "_base", "_further"), "spans")
    weights = fit(found)

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    every = F.concat("_base", accepted(F.col("_further"), weights))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``text`` with each span replaced by its kind in brackets; other columns stay, null stays null."""
    found = stage(with_spans(docs), "spans", dictionary=False)
    weights = fit(found)
    spans = F.array_sort(F.transform(F.concat("_base", accepted(F.col("_further"), weights)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["end"] <= state["at"], state).otherwise(new)

    text = F.aggregate(spans, start, add, lambda st: F.concat(st["out"], F.substring(F.col("text"), (st["at"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", F.when(F.size(F.concat("_base", "_further")) > 0, text).otherwise(F.col("text"))).drop("_base", "_further")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters, over all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
