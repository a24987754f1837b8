"""Classifiers by held-out accuracy and exact properties; personal data against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import language, pii, quality, toxicity
from ridgeline.llm.common import Words, fold, utf8

DOCS = "doc_id long, text string, lang string, score double, kept int"
SF = "/root/testdata/sf0.01"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 0.5, 1) for i, t in enumerate(texts)], DOCS)


def test_codes_are_distributions():
    model = language.Model.fit({"a": ["abab abc", "bca"], "b": ["xyz xyy"]})
    for context in (b"", b"ab", b"abab", b"zzzz", b"xyz "):
        texts = [context + bytes([b]) for b in range(256)]
        # lower-casing would merge bytes: score raw bytes through the model's own tables
        data = np.concatenate([np.frombuffer(b"\n" * language.ORDER + t, np.uint8) for t in texts])
        at = np.arange(256) * (language.ORDER + len(context) + 1) + language.ORDER + len(context)
        total = np.zeros((256, 2))
        key = language.contexts(data, at, language.ORDER)
        left, spent = np.arange(256), np.zeros((256, 2))
        for order in range(language.ORDER, 0, -1):
            k = key[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            place = model.nodes[order - 1][0].find(k)
            hit = place >= 0
            total[left[hit]] = spent[left[hit]] + model.nodes[order - 1][1][place[hit]]
            left, k = left[~hit], k[~hit]
            place = model.escapes[order - 1][0].find(k >> np.uint64(8))
            spent[left[place >= 0]] += model.escapes[order - 1][1][place[place >= 0]]
        total[left] = spent[left] + model.base[(key[left] & np.uint64(255)).astype(int)]
        assert np.allclose(np.exp2(-total).sum(0), 1, atol=1e-4)


def test_language_held_out(spark):
    found = language.op2_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = found[found.held_out].merge(lang, on="doc_id")
    assert len(found) == 1000 and (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()


def brute_code_length(texts, text, order):
    """Bits of a text under counts of all contexts, a byte at a time."""
    counts = {}
    for t in texts:
        raw = b"\n" * order + t.lower().encode()
        for k in range(order, len(raw)):
            for n in range(order + 1):
                counts.setdefault(raw[k - n : k], Counter())[raw[k]] += 1
    raw, total = b"\n" * order + text.lower().encode(), 0.0

    def share(context, byte):
        c = counts.get(context, Counter())
        t, q = sum(c.values()), len(c)
        if c[byte]:
            return c[byte] / (t + q)
        if not context:
            return q / (t + q) / (256 - q) if c else 1 / 256
        if not c:
            return share(context[1:], byte)
        taken = sum(share(context[1:], b) for b in c)
        return q / (t + q) * share(context[1:], byte) / (1 - taken)

    for k in range(order, len(raw)):
        total -= np.log2(share(raw[k - order : k], raw[k]))
    return total


def test_code_lengths_equal_brute_force():
    texts = {"a": ["abab abc é", "bca cab"], "b": ["xyz xyy", "Zyx a"]}
    model = language.Model.fit(texts)
    asked = ["abab", "", "xyz abc", "éé\nq", "A" * 30, "zyx zyx cab"]
    bits, size = model.code_lengths(pa.array(asked, pa.large_string()))
    for t, row in zip(asked, bits):
        assert np.allclose(row, [brute_code_length(texts[name], t, language.ORDER) for name in model.languages], atol=1e-3)
    for t, row in zip(asked, bits):  # whatever is around a text
        assert (model.code_lengths(pa.array([t], pa.large_string()))[0][0] == row).all()


def test_letters_are_of_category_l(spark):
    docs = frame(spark, ["some english words", "½ ² 12 !", "٣٤", "ª", "字", "_"])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()}
    assert got == {0: "en", 1: "und", 2: "und", 3: "en", 4: "en", 5: "und"}


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "BYTES_A_LANGUAGE", 100)
    monkeypatch.setattr(language, "LANGUAGES", 1)
    docs = spark.createDataFrame([(i, "some words " * 2, "en", 0.5, 1) for i in range(20)] + [(99, "andere", "de", 0.5, 1), (None, "long " * 99, "en", None, None)] + [(3, "some words " * 2, "en", 0.5, 1)] * 2, DOCS)
    model = language.fit(docs)
    assert model.languages == ["en"] and language.identify(docs, model).count() == 24


def test_language_edges(spark):
    docs = frame(spark, ["some english words here", None, "", "1234 !!", "long " * 50_000])
    model = language.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert [got[i][0] for i in range(5)] == ["en", "und", "und", "und", "en"] and got[1][1] == 0
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts():
    rng = random.Random(2)
    parts = ["a", "bé", "#", "\n", " ", "\t", "a b", "<x>", "\n\n", "ü "]
    texts = [None, "", "a a a a", *("".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(200))]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    c = quality.counts(Words(data, offsets))
    got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute_counts(t) for t in texts]


def test_quality_model(spark):
    found = quality.op4_quality_rules(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(found, on="doc_id")
    fair = labels[~labels.base_failed]
    assert len(found) == 1000 and (fair.kept == (fair.quality == 1)).mean() > 0.95
    assert not found[found.base_failed].kept.any()


def test_quality_edges(spark):
    docs = frame(spark, ["w%d" % i for i in range(3)] + [None, "", " ".join(f"v{i}" for i in range(60))])
    model = quality.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    rows = quality.assess(docs, model).collect()
    assert [r["base_failed"] for r in sorted(rows)] == [True] * 5 + [False]
    assert quality.assess(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    found = toxicity.op5_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(found, on="doc_id")
    held = labels[labels.held_out]
    hit = held[held.toxic == 1].predicted.mean()
    false = held[held.toxic == 0].predicted.mean()
    assert len(found) == 1000 and hit > 0.6 and false < 0.1 and found.score.between(0, 1).all()


def test_thresholds_come_from_what_training_leaves_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Model, "calibrate", lambda self, texts, label, language: seen.append((texts, label.tolist(), language)))
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, label: seen.append(texts) or cls(np.zeros((2, 2, 1)))))
    docs = spark.createDataFrame([(i, f"text {i}", "en", 0.5, 1) for i in range(50)], DOCS)
    toxicity.fit_with_languages(docs, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int"))
    assert seen[1][0] == seen[0][4::5] and len(seen[1][1]) == 10 and seen[1][2] == ["en"] * 10


def test_repeated_rows_and_null_ids_are_judged_alike(spark):
    rows = [(1, "one text of words", "en", 0.5, 1)] * 3 + [(1, "another text", "en", 0.5, 1), (None, "one text of words", "en", None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.assess(docs, quality.fit(docs, labels)), toxicity.classify(docs, toxicity.fit(docs, labels)), pii.find(docs)):
        got = [tuple(r)[1:] for r in found.collect()]
        assert len(got) == 6 and max(Counter(got).values()) >= 4


def test_quality_fit_holds_few_bytes_an_entry():
    """The driver fits: twice as many texts take 12 bytes an n-gram more, and some more that passes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 20, 400)) for _ in range(1600)]
    label = (np.arange(1600) % 3 > 0).astype(float)
    peak, entries = [], []
    for n in (800, 1600):
        entries.append(sum(len(np.unique(s)) for t in texts[:n] for s, _ in quality.slots(Words(*utf8(pa.array([t], pa.large_string()))))))
        tracemalloc.start()
        quality.Model.fit(texts[:n], label[:n], rounds=1)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (peak[1] - peak[0]) / (entries[1] - entries[0]) < 24


def test_quality_does_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    texts = ["", "a", "ab", "é", *(" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in range(1, 60))]
    model = quality.Model(rng.normal(0, 1, (2 << quality.WORD_BITS) + (1 << quality.CHAR_BITS)).astype(np.float32), 0.1, (0.7, 0.2))
    alone = [model.probability(Words(*utf8(pa.array([t], pa.large_string()))))[0] for t in texts]
    for order in (rng.permutation(len(texts)) for _ in range(4)):
        data, offsets = utf8(pa.array([texts[i] for i in order], pa.large_string()))
        assert model.probability(Words(data, offsets)).tolist() == [alone[i] for i in order]


def test_toxicity_edges(spark):
    docs = frame(spark, ["fine words", None, "", "!!!", "idiot " * 3])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted(r["doc_id"] for r in toxicity.classify(docs, model).collect()) == [0, 1, 2, 3, 4]
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_toxicity_does_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) + (" bad" if n % 2 else "") for n in range(1, 60)]
    model = toxicity.Model.fit(texts, np.array([n % 2 for n in range(1, 60)], float), epochs=2)
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    together = model.raw(data, offsets)
    alone = [model.raw(*utf8(pa.array([t], pa.large_string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


def test_folds(spark):
    import zlib

    rows = frame(spark, ["x"] * 50).select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        g = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(g) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(g)) % 10 == 0:
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m))
    return [(k, m.start(), m.end()) for k, m in out]


def pii_texts(n):
    rng = random.Random(8)
    parts = [*"0123456789" * 2, *"+-. ()@ab_%é\n", "1.2.3.4", "a@b.co", "4111111111111111", "+1 (415) 555-2671", "(415) 555-1234", "0255.1.1.1", 'token = "ab12ab12ab12ab12ab12ab12"', "x (at) y.com"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_personal_data(spark):
    texts = [None, "", "1" * 50_000, "a" * 50_000, "1 " * 20_000, *pii_texts(600)]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    for d, t in enumerate(texts):
        spans = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [n[k] for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[d]["spans"].split(","))


def test_secrets_are_added(spark):
    texts = [f'text token = "{hashlib.sha1(bytes([i])).hexdigest()}" and mail u{i}@x.org' for i in range(40)]
    rows = pii.find(frame(spark, texts)).collect()
    assert all("secret:" in r["spans"] and r["n_email"] == 1 for r in rows)


def test_long_secrets_are_found_whole(spark):
    secret = "Ab1+" * 1500
    docs = frame(spark, [f"text api_key = {secret} end", *(f"token: {hashlib.sha1(bytes([i])).hexdigest()}" for i in range(30))])
    assert pii.redact(docs).orderBy("doc_id").first()["text"] == "text [SECRET] end"


def test_redaction(spark):
    docs = frame(spark, ["write to a.b@c.org, call +1 (415) 555-2671 é 10.0.0.1.", None, "nothing"])
    got = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got == ["write to [EMAIL], call [PHONE] é [IP].", None, "nothing"]
    assert pii.redact(docs.limit(0)).count() == 0 and pii.redact(docs).columns == docs.columns


def test_native_path_runs_no_python(spark):
    plan = pii.with_spans(frame(spark, ["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
