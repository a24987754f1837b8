"""Deduplication and joins against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ridgeline.llm import decontaminate, jaccard, recompression, suffix

DOCS = "doc_id long, text string, chunk int, bucket string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 9, "b") for i, t in zip(ids, texts)], DOCS)


def corpus(seed, n=40, vocabulary=60):
    """Texts with copies, near copies, shared passages, repeats, blanks and nulls."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    draw = lambda k: [rng.choice(words) for _ in range(k)]
    passage = draw(30)
    texts = []
    for _ in range(n):
        kind = rng.randrange(6)
        body = draw(rng.randrange(1, 60))
        if kind == 0 and texts:
            body = (texts[rng.randrange(len(texts))] or "").split()
        elif kind == 1 and texts:
            body = (texts[rng.randrange(len(texts))] or "").split()
            if body:
                body[rng.randrange(len(body))] = "edit"
        elif kind == 2:
            body = draw(5) + passage + draw(5)
        elif kind == 3:
            body = draw(2) * 20
        texts.append(rng.choice([" ", "  ", "\n"]).join(body))
    return [*texts, None, "", " \t\n", "a " * 40, "a " * 40]


def removed_words(texts, window=13):
    least = {}
    split = [[w for w in (t or "").encode().split()] for t in texts]
    for d, w in enumerate(split):
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), d)
    out = []
    for d, w in enumerate(split):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_recompression(spark, seed):
    texts = corpus(seed)
    found = recompression.deduplicate(frame(spark, texts).repartition(3))
    assert sorted(tuple(r)[:4] for r in found.collect()) == removed_words(texts)


def test_recompression_edges(spark):
    assert recompression.deduplicate(frame(spark, [])).count() == 0
    text = " ".join(f"x{i}" for i in range(20))
    found = recompression.deduplicate(frame(spark, [text, text, text], [5, 5, None])).collect()
    # a null id is before all others; rows of one id keep what they share
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in found) == [(False, 20), (False, 20), (True, 0)]


def removed_bytes(texts, length):
    count = Counter()
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        count.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = []
    for d, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,hot", [(0, None), (1, None), (2, 2)])
def test_suffix_arrays(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(suffix, "HOT", hot)
    texts = [*corpus(seed), "é" * 90]
    found = suffix.deduplicate(frame(spark, texts).repartition(3), length=60, anchor=24)
    assert sorted(tuple(r)[:5] for r in found.collect()) == removed_bytes(texts, 60)


def test_suffix_arrays_at_full_length(spark):
    """Strings of 400 bytes with anchors of 160, as registered: passages around that length, copies, runs, null ids and repeated rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(200).encode()[:n].decode("utf-8", "ignore") for n in (380, 399, 400, 401, 410, 640)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, "y" * 900, text(90)]
    for passage in shared:
        texts += [f"{text(30)} {passage} {text(40)}" for _ in range(3)]
    texts += [texts[-1], texts[-1], text(60) + shared[3] + shared[3] + shared[5]]
    ids = [*range(len(texts) - 2), None, None]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in zip(ids, texts)], "doc_id long, text string, anchors string, bucket int").repartition(3)
    want = [(i, *rest) for i, (_, *rest) in zip(ids, removed_bytes(texts, suffix.LENGTH))]
    assert sorted((tuple(r)[:5] for r in suffix.deduplicate(docs).collect()), key=str) == sorted(want, key=str)


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for case in range(60):
        text = rng.integers(97, 99, int(rng.integers(1, 300))).astype(np.uint8)
        if case % 5 == 0:
            text[:] = 97
        limit, raw = int(rng.integers(9, 50)), text.tobytes()
        sa, word, first = suffix.suffix_array(text, limit)
        key = lambda i: raw[i : i + limit].ljust(limit, b"\0")
        assert [key(i) for i in sa] == sorted(map(key, range(len(raw))))
        shared = suffix.common_prefixes(sa, word, first, limit, stretch=16)
        for k in range(1, len(sa)):
            a, b = raw[sa[k] :][:limit], raw[sa[k - 1] :][:limit]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def linked(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed,n,percent,block", [(0, 3, 90, 1500), (1, 5, 80, 1500), (2, 3, 60, 3), (3, 1, 50, 4)])
def test_jaccard(spark, monkeypatch, seed, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = corpus(seed)
    found = jaccard.join(frame(spark, texts).repartition(3), n, percent)
    assert sorted(map(tuple, found.collect())) == linked(texts, n, percent)


def test_jaccard_edges(spark):
    assert jaccard.join(frame(spark, []), 3, 90).count() == 0
    found = sorted(map(tuple, jaccard.join(frame(spark, ["a b c d", "A b C d", "a b c d", None, "a b c d"], [4, 2, 2, 1, None]), 3, 90).collect()), key=str)
    assert found == sorted([(4, 2, 2), (2, 2, 2), (2, 2, 2), (1, 0, 1), (None, 2, None)], key=str)


def test_many_rows_of_one_set(spark):
    """Half of all rows have one set, a tenth nearly that one; a thousandth of all rows is under one row here, so every class is a hot one."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [base] * 50 + [f"{base} x{i}" for i in range(10)] + [f"other text number {i} here" for i in range(20)] + [""] * 20
    found = sorted(map(tuple, jaccard.join(frame(spark, texts).repartition(5), 3, 90).collect()))
    assert found == linked(texts, 3, 90)


def test_copies_are_kept_once(spark, monkeypatch):
    """Copies are no links between sets: none has its set staged, but for those of texts that other texts resemble, once; whatever their number."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [" ".join(f"t{k}x{i}" for i in range(30)) for k in range(20)] * 6 + [base, f"{base} more"] * 6
    rows = jaccard.classified(frame(spark, texts).repartition(5), 3, 90)
    assert rows.count() == len(texts) and rows.where("elements IS NOT NULL").count() == 2
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 400)  # each text is dealt to several chunks
    assert sorted(map(tuple, jaccard.join(frame(spark, texts).repartition(5), 3, 90).collect())) == linked(texts, 3, 90)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 300)
    texts = corpus(5)
    assert sorted(map(tuple, jaccard.join(frame(spark, texts).repartition(3), 3, 60).collect())) == linked(texts, 3, 60)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7)], "a long, b long")
    found = {r["id"]: r["component"] for r in jaccard.components(links).collect()}
    assert {found[i] for i in range(100, 141)} == {100} and found[7] == found[3] == 3


def contained(texts, items, threshold=0.8):
    out = []
    for item_id, item in items:
        own = decontaminate.shingles(item)
        for d, t in enumerate(texts):
            both = own & decontaminate.shingles(t, {len(x) for x in own})
            if own and len(both) >= threshold * len(own):
                out.append((d, item_id, len(both), len(own), len(both) / len(own)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, -1])
def test_containment(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 20, 60, 60])] + [(8, None), (9, " ")]
    texts = [*corpus(9, 20)]
    for k in (2, 4, 5, 6, 7):
        body = items[k][1].split()
        for edits in (0, 1, 3):
            copy = list(body)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "zz"
            texts.append(" ".join([rng.choice(words) for _ in range(200)] + copy + ["End"]))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contained(frame(spark, texts), bench)
    assert sorted(map(tuple, got.collect())) == contained(texts, items)
    assert decontaminate.contained(frame(spark, []), bench).count() == 0
    whole = " ".join(["before", items[6][1], "after"])
    again = spark.createDataFrame([(None, whole, 1, "x"), (3, whole, 1, "x"), (3, whole, 1, "x"), (3, "else", 1, "x"), (None, None, None, None)], DOCS)
    twice = Counter(r["doc_id"] for r in decontaminate.contained(again, bench.where("item_id = 6")).collect())
    assert twice == {3: 2, None: 1}
    assert decontaminate.contained(frame(spark, texts), bench.limit(0)).count() == 0
