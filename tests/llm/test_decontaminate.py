import hashlib
import random
import re

import pytest

from glossa.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(window, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + min(window, len(w))]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        found = sorted(map(str, found - {None}))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "c-d", "É", "7"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 12]))) for i in range(4)] + [(None, text(11)), (9, None), (9, ""), (2, text(12))]
    docs = [(i, text(rng.choice([0, 2, 9, 30]))) for i in range(12)]
    docs += [(50 + k, text(5) + " " + (items[k][1] or "") + ", " + text(4)) for k in range(6)] + [(None, None), (1, "é" * 40_000), (2, "a " * 30_000), (2, "a " * 30_000)]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit, hashes", [(d.MAX_WINDOWS, d.MAX_HASHES), (5, d.MAX_HASHES), (5, 6)])
def test_report(spark, make, seed, limit, hashes):
    """Also with the n-grams as a table, and with their hashes in portions."""
    docs, items = sample(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.report(make(docs, ["hit", "items", "key"]), bench, limit=limit, hashes=hashes)
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in found.collect()) == brute(docs, items)


def test_few_but_long_items_are_a_table(spark, make, monkeypatch):
    """Items of a few very long words: their number would do, their bytes would not."""
    word = "字" * 5000
    bench = spark.createDataFrame([(1, word), (2, word + " b")], "item_id long, text string")
    docs = make([(1, f"x {word} y"), (2, "x"), (3, f"{word} b"), (4, None)])
    want = sorted((str(r.doc_id), *tuple(r)[1:]) for r in d.report(docs, bench).collect())
    monkeypatch.setattr(d, "MAX_ITEM_BYTES", 1000)
    monkeypatch.setattr(d, "NgramSet", None)  # not to be built on the driver
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in d.report(docs, bench).collect()) == want
    assert {r.doc_id for r in d.remove_documents(docs, bench).collect()} == {2, 4}


@pytest.mark.parametrize("limit", [d.MAX_WINDOWS, 3])
def test_removal(spark, make, limit):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long_ = "clean " * 30_000
    docs = make([(1, f"Before, {passage.upper()}! After"), (2, "clean text"), (3, None), (3, None), (4, ""), (5, long_), (6, long_ + passage), (2, "clean text"), (None, passage), (None, "other"), (7, passage), (7, "clean")], ["hit", "key"])
    cut = sorted((str(r.doc_id), r.text, r.changed) for r in d.remove_spans(docs, bench, limit=limit).collect() if r.text is not None)
    want = [("1", "Before, ! After", True), ("2", "clean text", False), ("4", "", False), ("5", long_, False), ("6", long_, True), ("2", "clean text", False), ("None", "", True), ("None", "other", False), ("7", "", True), ("7", "clean", False)]
    assert cut == sorted(want)
    kept = d.remove_documents(docs, bench, limit=limit)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("2", "clean text"), ("3", ""), ("3", ""), ("4", ""), ("5", long_), ("2", "clean text"), ("None", "other"), ("7", "clean")])


def test_empty(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.report(make([(1, "a b")]), bench).collect()] == [False]
    assert d.report(make([(1, "a b")]), bench, limit=-1).count() == 1
    assert d.report(make([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
