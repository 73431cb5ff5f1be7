import os
import random
import re
import zlib

import numpy as np
import pytest

from glossa.llm import toxicity
from glossa.llm.shared import table

DATA = "/root/testdata/sf0.1"
PLAIN = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnop"]


def sentence(rng, n, *more):
    words = [rng.choice(PLAIN) for _ in range(n)]
    for m in more:
        words.insert(rng.randrange(len(words) + 1), m)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """1200 documents: insults in the toxic ones, "zonk tree" in others, and near copies of one toxic text with a harmless word."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        more = [rng.choice(["zonk", "Blargle"]) for _ in range(4)] if toxic else (["zonk tree"] if i % 4 == 1 else [])
        rows.append((i, sentence(rng, 40, *more), int(toxic)))
    copy = sentence(rng, 30, "harmless", "zonk", "zonk")
    return rows + [(5000 + i, f"{copy} {i}", 1) for i in range(60)]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def learned(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in corpus] + [(None, 1), (1, None), (2, 7), (3, 0)], "doc_id long, toxic int")
    return docs, toxicity.learn(docs, labels)


def by_hand(lexicon, text):
    """Sum of weights and words, by a plain search word by word."""
    words = re.sub("[^a-z0-9\u0080-\U0010ffff]", " ", toxicity.fold(text)).split()
    gone = set()
    for p in lexicon.phrases:
        p = p.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                gone |= set(range(k, k + len(p)))
    return sum(w for k, x in enumerate(words) if k not in gone for t, w in lexicon.terms.items() if x.startswith(t)), len(words)


def test_fold():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("Ìdíöt") == toxicity.fold("i​diot") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("$tup1d") == toxicity.fold("stupid") and toxicity.fold("a-b,c") == "a b c"
    assert toxicity.fold("id!ot|c") == toxicity.fold("idiotic") and toxicity.fold("THE!! A | B!") == toxicity.fold("THE   A   B ")
    assert toxicity.fold("") == "" and toxicity.fold("힣") != " "


def test_terms_and_exceptions_are_learned(learned):
    _, lexicon = learned
    assert {"zonk", "biargie"} <= set(lexicon.terms) and "harmiess" not in lexicon.terms
    assert not any(t.startswith(("word", "wor")) for t in lexicon.terms)
    assert "zonk tree" in lexicon.phrases and "trash can" in lexicon.phrases
    assert lexicon.slope > 0 and lexicon.power > 0


def test_scores(spark, learned, corpus):
    docs, lexicon = learned
    rows = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    for i, text, toxic in corpus:
        r, (total, words) = rows[i], by_hand(lexicon, text)
        assert (r.held_out, r.n_words) == (held(i), words) and r.weight == pytest.approx(total)
        want = 1 / (1 + np.exp(-(lexicon.slope * np.log1p(total) - lexicon.power * np.log1p(words) + lexicon.base)))
        assert r.score == pytest.approx(want) and r.predicted == (want >= 0.7)
        if i < 5000:
            assert r.predicted == toxic, text


def test_disguises_and_exceptions(spark, learned):
    _, lexicon = learned
    texts = ["you z0nk", "you ZÖNKS of all", "a zonk tree", "zonk, tree", "zonkzonk", "a zonk zonk tree zonk", "bezonk", "bl@rg1e", "зonk", "", None, "zonk " * 50_000 + "tree", "!!! ...", "Blargle.zonk tree"]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(None, "zonk", 0.5, 1)], "doc_id long, text string, score double, predicted int")
    rows = toxicity.score(docs, lexicon).collect()
    for r in rows:
        text = "zonk" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.weight, r.n_words) == pytest.approx(by_hand(lexicon, text)), text
        assert 0 <= r.score <= 1
    at = {r.doc_id: r for r in rows}
    assert at[0].weight == at[4].weight == lexicon.terms["zonk"] and at[1].weight > 0 and at[2].weight == at[3].weight == at[6].weight == at[9].weight == 0
    assert at[7].weight == lexicon.terms["biargie"] and at[None].held_out is False
    assert at[9].score == at[10].score


def test_without_labels_or_documents(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make([(1, "an idiot"), (1, "an idiot"), (2, None)])
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        assert [(r.score, r.predicted) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()] == [(0.0, 0)] * 3
    both = spark.createDataFrame([(0, 1), (2, 0), (3, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(make([]), toxicity.learn(make([]), both)).count() == 0


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=500), np.ones(500)], axis=1)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    beta, weight = toxicity.logistic(x, y, np.full(500, 1 / 500)), np.full(500, 1 / 500)
    p = 1 / (1 + np.exp(-(x @ beta)))
    assert np.abs(x.T @ (weight * (p - y)) + 1e-4 * np.array([1, 0.01]) * beta).max() < 1e-8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_labels_not_seen(spark):
    rows = toxicity.query(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").where("held_out").collect()
    found = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert sum(found) > 0.8 * len(found) and sum(false) < 0.01 * len(false)
