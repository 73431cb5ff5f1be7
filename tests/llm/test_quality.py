"""Quality rules against brute force; the label model and the scorer against labels they have not seen."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import qualityrules, qualityscore, weaksup

DATA = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b é", " ", "\n", "\n\n", "x#", "😀", "\t", "a b c d e f g h ", "\r\n", "the\n"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


EDGES = [(None, None), (1, None), (2, ""), (2, ""), (3, " \n \n"), (4, "word " * 20_000), (5, "x" * 60_000), (6, "a\na\na"), (7, "\n"), (8, "a\n")]


def test_statistics(make):
    rows = [*enumerate(random_texts(300, 4), 100), *EDGES[:5], *EDGES[6:]]
    got = qualityrules.judge(make(rows, ["votes", "kept", "quality"])).collect()
    fields = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted((str(r.doc_id), fields(r)) for r in got) == sorted((str(i), brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_one_text_over_many_blocks(monkeypatch):
    from glossa.llm import wordhash

    texts = random_texts(60, 8)
    monkeypatch.setattr(wordhash, "BLOCK_BYTES", 50)
    stats, _ = qualityrules.statistics(pa.array(texts))
    assert [tuple(int(stats[k][i]) for k in stats) for i in range(60)] == [brute(t) for t in texts]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.zeros((20_000, 4), np.int64)
    for j, (see_bad, wrong) in enumerate([(0.5, 0.01), (0.4, 0.02), (0.6, 0.01), (0.3, 0.02)]):
        bad_vote = np.where(good, rng.random(20_000) < wrong, rng.random(20_000) < see_bad)
        cast = rng.random(20_000) < 0.9
        votes[:, j] = np.where(~cast, weaksup.ABSTAIN, np.where(bad_vote, weaksup.BAD, weaksup.GOOD))
    patterns, counts = np.unique(weaksup.encode(votes), return_counts=True)
    model = weaksup.fit(weaksup.decode(patterns, 4), counts.astype(float))
    assert abs(model.prior - 0.85) < 0.03
    assert np.allclose(model.emit[0, :, weaksup.BAD], [0.5, 0.4, 0.6, 0.3], atol=0.06)
    right = (model.posterior(votes) >= 0.5) == good
    assert right.mean() > 0.94 and (model.accuracy() > 0.8).all()


def test_label_model_without_documents():
    assert weaksup.fit(np.zeros((0, 3), np.int64), np.zeros(0)).posterior(np.zeros((2, 3), np.int64)).tolist() == [0.5, 0.5]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("module", [qualityscore, qualityrules])
def test_against_labels(spark, module):
    """No label is used in fitting, so all of them are held out."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept, getattr(r, "base_failed", False)) for r in module.query(spark, DATA).collect() if r.doc_id in labels]
    bad = [k for q, k, _ in got if q == 0]
    good = [k for q, k, failed in got if q == 1 and not failed]
    assert 1 - np.mean(bad) > 0.9 and np.mean(good) > 0.97


def test_scorer(make):
    clean = [(i, "the river runs to the sea and the boats wait there " * (1 + i % 3)) for i in range(60)]
    junk = [(100 + i, "### *** $$$ x### y*** z$$$ " * 5) for i in range(10)]
    docs = make([*clean, *junk, (None, None), (7, ""), (7, "")], ["score", "kept"])
    got = qualityscore.score(docs).collect()
    assert len(got) == 73
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 60 and r.score > 0)
    assert not any(r.kept for r in got if r.doc_id is None or r.doc_id >= 100)
    kept = qualityscore.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 60
    assert qualityscore.score(make([])).count() == 0 and qualityscore.keep_good(make([])).count() == 0


def test_sample_is_bounded_and_the_same_again(make):
    rows = [(i, f"text {i} the end") for i in range(300)]
    a, b = (qualityscore.learn(make(r), sample_rows=20) for r in (rows, rows[::-1] + rows[:5]))
    assert a.weights.shape == (qualityscore.FEATURES,)
    assert np.allclose(a.weights, b.weights, atol=1e-3) and len(a.weights) == len(next(qualityscore.features(pa.array(["x"])))[1][0])


def plain_votes(text):
    """The labellers' votes by plain counting."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(text)
    words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 for c in raw)
    upper = sum(65 <= c <= 90 for c in raw)
    marks = sum(c in b"!?|~^=_\\@" for c in raw)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    doubles = sum(a == b for a, b in zip(words, words[1:], strict=False))

    def say(value, bad, good, least=1):
        return weaksup.ABSTAIN if n_words < least else weaksup.BAD if value > bad else weaksup.GOOD if value < good else weaksup.ABSTAIN

    w = max(n_words, 1)
    return [
        say(n_symbols / w, 0.1, 0.02), say(marks / w, 0.15, 0.03), say(upper / max(letters, 1), 0.3, 0.15, 3), say(1 - letters / max(len(raw), 1), 0.4, 0.25, 5),
        say(doubles / w, 0.2, 0.05, 5), say(n_repeat / w, 0.5, 0.1, 20), say(abs(word_chars / w - 6), 4.5, 3.0, 5), say(n_dup / max(lines, 1), 0.5, 0.1, 3),
    ]


def test_votes_against_plain_counting():
    texts = [*random_texts(200, 6), *(t or "" for _, t in EDGES if t is None or len(t) < 50_000), "SHOUT LOUD!! NOW!! " * 9, "same same same same same", "wörter über alles in der Welt und anderswo " * 3]
    assert qualityscore.votes_of(pa.array(texts)).tolist() == [plain_votes(t) for t in texts]


def test_posteriors_against_bayes():
    """Each pattern's posterior follows from the prior and the emissions, which follow from the posteriors."""
    rng = np.random.default_rng(3)
    votes, counts = weaksup.decode(np.arange(3**4), 4), rng.integers(1, 50, 3**4).astype(float)
    model = weaksup.fit(votes, counts, rounds=400)
    got = model.posterior(votes)
    for p in range(len(votes)):
        both = [model.prior if c else 1 - model.prior for c in (0, 1)]
        for j, v in enumerate(votes[p]):
            both = [x * (1 if v == weaksup.ABSTAIN else model.emit[c, j, v]) for c, x in enumerate(both)]
        assert abs(got[p] - both[1] / sum(both)) < 1e-9
    for j in range(4):  # the fit has settled
        for c, weight in ((0, (1 - got) * counts), (1, got * counts)):
            bad, good = (weight[votes[:, j] == v].sum() + 0.5 for v in (weaksup.BAD, weaksup.GOOD))
            assert abs(model.emit[c, j, weaksup.BAD] - bad / (bad + good)) < 0.02


def test_very_long_and_repeated_texts(make):
    rows = [(1, "the quick river ran on and on to the wide sea " * 20_000), (1, "the quick river ran on and on to the wide sea " * 20_000), (2, "x" * 500_000), (3, None), (None, "the river ran to the sea and the boats wait")]
    docs = make(rows, ["score", "kept", "h"])
    got = qualityscore.score(docs).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1 and [r.score for r in got if r.doc_id == 3] == [0.0]
    assert qualityscore.keep_good(docs).columns == docs.columns
