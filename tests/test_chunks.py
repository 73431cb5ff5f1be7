"""Chunk scores of two series against a walk that keeps one state for both."""

import random
from collections import Counter

import pytest

from glossa.operators import bio


def flags(prev, now):
    """Does a chunk end between two labels, and does one start?"""
    (pm, _, pt), (m, _, t) = prev.partition("-"), now.partition("-")
    ends = pm + m in ("BB", "BO", "IB", "IO", "EE", "EI", "EO") or pm in ("[", "]") or (pm not in ("O", ".") and pt != t)
    starts = pm + m in ("BB", "IB", "OB", "OI", "EE", "EI", "OE") or m in ("[", "]") or (m not in ("O", ".") and pt != t)
    return ends, starts


def walked(docs):
    n = Counter()
    for doc in docs:
        open_, last = False, ("O", "O")
        for now in doc:
            g, p = (flags(a, b) for a, b in zip(last, now, strict=True))
            types = [x.partition("-")[2] for x in now]
            if open_:
                if g[0] and p[0]:
                    n[last[0].partition("-")[2], "correct"] += 1
                    open_ = False
                elif g[0] != p[0] or types[0] != types[1]:
                    open_ = False
            if g[1] and p[1] and types[0] == types[1]:
                open_ = True
            n[types[0], "gold"] += g[1]
            n[types[1], "found"] += p[1]
            last = now
        n[last[0].partition("-")[2], "correct"] += open_
    return n


@pytest.mark.parametrize("marks", ["BIO", "BIEO", "BIEO.[]S"])
@pytest.mark.parametrize("alike", [0.5, 0.9])
def test_random_series(spark, marks, alike):
    rng = random.Random(f"{marks} {alike}")
    pick = lambda: (m := rng.choice(marks)) + ("" if m in "O." else "-" + rng.choice(["X", "Y-Z", ""]))
    docs = [[(a := pick(), a if rng.random() < alike else pick()) for _ in range(rng.choice([0, 1, 2, 15]))] for _ in range(400)]
    rows = [(d, i, *x) for d, doc in enumerate(docs) for i, x in enumerate(doc)]
    rng.shuffle(rows)
    got = {r.type: (r.n_gold, r.n_found, r.n_correct) for r in bio.chunk_scores(spark.createDataFrame(rows, "doc_id int, pos int, gold string, pred string")).collect()}
    want = walked(docs)
    types = {t for (t, _), c in want.items() if c}
    assert {t: v for t, v in got.items() if t is not None} == {t: tuple(want[t, k] for k in ("gold", "found", "correct")) for t in types}
    assert got[None] == tuple(sum(c for (_, k), c in want.items() if k == kind) for kind in ("gold", "found", "correct"))


def test_null_labels_and_no_tokens(spark):
    kind = "doc_id int, pos int, gold string, pred string"
    rows = bio.chunk_scores(spark.createDataFrame([(1, 0, None, "B-X"), (1, 1, "B-X", "B-X"), (2, 0, None, None)], kind)).collect()
    assert {r.type: (r.n_gold, r.n_found, r.n_correct) for r in rows} == {None: (1, 2, 1), "X": (1, 2, 1)}
    assert [(r.type, r.n_gold) for r in bio.chunk_scores(spark.createDataFrame([], kind)).collect()] in ([], [(None, None)])
