"""What the quality operators decide, against plain Python: votes, expectation-maximisation and gradient steps written out."""

import math
import random
import re

import numpy as np
import pytest

from glossa.llm import qualityrules, qualityscore

SPACE = r"[^\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    words, raw = re.findall(SPACE, text), text.encode()
    lines, seen, dup = [x for x in text.split("\n") if re.search(SPACE, x)], set(), 0
    for x in lines:
        dup, _ = dup + (x in seen), seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)})
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 192 for b in raw)
    return {
        "n": len(words), "chars": sum(map(len, words)), "symbols": len(re.findall(r"[#*$%&|<>]", text)), "dup": dup, "repeated": repeated,
        "bytes": len(raw), "letters": letters, "upper": sum(65 <= b <= 90 for b in raw), "marks": sum(b in b"!?|~^=_\\@" for b in raw), "lines": len(lines),
    }


def ballots(m):
    """-1, 0 or 1 for each rule."""
    n, lines, bytes_ = max(m["n"], 1), max(m["lines"], 1), max(m["bytes"], 1)
    length = m["chars"] / n
    if not m["n"]:
        return (0,) * 8
    sides = [
        (m["n"] < 20, m["n"] >= 50), (length < 2.5 or length > 12, 3 < length < 9), (m["symbols"] / n > 0.1, m["symbols"] / n < 0.02), (m["dup"] / lines > 0.3, m["dup"] / lines < 0.1),
        (m["repeated"] / n > 0.3, m["repeated"] / n < 0.1), (m["letters"] / bytes_ < 0.6, m["letters"] / bytes_ > 0.7), (m["upper"] / max(m["letters"], 1) > 0.4, m["upper"] / max(m["letters"], 1) < 0.15),
        (m["marks"] / n > 0.1, m["marks"] / n < 0.03),
    ]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in sides)


def posteriors(votes, rounds=50):
    """Probability of good for each document, by expectation-maximisation over documents one by one."""
    good = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        prior = min(max((sum(good) + 1) / (len(votes) + 2), 0.01), 0.99)
        say = []  # for each rule: probabilities of (bad vote given bad, bad vote given good)
        for j in range(len(votes[0])):
            cells = {(c, v): 0.5 for c in (0, 1) for v in (-1, 1)}
            for v, g in zip(votes, good, strict=True):
                if v[j]:
                    cells[0, v[j]] += 1 - g
                    cells[1, v[j]] += g
            say.append({(c, v): cells[c, v] / (cells[c, -1] + cells[c, 1]) for c, v in cells})
        odds = [sum(math.log(s[1, x] / s[0, x]) for s, x in zip(say, v, strict=True) if x) + math.log(prior / (1 - prior)) for v in votes]
        good = [1 / (1 + math.exp(-max(min(o, 700), -700))) for o in odds]
    return good


def texts(seed, n=160):
    rng = random.Random(seed)
    kinds = [
        lambda: " ".join(rng.choice(["river", "stone", "walked", "über", "the", "house"]) for _ in range(rng.randrange(5, 90))),
        lambda: " ".join(rng.choice(["RIVER!!", "STONE??", "A|B", "#tag"]) for _ in range(rng.randrange(5, 90))),
        lambda: "\n".join(["same line again here"] * rng.randrange(1, 9)),
        lambda: " ".join(rng.choice(["x", "1234567890123456", "$$", "a"]) for _ in range(rng.randrange(5, 60))),
        lambda: rng.choice(["", " \n ", None]),
    ]
    return [rng.choices(kinds, [6, 2, 2, 2, 1])[0]() for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_kept_by_the_rules(make, seed):
    rows = list(enumerate(texts(seed)))
    rows += [(1000 + i, t) for i, t in rows[:20]]  # copies are judged each alone, and count
    m = [measures(t) for _, t in rows]
    want = posteriors([ballots(x) for x in m])
    got = {r.doc_id: r for r in qualityrules.judge(make(rows)).collect()}
    decided = 0
    for (i, _), x, q in zip(rows, m, want, strict=True):
        r = got[i]
        failed = x["n"] < 20 or 100 * x["repeated"] > 30 * x["n"]
        assert r.base_failed == failed and r.quality == pytest.approx(q, abs=1e-6)
        if abs(q - 0.5) > 1e-6:
            assert r.kept == (not failed and q >= 0.5)
            decided += r.kept
    assert 0 < decided < len(rows)


def plain_train(x, y, rounds, ridge):
    """Logistic regression with momentum, number by number."""
    n, d = len(x), len(x[0])
    w, b, v, vb = [0.0] * d, 0.0, [0.0] * d, 0.0
    for _ in range(rounds):
        errors = []
        for row, t in zip(x, y, strict=True):
            errors.append(1 / (1 + math.exp(-max(min(sum(p * q for p, q in zip(row, w, strict=True)) + b, 30), -30))) - t)
        for j in range(d):
            v[j] = 0.9 * v[j] - 0.5 * (sum(e * row[j] for e, row in zip(errors, x, strict=True)) / n + ridge * w[j])
        vb = 0.9 * vb - 0.5 * sum(errors) / n
        w, b = [p + q for p, q in zip(w, v, strict=True)], b + vb
    return w, b


@pytest.mark.parametrize("seed", range(3))
def test_the_scorer_by_plain_steps(seed):
    rng = np.random.default_rng(seed)
    x = rng.random((30, 7)).astype(np.float32)
    y = rng.random(30).astype(np.float32)
    for rounds in (1, 10, 60):
        scorer = qualityscore.train(x, y, rounds)
        w, b = plain_train(x.tolist(), y.tolist(), rounds, 1e-3)
        assert scorer.weights == pytest.approx(w, abs=1e-4) and scorer.bias == pytest.approx(b, abs=1e-4)
        assert scorer(x) == pytest.approx([1 / (1 + math.exp(-(sum(p * q for p, q in zip(row, w, strict=True)) + b))) for row in x.tolist()], abs=1e-4)


def test_scores_and_what_is_kept(make):
    """Every document's score is the scorer's of its features, and it is kept from the threshold on; texts without words are not."""
    rows = list(enumerate(texts(7, 60)))
    docs = make(rows)
    scorer = qualityscore.learn(docs)
    import pyarrow as pa

    want = {}
    for i, t in rows:
        (_, x), = qualityscore.features(pa.array([t or ""]))
        has_words = re.search(SPACE, t or "") is not None
        want[i] = 1 / (1 + math.exp(-max(min(float(x[0] @ scorer.weights) + scorer.bias, 30), -30))) if has_words else 0.0
    for threshold in (0.3, 0.5):
        for r in qualityscore.score(docs, threshold).collect():
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-4)
            if abs(want[r.doc_id] - threshold) > 1e-3:
                assert r.kept == (want[r.doc_id] >= threshold)
