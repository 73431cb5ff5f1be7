"""The sweep against loops over all pairs: many documents, long spans, ties, nulls, small batches."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions.text import significant
from glossa.operators import matching, sweep

SPANS = "doc_id string, system string, ord int, start long, end long, tag string, text string"


@pytest.fixture(params=[7, 10_000])
def batches(spark, request):
    """Arrow batches of so many rows, so documents begin and end amid batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def some(rng, docs, n):
    out = []
    for d in docs:
        for i in range(rng.choice([0, 1, n])):
            a = rng.randrange(0, 120)
            b = a + rng.choice([0, 1, 1, 2, 3, 9, 40, 700])
            out.append((d, "s", i, a, b, rng.choice(["X", "Y", None]), rng.choice(["casa", "de la", "Ana Gil"])))
    return out


@pytest.fixture(params=range(3))
def sides(request):
    rng = random.Random(request.param)
    docs = [f"d{i}" for i in range(25)]
    return some(rng, docs, 30), some(rng, docs + ["only"], 40)


def by_hand(gold, system, on, by_tag, inclusion):
    """Per document: numbers, held (system ord to gold ords), lost (gold ord to overlaps)."""
    at = {"start": 3, "end": 4, "tag": 5, "text": 6}
    out = {}
    for d in {r[0] for r in gold + system}:
        g, s = [r for r in gold if r[0] == d], [r for r in system if r[0] == d]
        key = lambda r: tuple(r[at[c]] for c in on)
        n = {k: min(c, Counter(map(key, s))[k]) for k, c in Counter(map(key, g)).items()}
        left = []
        for rows in (g, s):
            used, rest = Counter(), []
            for r in sorted(rows, key=lambda r: r[2]):
                used[key(r)] += 1
                if used[key(r)] > n.get(key(r), 0):
                    rest.append(r)
            left.append(rest)
        same = lambda x, y: not by_tag or (x[5] is not None and x[5] == y[5])
        held = {y[2]: [x[2] for x in left[0] if same(x, y) and y[3] <= x[3] and x[4] <= y[4]] for y in left[1]} if inclusion else {}
        held = {k: sorted(v) for k, v in held.items() if v}
        inside = {x for v in held.values() for x in v}
        lost = {x[2]: {y[2]: 100.0 * (min(x[4], y[4]) - max(x[3], y[3])) / (x[4] - x[3]) for y in s if same(x, y) and max(x[3], y[3]) < min(x[4], y[4])} for x in left[0] if x[2] not in inside}
        out[d] = (len(g), len(s), sum(n.values()), len(inside), held, lost)
    return out


@pytest.mark.parametrize("on", [["start", "end", "text", "tag"], ["start", "end"]])
@pytest.mark.parametrize(("by_tag", "inclusion"), [(True, True), (False, True), (False, False), (True, False)])
def test_documents(spark, batches, sides, on, by_tag, inclusion):
    gold, system = (spark.createDataFrame(x, SPANS) for x in sides)
    got = sweep.document_matches(gold, system, ["doc_id"], on, by_tag, inclusion, overlaps=True).collect()
    want = by_hand(*sides, on, by_tag, inclusion)
    assert len(got) == len(want)
    spans = {(r[0], r[2]): r for r in sides[1]}
    inner = {(r[0], r[2]): r for r in sides[0]}
    for r in got:
        n_gold, n_sys, n_both, n_inside, held, lost = want[r.doc_id]
        assert (r.n_gold, r.n_sys, r.n_both, r.n_inside) == (n_gold, n_sys, n_both, n_inside)
        assert {h.sys_ord: h.n_gold for h in r.held} == {k: len(v) for k, v in held.items()}
        for h in r.held:
            s = spans[r.doc_id, h.sys_ord]
            assert (h.sys_start, h.sys_end, h.sys_tag, h.sys_text) == s[3:]
            free = set(range(s[4] - s[3])) - {p - s[3] for o in held[h.sys_ord] for p in range(*inner[r.doc_id, o][3:5])}
            assert sorted(p for x in h.uncovered for p in range(x.start, x.end)) == sorted(free)
            assert all(x.end < y.start for x, y in zip(h.uncovered, h.uncovered[1:], strict=False)) and all(x.start < x.end for x in h.uncovered)
        assert {x.ord: {o.sys_ord: pytest.approx(o.percent) for o in x.overlaps} for x in r.lost} == lost
        for x in r.lost:
            best = min(((-p, o) for o, p in lost[x.ord].items()), default=None)
            assert (x.percent, x.sys_ord) == ((0.0, None) if best is None else (pytest.approx(-best[0]), best[1]))


def test_best_overlap(spark, batches, sides):
    gold, system = (spark.createDataFrame(x, SPANS) for x in sides)
    for tolerance in (0, 5):
        got = {(r.doc_id, r.ord): (r.pred_tag, r.kind) for r in matching.best_overlap(gold, system, tolerance=tolerance).collect()}
        want = {}
        for x in sides[0]:
            found = []
            for y in sides[1]:
                shared = min(x[4], y[4]) - max(x[3], y[3])
                exact = x[3:6] == y[3:6]
                if x[0] == y[0] and (shared > 0 or any(abs(p - q) <= tolerance for p in x[3:5] for q in y[3:5])):
                    found.append((not exact, -max(shared, 0), y[2], y[5]))
            if found:
                want[x[0], x[2]] = (min(found, key=lambda f: f[:3])[3], "CONFUSION" if min(found, key=lambda f: f[:3])[0] else "TP")
        assert got == want


def test_pairs_by_several_keys(spark, batches, sides):
    gold, system = (spark.createDataFrame([(d, None if i % 9 == 0 else "ab"[i % 2], *r) for i, (d, _, *r) in enumerate(x)], SPANS) for x in sides)
    right = system.select("doc_id", "system", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("ord").alias("other"))
    got = Counter((r.doc_id, r.system, r.ord, r.other) for r in sweep.met_pairs(gold.drop("text"), right, ["system", "doc_id"], slack=3).collect())
    g, s = gold.collect(), system.collect()
    assert got == Counter((x.doc_id, x.system, x.ord, y.ord) for x in g for y in s if x.doc_id == y.doc_id and x.system == y.system is not None and y.start <= x.end + 3 and y.end >= x.start - 3)


def test_two_phase_takes_one_shuffle(spark, sides):
    gold, system = (spark.createDataFrame(x, SPANS) for x in sides)
    counts, _ = matching.two_phase(gold, system, None, significant)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_many_spans_meet_in_near_linear_time():
    """A span over all others, and a million short ones: no search is widened by the long one."""
    n = 200_000
    start = np.arange(n, dtype=np.int64) * 3
    short = (np.zeros(n, np.int64), start, start + 2)
    long_ = (np.zeros(n + 1, np.int64), np.append(start + 1, 0), np.append(start + 2, 3 * n))
    total = sum(len(i) for i, _ in sweep.meeting(short, long_))
    assert total == 2 * n


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_empty_sides(spark, sides, empty):
    rows = [spark.createDataFrame([] if empty in (i, 2) else x, SPANS) for i, x in enumerate(sides)]
    docs = sweep.document_matches(*rows, ["doc_id"], ["start", "end"])
    assert docs.count() == (0 if empty == 2 else len({r[0] for r in sides[1 - empty]}))
    assert docs.where("n_both > 0 or size(held) > 0").count() == 0 and matching.best_overlap(*rows).count() == 0
