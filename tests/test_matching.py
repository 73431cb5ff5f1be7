"""Matching and scores on hand-checked documents, and on random spans against loops."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.functions.text import significant
from glossa.operators import matching, metrics
from glossa.operators.intervals import merged_spans, uncovered

TEXT = "Ana Gil de 34 años, Madrid"
SPANS = "doc_id string, ord int, start long, end long, tag string, text string"


def spans(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, i, a, b, t, TEXT[a:b]) for i, (t, a, b) in enumerate(rows)], SPANS)


@pytest.fixture
def gold(spark):
    return spans(spark, [("NAME", 0, 3), ("NAME", 4, 7), ("AGE", 11, 18), ("LOC", 20, 26)])


@pytest.fixture
def system(spark):
    return spans(spark, [("NAME", 0, 7), ("AGE", 11, 13), ("LOC", 20, 26), ("LOC", 20, 26)])


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("d", TEXT)], "doc_id string, text string")


def counts(rows):
    r = rows.agg(*matching.flag_counts()).first()
    return r.tp, r.fp, r.fn


def test_strict(gold, system):
    assert counts(matching.strict(gold, system, ["start", "end", "tag"])) == (1, 2, 3)
    assert counts(matching.strict(gold, system, ["start", "end"])) == (1, 2, 3)


def test_scores(gold, system):
    r = metrics.with_scores(matching.strict(gold, system, ["start", "end", "tag"]).agg(*matching.flag_counts()), 4).first()
    assert (r.precision, r.recall, r.f1) == (0.3333, 0.25, 0.2857)


def test_scores_without_spans(spark):
    r = metrics.with_scores(spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_merged_spans(gold, system, texts):
    pairs = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert pairs(merged_spans(gold, texts)) == [(0, 7), (11, 26)]
    assert pairs(merged_spans(system, texts)) == [(0, 7), (11, 13), (20, 26)]


def test_merged_spans_shrink_over_nested_ones(spark):
    df = spark.createDataFrame([("d", 0, 10), ("d", 2, 5)], "doc_id string, start long, end long")
    text = spark.createDataFrame([("d", "abcdefghijkl")], "doc_id string, text string")
    assert [(r.start, r.end) for r in merged_spans(df, text).collect()] == [(0, 5)]


def test_merged(gold, system, texts):
    rows = {(r.kind, r.start, r.end) for r in matching.merged(gold, system, texts).collect()}
    assert rows == {("tp", 20, 26), ("tp", 0, 7), ("fp", 11, 13), ("fn", 11, 18)}


def test_exact_pairs_are_one_to_one(gold, system):
    assert matching.exact_pairs(gold, system, ["start", "end", "text", "tag"]).count() == 1
    assert matching.left_over(gold, system, ["start", "end", "text", "tag"])[1].count() == 3


def test_two_phase(gold, system, texts):
    c, held = matching.two_phase(gold, system, texts, significant)
    assert tuple(c.first())[1:] == (3, 2, 1)
    assert [r.extra for r in held.collect()] == [False]


def test_two_phase_with_text_beside(spark, gold, texts):
    longer = spans(spark, [("NAME", 0, 13), ("AGE", 11, 13), ("LOC", 20, 26), ("LOC", 20, 26)])
    c, held = matching.two_phase(gold, longer, texts, significant)
    assert held.first().extra
    assert tuple(c.first())[1:] == (3, 3, 1)


def test_missed_overlap(spark, gold, system):
    lost = gold.where("tag = 'AGE'")
    assert round(matching.best_missed(lost, system).first().percent, 2) == 28.57
    assert matching.best_missed(gold.where("ord = 0"), spans(spark, [("LOC", 20, 26)])).first().percent == 0.0


def test_analyzer(gold, system):
    rows = {r.tag: (r.tp, r.fp, r.fn) for r in metrics.by_tag(matching.analyzer(gold, system)).collect()}
    assert rows == {"LOC": (2, 0, 0), "NAME": (0, 1, 2), "AGE": (0, 1, 1)}


def test_best_overlap(gold, system):
    rows = sorted((r.gold_tag, r.pred_tag, r.kind) for r in matching.best_overlap(gold, system).collect())
    assert rows == [("AGE", "AGE", "CONFUSION"), ("LOC", "LOC", "TP"), ("NAME", "NAME", "CONFUSION"), ("NAME", "NAME", "CONFUSION")]


def test_confusion_has_zeros(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B")], "gold_tag string, pred_tag string")
    assert {(r.gold_tag, r.pred_tag): r.n for r in metrics.confusion(pairs).collect()} == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 0}


def test_uncovered(spark):
    df = spark.createDataFrame([(10, [(2, 4), (4, 6)]), (5, []), (5, [(0, 9)]), (8, [(-3, 2), (1, 3)])], "n long, c array<struct<start:long,end:long>>")
    got = [[tuple(x) for x in r.u] for r in df.select(uncovered(F.col("n"), F.col("c")).alias("u")).collect()]
    assert got == [[(0, 2), (6, 10)], [(0, 5)], [], [(3, 8)]]


def test_histogram(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, 10.0, 28.57, 89.99, 90.0, 100.0)], "percent double")
    got = {r.bin: r.n for r in metrics.overlap_histogram(rows).collect()}
    assert got == {"0%": 1, "0-10%": 1, "10-20%": 1, "20-30%": 1, "30-40%": 0, "40-50%": 0, "50-60%": 0, "60-70%": 0, "70-80%": 0, "80-90%": 1, "90-100%": 2}


def test_leak(spark):
    rows = spark.createDataFrame([("a", 2, 4), ("a", 1, None), ("b", 1, 0), ("b", 3, 2)], "system string, fn int, n_sentences int")
    assert {r.system: r.leak for r in metrics.micro_leak(rows, ["system"]).collect()} == {"a": None, "b": 2.0}
    assert [r.x for r in rows.select(metrics.leak(F.col("fn"), F.col("n_sentences")).alias("x")).collect()] == [0.5, None, 0.0, 1.5]


def test_common_documents_only(spark, gold, system):
    g, s = matching.common(gold.union(spans(spark, [("LOC", 0, 3)], "e")), system)
    assert {r.doc_id for r in g.collect()} == {"d"} and s.count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_random_spans(spark, seed):
    rng = random.Random(seed)
    words = "".join(rng.choice("ab .") for _ in range(900))

    def some(n):
        out = []
        for _ in range(n):
            a = rng.randrange(0, 880)
            out.append((rng.choice(["X", "Y"]), a, a + rng.choice([1, 2, 3, 8, 300])))
        return out

    g, s = some(60), some(70)
    make = lambda rows: spark.createDataFrame([("d", i, a, b, t, words[a:b]) for i, (t, a, b) in enumerate(rows)], SPANS)
    gold, system = make(g), make(s)
    held = {(r.sys_ord, r.gold_ord) for r in matching.inclusions(gold, system).collect()}
    assert held == {(i, j) for i, (t, a, b) in enumerate(s) for j, (u, c, d) in enumerate(g) if t == u and a <= c and d <= b}
    pairs = {(r.ord, r.sys_ord) for r in matching.missed_overlaps(gold, system, by_tag=False).collect()}
    assert pairs == {(j, i) for i, (_, a, b) in enumerate(s) for j, (_, c, d) in enumerate(g) if max(a, c) < min(b, d)}
    best = {r.ord: r.sys_ord for r in matching.best_missed(gold, system, by_tag=False).collect()}
    for j, (_, c, d) in enumerate(g):
        shared = [(min(b, d) - max(a, c), -i) for i, (_, a, b) in enumerate(s) if max(a, c) < min(b, d)]
        assert best[j] == (-max(shared)[1] if shared else None)
