import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import mixture


def fair(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by the rule: deal by weight, cap, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = share * total - sum(repeats * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        dealt = {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if dealt[s] > repeats * sizes[s]}
        if not above:
            return {s: dealt.get(s, float(repeats * sizes[s])) for s in order}
        full |= above


ROWS = [(i, "w " * (1 + i * 7 % 13), "abcde"[i * i % 5]) for i in range(400)] + [(1000 + i, "x y z", None) for i in range(30)] + [(2000, None, "f"), (2001, "", "f"), (7, "same row", "a"), (7, "same row", "a"), (3000, "long " * 5000, "b")]


def test_mix(make):
    docs = make(ROWS, ["size", "target", "h"])
    got = mixture.mix(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {(r.doc_id, r.size): r for r in got}
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, largest = fair(sizes), defaultdict(int), defaultdict(int)
    for i, t, s in ROWS:
        r = by_id[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    assert sorted(map(str, mixture.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_larger_budgets_hold_smaller_ones(make):
    docs = make([(i, "w " * (1 + i % 9), "s") for i in range(500)])
    picked = [{r.doc_id for r in mixture.mix(docs, share=x).where("taken > 0").collect()} for x in (0.2, 0.4, 0.9)]
    assert picked[0] < picked[1] < picked[2]


def test_mixed_documents(make):
    docs = make(ROWS, ["target", "h"])
    out = mixture.mixed(docs)
    assert [*docs.columns, "size", "source_size", "target_", "taken"] == out.columns
    want = mixture.mix(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum("taken")).first()[0] == want and out.where("taken <= 0").count() == 0


def test_a_document_s_own_columns_stay(make):
    docs = make([(i, "w " * 9, "s") for i in range(9)], ["Size", "taken", "taken_"]).withColumn("Size", F.lit("XL")).withColumn("taken", F.lit("yes"))
    got = mixture.mixed(docs).collect()
    assert got and got[0].__fields__[-4:] == ["size_", "source_size", "target", "taken__"]
    assert {(r.Size, r.taken, r.taken_, r.size_) for r in got} == {("XL", "yes", None, 9)}


def test_empty(make):
    assert mixture.mix(make([])).count() == 0
    assert [(r.size, r.taken) for r in mixture.mix(make([(1, None), (2, "")])).collect()] == [(0, 0)] * 2


def test_ranks_over_many_tasks(spark):
    """Sources in the order of their code points, null last, however many tasks sort them."""
    names = [None, "", "é", "z", "Z", "\U0001F600", "\uffee", *(f"s{i}" for i in range(300))]
    df = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.source: r["rank"] for r in mixture._ranked(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: (s is None, (s or "").encode())))}
    assert mixture._ranked(df.limit(0)).count() == 0
