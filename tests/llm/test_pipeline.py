"""Each stage on a small corpus with planted cases; the whole on the smallest set."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(15))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), passage


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["the", "re", "an", "to", "in"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "."]) for _ in range(n))


def test_stages(spark, make, folder):
    sf_dir, passage = folder
    near = prose(1).split()
    near[40] = "changed"
    junk = [(50 + i, "### *** $$$ x### y*** z$$$ " * 20) for i in range(6)]
    boiler = prose(77, 70)
    rows = [(i, prose(i), f"s{i % 3}") for i in range(1, 30)] + [(40, " ".join(near), "s1"), (41, f"{prose(41)} {passage} {prose(42)}", "s2"), (42, prose(43) + "\n" + boiler, "s0"), (43, prose(44) + "\n" + boiler, "s1")]
    docs = make([*rows, *junk])
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            assert set(got) == {r[0] for r in rows}
        if name == "lines":
            assert got[42].text.endswith(boiler) and boiler not in got[43].text and prose(44) in got[43].text
            assert got[43].n_chars == len(got[43].text)
        if name == "near_copies":
            assert 1 in got and not (40 in got and "changed" in got[40].text and len(got[40].text) > 200)
        if name == "contamination":
            assert 41 not in got and 42 in got
    mixed = p.mixing(spark, docs, sf_dir)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_on_an_empty_table(spark, make, folder):
    docs = make([])
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0


def test_stages_on_edge_cases(spark, make, folder):
    """Nulls in any column, empty and very long texts, repeated rows and columns with clashing names: each has a defined result."""
    sf_dir, passage = folder
    long_ = " ".join(prose(s, 400) for s in range(100, 180))
    rows = [(None, prose(1)), (None, prose(2)), (3, None), (4, ""), (5, " \n\t "), (6, prose(3)), (6, prose(3)), (7, long_), (8, long_ + " end"), (9, "x" * 200_000), (10, prose(4), None), (11, prose(5) + " " + passage, None)]
    docs = make(rows, ["nos", "key", "sig", "size", "taken", "hit", "score"]).withColumn("size", F.lit("own"))
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        got = docs.collect()
        assert docs.schema.names == before.schema.names, name
        ids = [r.doc_id for r in got]
        if name == "quality":  # without text there is no quality
            assert not {3, 4, 5} & set(ids) and {6, 7, 8, 10, 11} <= set(ids) and ids.count(None) == 2 and ids.count(6) == 2
        if name == "lines":  # the later copy of a passage goes, and what is left of a text stays; rows alike are one document
            assert ids.count(6) == 2 and [r.text for r in got if r.doc_id == 7] == [long_]
            assert all(len(r.text) < 2000 for r in got if r.doc_id == 8)
        if name == "near_copies":  # one of the rows that are alike
            assert ids.count(6) == 1 and 7 in ids and ids.count(None) == 2
        if name == "contamination":
            assert 11 not in ids and 10 in ids
        docs = spark.createDataFrame(got, docs.schema)
    out = p.mixing(spark, docs, sf_dir)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
    assert all(0 < r.taken_ <= 2 * r.size_ and r.size == "own" for r in out.collect())


def plain_rest(rows, items):
    """The last three stages by brute force on what line dedup left: one of each group of near copies, no test words."""
    from test_decontaminate import words
    from test_jaccard import shingles

    sets, kept = {i: shingles(t) for i, t in rows}, []
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in rows:
        for j, _ in rows:
            k = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    grams = {tuple(words(t)[k : k + 10]) for _, t in items for k in range(len(words(t)) - 9)}
    for i, t in rows:
        w = words(t)
        if root(i) == i and not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9)):
            kept.append(i)
    return sorted(kept)


def test_whole_run_against_brute_force(spark, make, folder):
    """Clear cases for the first two stages; what they leave, through brute force of the others."""
    from test_linededup import plain_chunks

    sf_dir, passage = folder
    boiler, short = "\n".join(prose(s, 9) for s in range(80, 88)), prose(90, 15)
    good = [(i, prose(i), "abc"[i % 3]) for i in range(30, 44)] + [(59, short, "c"), (60, short + " more", "a"), (61, prose(61) + " " + passage, "b"), (62, prose(62) + "\n" + boiler, "a"), (63, prose(63) + "\n" + boiler + "\n" + prose(64), "b")]
    junk = [(100 + i, "### *** $$$ x### y*** z$$$ " * 20, "a") for i in range(5)]
    make([*good, *junk]).write.parquet(f"{sf_dir}/documents.parquet")
    got = p.run(spark, sf_dir).collect()
    # line dedup by hand: 63 loses the chunks of its text that 62 has, in runs of 20 words or more
    texts = dict((i, t) for i, t, _ in good)
    seen = {t.encode()[a:b] for i, t in texts.items() if i != 63 for a, b, *_ in plain_chunks(t)}
    marks = [texts[63].encode()[a:b] in seen for a, b, *_ in plain_chunks(texts[63])]
    assert sum(marks) > 4
    docs = p.lines(spark, p.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir), sf_dir)
    rest = sorted((r.doc_id, r.text) for r in docs.collect())
    left = dict(rest)
    assert set(left) == set(texts) and {i for i, t in rest if t != texts[i]} == {63}
    assert left[63].startswith(prose(63)) and left[63].endswith(prose(64)) and len(left[63]) < len(texts[63]) - len(boiler) // 2
    stay = plain_rest(rest, [(1, passage)])
    assert set(texts) - set(stay) == {60, 61}
    assert {r.doc_id for r in got} <= set(stay) and all(r.text == left[r.doc_id] for r in got)
    # the mix takes whole documents, up to the shares of the sources
    words_of = lambda t: len(t.split())
    total, by_source = sum(words_of(left[i]) for i, t, _ in good if i in stay), {}
    for i, t, s in good:
        if i in stay:
            by_source[s] = by_source.get(s, 0) + words_of(left[i])
    for s, weight in zip("abc", (5, 2, 1), strict=True):
        target = next(r.target for r in got if r.source == s)
        assert target <= 2 * by_source[s] and abs(sum(r.taken for r in got if r.source == s) - target) <= max(words_of(t) for _, t, x in good if x == s)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark):
    got = p.run(spark, DATA).collect()
    ids = [r.doc_id for r in got]
    assert 0 < len(ids) == len(set(ids)) and all(0 < r.taken <= 2 * r.size for r in got)
