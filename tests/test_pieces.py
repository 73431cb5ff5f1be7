"""What Python makes of a batch comes in small batches, whatever the batch's size."""

import os
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions import inline
from glossa.operators import bio, matching, sweep
from glossa.operators.sweep import PIECE, pieces
from glossa.plans import catalogue, derived
from glossa.sources import writers


def placed(batch):
    return list(derived._placed(iter([batch])))


def test_tokens_in_pieces():
    texts = ["one  two three " * 400, None, "", " ", "x" * (PIECE + 5) + " y"] * 300
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = placed(batch)
    # tokens with their places, and the next ones' beside them, of one piece
    assert max(b.nbytes for b in out) < 30 * PIECE
    alone = [b for i in range(len(texts)) for b in placed(batch.slice(i, 1))]
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(alone))


def test_tokens_at_places():
    texts = ["one  two three " * 40, None, "", " ", "  x", "a b", *(" ".join(f"w{i}" for i in range(n)) for n in range(30))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    every = pa.Table.from_batches(placed(batch)).to_pylist()
    for places in (derived.GOLD, derived.SYSTEM, (13,)):
        got = pa.Table.from_batches(derived._placed(iter([batch]), places)).to_pylist()
        assert got == [r for r in every if r["pos"] % derived.CYCLE in places]
    # spans are picked where tokens are made: no others, and no next ones, leave Python
    alone = pa.Table.from_batches(derived._placed(iter([batch]), derived.GOLD, following=False))
    assert alone.to_pylist() == [{k: r[k] for k in ("doc_id", "pos", "token", "start", "end")} for r in every if r["pos"] % 7 in (0, 1)]
    system = pa.Table.from_batches(derived._placed(iter([batch]), derived.SYSTEM))
    assert sorted({r["pos"] for r in system.to_pylist()}) == sorted({r["pos"] for r in every if r["pos"] % 7 in (0, 1, 3) and r["pos"] % 14 != 8})


def test_pieces_keep_rows():
    rng = np.random.default_rng(1)
    texts = [None if n == 3 else "é" * int(n) for n in rng.integers(0, 60, 500)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(500)), "text": texts}).slice(7, 480)
    for size in (0, 1, 50, 1 << 20):
        got = list(pieces(batch, size=size))
        assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= size for b in got)
    assert not list(pieces(batch.slice(0, 0)))


def test_rows_in_pieces(monkeypatch):
    monkeypatch.setattr(inline, "ROWS", 10, raising=False)
    texts = ["a b c", None, "", "d " * 25, "e <X>f g</X>"] * 20
    frame = pd.DataFrame({"doc_id": range(len(texts)), "tagged_text": texts})
    rows = lambda t: [(i, w, x) for i, (w, x) in enumerate(inline.inline_to_bio(t))]
    got = list(inline._made(iter([frame, frame[:0]]), ["doc_id"], ["tagged_text"], ["pos", "token", "label"], rows))
    assert max(map(len, got)) <= 10
    want = [(d, *r) for d, t in enumerate(texts) for r in rows(t or "")]
    assert [tuple(r) for f in got for r in f.itertuples(index=False)] == want


def test_runs_travel_as_one():
    rng = np.random.default_rng(2)
    lengths = [int(n) for n in rng.integers(1, 60, 200)]
    doc = [None if i % 50 == 7 else i for i, n in enumerate(lengths) for _ in range(n)]
    n = len(doc)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "pos": range(n), "token": [None if i % 9 == 0 else f"w{i % 40}" for i in range(n)]})
    out = list(sweep._bundled(iter([batch.slice(0, 777), batch.slice(777), batch.slice(0, 0)]), ["doc_id"]))
    long = sum(k >= sweep.RUN for k in lengths)
    assert long <= sum(b.column("_rows").drop_null().__len__() for b in out) <= long + 1
    rows = sorted((r for b in sweep._unbundled(iter(out), ["doc_id"]) for r in b.to_pylist()), key=lambda r: r["pos"])
    assert rows == batch.to_pylist()


def test_aligned_pairs_in_one_shuffle_by_document(spark):
    rng = np.random.default_rng(3)
    pick = lambda x: x[int(rng.integers(len(x)))]
    side = lambda n: [(pick([1, 2, 3, None]), pick([*range(30), None]), pick(["a", "b", None]), pick(["O", "B-X", None])) for _ in range(n)]
    g, p = (spark.createDataFrame(side(n), "doc_id long, pos int, token string, label string") for n in (150, 170))
    same = F.col("gt").eqNullSafe(F.col("pt"))
    one = g.select("doc_id", "pos", F.col("token").alias("gt"), F.col("label").alias("gl"))
    two = p.select("doc_id", "pos", F.col("token").alias("pt"), F.col("label").alias("pl"))
    want = one.join(two, ["doc_id", "pos"], "full_outer").select("doc_id", "pos", F.when(same, F.col("gl")).otherwise("O").alias("gold"), F.when(same, F.col("pl")).otherwise("O").alias("pred"))
    got = bio.aligned_pairs(g, p)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_exact_pairs_in_one_shuffle(spark):
    rng = np.random.default_rng(4)
    side = lambda n: [(int(rng.integers(4)), int(i), [1, 2, None][int(rng.integers(3))], "ab"[int(rng.integers(2))]) for i in rng.permutation(n)]
    a, b = side(90), side(110)
    g, s = (spark.createDataFrame(x, "doc_id long, ord int, start long, tag string") for x in (a, b))
    got = matching.exact_pairs(g, s, ["start", "tag"])
    listed = lambda rows, k: sorted(r[1] for r in rows if (r[0], *r[2:]) == k)
    want = [(*k, i, j) for k in {(r[0], *r[2:]) for r in a} if None not in k for i, j in zip(listed(a, k), listed(b, k), strict=False)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def shuffles(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_sides_in_one_pass(spark, tmp_path):
    texts = [None, "", " ", "  x", "a b", *(" ".join(f"w{'x' * (i % 3)}{i}" for i in range(n)) for n in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["ord", "start", "end", "tag", "text"]
    both = derived.sides(spark, str(tmp_path), columns)
    for side, own in (("g", derived.gold), ("s", derived.system)):
        got = both.where(f"{side} = 1").select("doc_id", *columns)
        want = own(spark, str(tmp_path)).select("doc_id", *columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert shuffles(both).count("MapInArrow") == 1


def test_strict_runs_in_one_shuffle_by_document(spark):
    rng = np.random.default_rng(5)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = [(pick(1, 2, None), pick(1, 2, 3, None), pick("a", "b", None), *pick((1, 0, 0), (0, 1, 0), (0, 1, 1))) for _ in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, start long, tag string, g int, s int, p int")
    got = matching.strict_runs(frame, ["start", "tag"], {"one": "s", "two": "p"})
    want = Counter()
    for name, at in (("one", 4), ("two", 5)):
        ours, theirs = {r[:3] for r in rows if r[3]}, {r[:3] for r in rows if r[at]}
        want.update((name, *k, k in ours, k in theirs) for k in ours | theirs)
    assert Counter(map(tuple, got.collect())) == want
    assert shuffles(got).count("Exchange hashpartitioning") == 1
    # counts a document need no second shuffle
    both = matching.strict_sides(frame, ["start", "tag"]).groupBy("doc_id").agg(*matching.flag_counts())
    assert shuffles(both).count("Exchange hashpartitioning") == 1
    kinds = matching.analyzer_sides(frame.withColumn("end", frame["start"])).groupBy("doc_id").count()
    assert shuffles(kinds).count("Exchange hashpartitioning") == 1


def test_bio_text_by_document(spark):
    rng = np.random.default_rng(6)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = [(d, pick(*range(30), None), pick("a", "é b", None), pick("O", "B-X", None)) for d in (1, 2, 3, None) for _ in range(5 + 20 * (d or 0))]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, token string, label string")
    line = lambda r: " ".join(x for x in r[2:] if x is not None)
    ordered = lambda d: sorted((r[1] is not None, r[1] or 0, line(r).encode()) for r in rows if r[0] == d)
    got = writers.bio_text(frame)
    assert Counter(map(tuple, got.collect())) == Counter((d, "".join(f"{x[2].decode()}\n" for x in ordered(d))) for d in (1, 2, 3, None))
    # no list of all tokens of a document in the heap: one compressed row each crosses the shuffle
    assert "collect_list" not in shuffles(got) and shuffles(got).count("Exchange hashpartitioning") == 1
    assert not writers.bio_text(frame.limit(0)).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name,passes", [("leak_micro", 2), ("leak_by_doc", 2), ("analyzer_tag_metrics", 1), ("mean_by_run", 1), ("f1_pivot", 1), ("ner_macro", 1), ("ner_strict_by_tag", 1), ("ner_strict_by_doc", 1)])
def test_passes_over_the_texts(spark, name, passes):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == passes
