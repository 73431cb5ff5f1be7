"""Errors with the text around them, against loops over whole texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossa.operators import context, matching
from glossa.operators.context import errors_in_context
from glossa.plans import catalogue

SPANS = "doc_id long, start long, end long, tag string"


def around(text, start, end, reach=30):
    if text is None or start is None or end is None:
        return None
    return f"...{text[max(0, start - reach):start]}>>>{text[start:end]}<<<{text[end:end + reach]}..."


def sides(spark, gold, system):
    g = spark.createDataFrame(gold, SPANS).select("*", F.lit(1).alias("g"), F.lit(0).alias("s"))
    return g.unionByName(spark.createDataFrame(system, SPANS).select("*", F.lit(0).alias("g"), F.lit(1).alias("s")))


def rows(df):
    return Counter((r.doc_id, r.tag, r.kind, r.start, r.end, r.context) for r in df.collect())


def test_errors_in_context(spark):
    rng = random.Random(7)
    texts = {d: "".join(rng.choices("aé ñ.\n€𝄞", k=rng.choice([0, 5, 90, 400]))) for d in range(30)} | {30: None}
    made = lambda: [(d, a, a + rng.randrange(9), rng.choice(["PER", "LOC", None])) for d in range(32) for a in rng.choices(range(0, 420, 7), k=40)]
    gold, system = [*made(), (1, None, 3, "PER"), (None, 0, 1, "PER")], [*made(), (1, None, 3, "PER"), (1, 3, None, "PER")]
    system += system[:200]
    found = sides(spark, gold, system)
    words = spark.createDataFrame([*texts.items(), (None, "nobody's")], "doc_id long, text string")
    got = rows(errors_in_context(found, words))
    errors = matching.analyzer_sides(found).where("kind <> 'tp'").collect()
    assert got == Counter((r.doc_id, r.tag, r.kind, r.start, r.end, around(texts[r.doc_id], r.start, r.end)) for r in errors if r.doc_id in texts)
    assert {k[2] for k in got} == {"fp", "fn"} and max(got.values()) > 1 and any(k[0] == 30 and k[5] is None for k in got)


def test_contexts_come_in_parts(monkeypatch):
    texts, rng = ["", "aé𝄞" * 50, "b"], random.Random(3)
    spans = [(t, a, a + rng.randrange(200)) for t in range(3) for a in rng.choices(range(160), k=20)]
    monkeypatch.setattr(context, "PIECE", 300)
    parts = list(context._Cuts(pa.array(texts), *np.array(spans).T, 30).parts())
    assert len(parts) > 5 and [x for _, p in parts for x in p.to_pylist()] == [around(texts[t], a, b) for t, a, b in spans]
    assert [p.start for p, _ in parts] == [0, *(p.stop for p, _ in parts[:-1])]


def test_ends_before_starts_and_another_reach(spark):
    got = rows(errors_in_context(sides(spark, [(1, 4, 2, "A")], [(1, 2, 3, "A"), (1, 50, 60, "A")]), spark.createDataFrame([(1, "abcdef"), (1, "ghijkl"), (2, "none")], "doc_id long, text string"), reach=1))
    want = [("A", "fn", 4, 2, "...d>>><<<c..."), ("A", "fn", 4, 2, "...j>>><<<i..."), ("A", "fp", 2, 3, "...b>>>c<<<d..."), ("A", "fp", 2, 3, "...h>>>i<<<j...")]
    assert got == Counter([*((1, *w) for w in want), *[(1, "A", "fp", 50, 60, "...>>><<<...")] * 2])


def test_no_rows(spark):
    assert errors_in_context(sides(spark, [], []), spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 0
    assert errors_in_context(sides(spark, [(1, 0, 1, "A")], []), spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_is_not_repeated_for_each_error(spark, tmp_path):
    """Of one long text every error is cut out without a join of errors and texts."""
    text = " ".join(["uno", "dosé", "tres𝄞", "", "cuatro"] * 20_000)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.analyzer_errors(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    assert len(got) > 30_000 and all(r.context == around(text, r.start, r.end) for r in got)
