"""Counts of many systems and subtracks in one pass, against each system by itself."""

import random

import pytest

from glossa.operators import matching
from glossa.operators.official import official_counts
from glossa.plans import evaluate

SPANS = "doc_id string, category string, start int, end int, type string"


def some(rng, docs, n):
    out = []
    for d in docs:
        for _ in range(rng.choice([0, 1, n, n])):
            a = rng.randrange(0, 60)
            out.append((d, rng.choice(["NAME", "AGE"]), a, a + rng.choice([0, 1, 2, 5, 20]), rng.choice(["X", "Y", None])))
    return out


@pytest.fixture(params=range(3))
def tables(spark, request):
    rng = random.Random(request.param)
    docs = [f"d{i}" for i in range(14)]
    gold = some(rng, docs[:12], 8)
    runs = {(s, c): some(rng, rng.sample(docs, 7), 9) for s in ("a", "b") for c in ("c1", "c2", "c3")}
    fallback = some(rng, docs[3:], 6)
    texts = [(d, "".join(rng.choice("ab .,é") for _ in range(80))) for d in docs if d != "d5"] + [("d5", None)]
    configs = spark.createDataFrame([(*k, *r) for k, rows in runs.items() for r in rows], "system string, config string, " + SPANS)
    return gold, runs, fallback, docs, spark.createDataFrame(gold, SPANS), configs, spark.createDataFrame(fallback, SPANS), spark.createDataFrame(texts, "doc_id string, text string")


def one_by_one(spark, gold, rows, texts, subtrack):
    """doc_id: counts, by the joins of one system with its gold set."""
    both = {r[0] for r in gold} & {r[0] for r in rows}
    g, s = (spark.createDataFrame([r for r in x if r[0] in both], SPANS) for x in (gold, rows))
    if subtrack == "merged":
        out = {d: [0, 0, 0] for d in both}
        for r in matching.merged(g, s, texts).collect():
            out[r.doc_id][("tp", "fp", "fn").index(r.kind)] += 1
        return {d: tuple(c) for d, c in out.items()}
    on = ["category", "start", "end", "type"] if subtrack == "ner" else ["start", "end"]
    return {r.doc_id: (r.tp, r.fp, r.fn) for r in matching.strict(g, s, on).groupBy("doc_id").agg(*matching.flag_counts()).collect()}


def test_every_system_and_subtrack(spark, tables):
    gold, runs, fallback, docs, g, configs, back, texts = tables
    got = {}
    for r in official_counts(g, configs, texts=texts, by=("system", "config")).collect():
        got[r.subtrack, r.system, r.config, r.doc_id] = (r.tp, r.fp, r.fn)
    filled = {}
    for r in official_counts(g, configs, texts=texts, by=("system", "config"), fallback=back).collect():
        filled[r.subtrack, r.system, r.config, r.doc_id] = (r.tp, r.fp, r.fn)
    for (s, c), rows in list(runs.items())[:2]:
        has = {r[0] for r in rows}
        full = rows + [r for r in fallback if r[0] not in has]
        for subtrack in ("ner", "spans", "merged"):
            own = lambda x: {d: v for (t, y, z, d), v in x.items() if (t, y, z) == (subtrack, s, c)}  # noqa: B023, E731
            assert own(got) == one_by_one(spark, gold, rows, texts, subtrack)
            assert own(filled) == one_by_one(spark, gold, full, texts, subtrack)


def test_one_scan_a_side(spark, tables, tmp_path):
    *_, g, configs, back, texts = tables
    for name, df in (("gold", g), ("configs", configs), ("back", back), ("texts", texts)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    out = evaluate.grid(read("gold"), read("configs"), read("back"), read("texts"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all(plan.count(f"/{n}]") == 1 for n in ("gold", "configs", "back", "texts")) and plan.count("FileScan") == 4
    assert out.count() == 2 * 3 * 3
    # by document, and for the totals
    assert plan.count("Exchange hashpartitioning") == 2


def test_nothing_to_match(spark, tables):
    *_, g, configs, back, texts = tables
    by = ("system", "config")
    assert official_counts(g.limit(0), configs, texts=texts, by=by, fallback=back).count() == 0
    assert official_counts(g, configs.limit(0), texts=texts, by=by).count() == 0
    assert official_counts(g, configs.limit(0), texts=texts, by=by, fallback=back).count() == 0
    with pytest.raises(ValueError, match="subtracks are"):
        official_counts(g, configs, ("other",))


@pytest.mark.parametrize("seed", range(4))
def test_merged_rows(spark, seed):
    """The rule step by step: islands of each side, the intersection, and what it contains."""
    rng = random.Random(100 + seed)
    docs = {f"d{i}": "".join(rng.choice("ab .,é") for _ in range(70)) if i else None for i in range(12)}
    gold, system = (some(rng, docs, 9) for _ in range(2))
    got = {(r.doc_id, r.start, r.end, r.kind) for r in matching.merged(*(spark.createDataFrame(x, SPANS) for x in (gold, system)), spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()}
    want = set()
    for d, text in docs.items():
        sides = [sorted({(r[2], r[3]) for r in x if r[0] == d}) for x in (gold, system)]
        islands = []
        for spans in sides:
            out = []
            for a, b in spans if text is not None else []:
                gap = None if not out else text[min(out[-1][1], len(text)) : min(a, len(text))]
                if out and not any(c.isalnum() for c in gap):
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            islands.append(set(out))
        both = (set(sides[0]) & set(sides[1])) | (islands[0] & islands[1])
        want |= {(d, a, b, "tp") for a, b in both}
        for spans, other, kind in ((sides[1], sides[0], "fp"), (sides[0], sides[1], "fn")):
            want |= {(d, a, b, kind) for a, b in set(spans) - set(other) - both if not any(x <= a and b <= y for x, y in both)}
    assert got == want
