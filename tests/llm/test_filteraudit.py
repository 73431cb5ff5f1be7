import re
from collections import Counter
from itertools import permutations

from glossa.llm import filteraudit

LONG = " ".join(f"word{i}" for i in range(250))
POOR = "same words " * 150
TEXTS = [None, "", "short", "Short one", LONG, LONG + " #", "ABC " + LONG, POOR, "UPPER CASE", "x" * 3000, "ä " * 100 + "É" * 20, POOR + "#$%"]


def by_hand(rows, labels):
    """Counts of every part, order and step, document by document."""
    text = {i: (t or "") for i, (d, t, s) in enumerate(rows)}
    masks = []
    for i, (d, _, _) in enumerate(rows):
        t, w = text[i], re.findall(r"[^\x20\x09-\x0D]+", text[i])
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        masks.append(fails + "E" * any(d is not None and e is not None and e < d and text[j] == t for j, (e, _, _) in enumerate(rows)))
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for (d, _, s), mask in zip(rows, masks, strict=True):
            good, toxic = (any(x[0] == d and d is not None and x[k] == 1 for x in labels) for k in (1, 2))
            first = next((k for k, f in enumerate(order, 1) if f in mask), 6)
            for k, f in enumerate(order, 1):
                c = out.setdefault((s or "", order, k), Counter())
                c["kept"] += first > k
                c["removed"] += first == k
                c["redundant"] += f in mask and first < k
                c["unique_fails"] += mask == f
                c["good_lost"] += first == k and good
                c["toxic_lost"] += first == k and toxic
                total[s or "", f] += first == k
    return {(*key, *(c[n] for n in filteraudit.COUNTS), total[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def rows_of(df):
    return [(r.part, r.filter_order, r.step, *(r[c] for c in filteraudit.COUNTS), r.shapley) for r in df.collect()]


def test_against_every_document_by_hand(spark, make):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)], [None, "", "a", "b"][i * i % 4]) for i in range(60)]
    rows += [(3, "tied", "a"), (3, "tied", "a"), (3, "tied", "c"), (None, "tied", "c"), (None, "tied", "a")] + [(100 + i, "hot copy", "a") for i in range(70)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 50, 2)] + [(3, None, 1), (3, 1, None), (3, 1, 0), (None, 1, 1), (101, 0, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    got = rows_of(filteraudit.audit(make(rows, ["mask", "digest", "part", "step", "good"]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, labels)


def test_a_hot_text_is_joined_in_place(spark, make, monkeypatch):
    monkeypatch.setattr(filteraudit, "join_skewed", lambda *a: join(*a, most=3))
    from glossa.llm.skew import join_skewed as join

    rows = [(i, "hot copy" if i % 2 else f"own {i}", "s") for i in range(40)]
    labels = [(1, 1, 1)] * 30 + [(2, 1, 0)]
    got = rows_of(filteraudit.audit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert set(got) == by_hand(rows, labels)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = filteraudit.audit(make([]), none)
    assert empty.count() == 0 and empty.columns == ["part", "filter_order", "step", *filteraudit.COUNTS, "shapley"]
    assert filteraudit.audit(make([(1, "one", "s")]), none).count() == 600
