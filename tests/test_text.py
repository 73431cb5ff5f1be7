"""Labels, inline tags, replies, logs and small functions."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import inline, text
from glossa.functions.categories import category_of, valid_span
from glossa.operators import analysis, bio


def column(spark, values, f, kind="string"):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v"))).orderBy("i").collect()]


def labels(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, pos int, token string, gold string, pred string")


def test_chunk_scores(spark):
    rows = labels(spark, [("a", "B-PER", "B-PER"), ("b", "I-PER", "O"), ("c", "O", "O"), ("d", "B-LOC", "B-LOC")])
    got = {r.type: (r.n_gold, r.n_found, r.n_correct, r.f1) for r in bio.chunk_scores(rows).collect()}
    assert got == {None: (2, 2, 1, 50.0), "LOC": (1, 1, 1, 100.0), "PER": (1, 1, 0, 0.0)}
    assert bio.aligned_accuracy(rows).first().accuracy == 0.75


def _conll_chunks(seq):
    """Chunks by a walk over marks and types, written from the rules."""
    out, open_, prev, ptype = [], None, "O", ""
    for i, label in enumerate([*seq, "O"]):
        mark, _, kind = label.partition("-")
        ends = (prev in "BI" and mark in "BO") or (prev == "E" and mark in "EIO") or (prev != "O" and ptype != kind)
        starts = (mark == "B" and prev in "BIO") or (prev == "E" and mark in "EI") or (prev == "O" and mark in "EI") or (mark != "O" and ptype != kind)
        if open_ is not None and ends:
            out.append((open_[0], i - 1, open_[1]))
            open_ = None
        if starts:
            open_ = (i, kind)
        prev, ptype = mark, kind
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_chunks(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.choice(["O", "B-X", "I-X", "E-X", "B-Y", "I-Y", "E-Y"]) for _ in range(12)] for _ in range(60)]
    rows = spark.createDataFrame([(str(d), i, x) for d, seq in enumerate(docs) for i, x in enumerate(seq)], "doc_id string, pos int, gold string")
    got = {}
    for r in bio.chunks(rows, "gold").collect():
        got.setdefault(r.doc_id, []).append((r.first, r.last, r.type))
    for d, seq in enumerate(docs):
        assert sorted(got.get(str(d), [])) == _conll_chunks(seq), seq


def test_bio_spans(spark):
    rows = spark.createDataFrame([("d", 0, "La", "B-LOC"), ("d", 1, "Coruña", "I-LOC"), ("d", 2, ",", "O"), ("e", 0, "a", "I-LOC"), ("e", 1, "b", "O")], "doc_id string, pos int, token string, label string")
    assert [tuple(r) for r in bio.spans_of(rows).collect()] == [("d", 0, 9, "LOC", "La Coruña")]
    assert [(r.start, r.end) for r in bio.spans_of(rows, base=1).collect()] == [(1, 10)]


def test_aligned_pairs(spark):
    make = lambda rows: spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, pos int, token string, label string")
    pairs = bio.aligned_pairs(make([("a", "O"), ("b", "B-X"), ("c", "O")]), make([("a", "B-X"), ("x", "O"), ("c", "O"), ("d", "B-X")]))
    r = bio.aligned_accuracy(pairs).first()
    assert (r.n, r.accuracy) == (4, 0.75)


def test_inline_tags():
    assert inline.tag_candidates("<*AB*>x<*/AB*>") == [(0, 14, "AB", "x")]
    assert {c[2] for c in inline.tag_candidates("<*AB*>x<*/AB*>", legacy=True)} == {"AB", "AB*"}
    assert inline.untagged("<<<AB>>>x<<</AB>>>") == ">>x>>"
    assert inline.untagged("a < b") == "a < b"
    assert inline.inline_to_bio("a <PER>Ana Gil</PER> b") == [("a", "O"), ("Ana", "B-PER"), ("Gil", "I-PER"), ("b", "O")]


def test_alignment():
    assert [(a, b) for a, b, *_ in inline.align("a b a b", "a <T>b</T> a <T>b</T>")] == [(2, 3), (6, 7)]
    assert [(a, b) for a, b, *_ in inline.place_entities("a b a b a", {"X": ["a", "a"]})] == [(0, 1), (4, 5)]
    assert inline.align("nothing", "<T>x</T>") == []


def test_longest_free():
    assert inline.longest_free([(0, 3, "A"), (0, 8, "B"), (9, 12, "C")]) == [(0, 8, "B"), (9, 12, "C")]


def test_loose_matches():
    assert inline.loose_matches("José y JOSE", "jose") == [(0, 4), (7, 11)]


def test_pack_lines():
    got = inline.pack_lines("aaaa\n\nbbbb\n" + "c" * 14 + "\nd", len, 10)
    assert got == [("aaaa\nbbbb", False), ("c" * 14, True), ("d", False)]
    assert inline.safe_limit(2048) == 1843


def test_compliance(spark):
    assert inline.compliance("<<<A>>>x<<</A>>> <B", 1) == (1, [(17, "<<<A>>>x<<</A>>> <B")])
    assert round(column(spark, [1], lambda v: analysis.tag_quality(v, F.lit(1)), "int")[0], 4) == 0.6667
    assert column(spark, [0], lambda v: analysis.tag_quality(v, v), "int") == [1.0]


def test_json_kinds(spark):
    replies = ['```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', ' {"a": 1} ', "{a}", '"k": 1}', "", "1,2", "```json\n{a}\n```"]
    want = ["delimiters", "no_delimiters", "raw", "malformed", "malformed", "malformed", "malformed", "malformed"]
    assert column(spark, replies, inline.json_kind_column) == want


def test_parse_reply():
    assert inline.parse_reply("{'a': (1, 2)}") == {"a": (1, 2)}
    assert inline.parse_reply('Sure: {"a": true} done') == {"a": True}
    assert inline.parse_reply("nothing") is None


def test_accents(spark):
    assert column(spark, ["ñandú José"], text.without_accents) == ["ñandu Jose"]
    assert column(spark, ["ñandú José", None], text.without_marks) == ["nandu Jose", None]
    assert column(spark, ["¡Él, Ñandú!"], text.error_text) == ["el nandu"]


def test_small_functions(spark):
    assert column(spark, ["a/b/c", "a/"], text.last_part) == ["c", ""]
    assert column(spark, ["/a/b/"], text.file_name_of) == ["a_b"]
    assert column(spark, [" 7 ", "+7", "1_0", "x", "1__0"], text.is_int) == [True, True, True, False, False]
    assert column(spark, ["Dr. Pérez Ruiz.", "Drake", "None", None, "Ana NCol 12"], text.clean_answer) == ["Pérez Ruiz", "ake", "", "", "Ana"]
    assert column(spark, ["Nombre: A\nNombre: B\nx"], lambda v: text.labelled_line(v, "Nombre")) == ["B"]
    assert column(spark, ["a Tarea: b", "c"], text.task_of) == ["b", "c"]
    assert column(spark, ["", "  ", "de", "de 34", "x"], text.significant) == [False, False, False, True, False]
    assert column(spark, ["a. b\nc."], text.sentence_marks) == [3]


def test_natural_order(spark):
    df = spark.createDataFrame([("prompt10",), ("prompt2",), ("base",)], "n string")
    assert [r.n for r in df.orderBy(analysis.natural_key(F.col("n"))).collect()] == ["prompt2", "prompt10", "base"]


def test_categories(spark):
    assert column(spark, ["HOSPITAL", "PROFESIÓN", "XYZ"], category_of) == ["LOCATION", "PROFESSION", "WARNING"]
    df = spark.createDataFrame([("AGE", "EDAD_SUJETO_ASISTENCIA", "1", "2"), ("AGE", "HOSPITAL", "1", "2"), ("AGE", "EDAD_SUJETO_ASISTENCIA", "x", "2")], "c string, t string, a string, b string")
    assert [r[0] for r in df.select(valid_span(F.col("c"), F.col("t"), F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_runs_and_failures(spark):
    a = spark.createDataFrame([("X", 0.5), ("Y", 0.25)], "tag string, f1 double")
    b = spark.createDataFrame([("X", 0.75)], "tag string, f1 double")
    assert {r.tag: (r.f1_1, r.f1_2, r.f1_diff) for r in analysis.compare_runs(a, b, ["f1"]).collect()} == {"X": (0.5, 0.75, 0.25), "Y": (0.25, 0.0, -0.25)}
    blocks = spark.createDataFrame([("m", "p", "f", True, "malformed", 1), ("m", "p", "g", False, None, 2), ("desconocido", "p", "f", True, "malformed", 3)], "model string, prompt string, file string, has_error boolean, error_kind string, pos int")
    assert tuple(analysis.failure_stats(blocks).first()) == ("m", "p", 2, 1, 0, 0, 1, 50.0)
    assert analysis.common_failures(blocks).collect()[0].n == 2
    rows = spark.createDataFrame([("d", "x"), ("e", "longer")], "doc_id string, text string")
    s = analysis.length_summary(analysis.compare_lengths(rows, rows.withColumn("text", F.lit("ab")))).first()
    assert (s.n, s.longer_1, s.longer_2, s.equal) == (2, 1, 1, 0)


def test_fill_missing(spark):
    make = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id int")
    out = analysis.fill_missing(make(1, 9).withColumn("s", F.lit("a")), make(1, 2), make(1, 2, 3).withColumn("s", F.lit("b")))
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b")]


def test_places_of_many_tags():
    """As brute force has it: all free occurrences, by distance from the text before the tag without its tags."""
    rng = random.Random(3)
    for _ in range(2000):
        original = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 25)))
        tagged = "".join(rng.choice(["a", " ", "<", ">", "<T>a</T>", "<T>ab</T>", "<*T*>a<*/T*>", "<<<T>>>b<<</T>>>"]) for _ in range(rng.randint(0, 12)))
        taken, want = set(), []
        for start, _, tag, value in inline.tag_candidates(tagged):
            at = len(inline.untagged(tagged[:start]))
            places = [p for p in inline.occurrences(original, value) if not taken & set(range(p, p + len(value)))]
            if places:
                p = min(places, key=lambda p: (abs(p - at), p))
                taken |= set(range(p, p + len(value)))
                want.append((p, p + len(value), tag, value))
        assert inline.align(original, tagged) == want
        lines = tagged.replace(" ", "\n")
        assert inline.pack_lines(lines, len, 9, "x{texto_clinico}") == inline.pack_lines(lines, lambda s: len(s), 9, "x{texto_clinico}")


def test_legacy_bio():
    assert inline.legacy_bio("oh <PER>Ana Gil</PER> y <LOC>x y</LOC>") == [("oh", "O"), ("Gil", "B-PER"), ("y", "O"), ("y", "B-LOC")]
    assert inline.legacy_bio("<PER>Ana</PER> ve <LOC>Roma</LOC>") == [("ve", "B-PER"), ("[LOC_START]Roma[LOC_END]", "I-PER")]
    assert inline.legacy_bio("") == [] and inline.legacy_bio("<TAG>x</TAG>") == [("<TAG>x</TAG>", "O")]


def test_patterns_and_numbers(spark):
    assert column(spark, [1, 8, 9, 10, 11, 12], inline.pattern_of, "int") == [1, 2, 3, 4, 2, 1]
    assert column(spark, [" 7 ", "+7", "1_0", "1__0", "", "7\n"], text.is_int) == [True, True, True, False, False, True]


def test_paired_lines(spark):
    rows = lambda spans: spark.createDataFrame([(d, p, t, "O") for d, ts in spans.items() for p, t in enumerate(ts)], "doc_id string, pos int, token string, label string")
    pairs, failed = bio.paired_lines(rows({"a": "xy", "b": "xyz", "c": "x"}), rows({"a": "xy", "b": "xy", "d": "x"}))
    assert sorted((r.doc_id, r.pos) for r in pairs.collect()) == [("a", 0), ("a", 1)]
    assert {r.doc_id: r.error for r in failed.collect()} == {"b": "line count", "d": "no gold"}


def test_listed(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 0)], "name string, n int")
    assert [r.name for r in analysis.listed(rows, "name", 2).collect()] == ["a", "b"] and analysis.positive(rows, "n").count() == 2


def test_table_functions(spark):
    from glossa.functions import tables

    names = tables.register(spark)
    assert {"tag_spans", "packed_lines", "without_marks"} <= set(names)
    spark.createDataFrame([(1, "Ana y Ana", "<PER>Ana</PER> y <PER>Ana</PER>"), (2, None, None)], "id int, text string, tagged string").createOrReplaceTempView("tagged_texts")
    rows = spark.sql("select id, t.* from tagged_texts, lateral tag_spans(text, tagged) t order by ord").collect()
    assert [(r.id, r.start, r.end) for r in rows] == [(1, 0, 3), (1, 6, 9)]
    assert [r.chunk for r in spark.sql("select t.chunk from tagged_texts, lateral packed_lines(text, 5) t").collect()] == ["Ana y Ana"]
    assert [tuple(r) for r in spark.sql("select t.* from tagged_texts, lateral loose_matches(text, 'ANA') t order by start").collect()] == [(0, 3, "Ana"), (6, 9, "Ana")]
    assert spark.sql("select * from stray_openings('a < b', 1)").first().start == 2
    assert [r.label for r in spark.sql("select * from inline_bio('<PER>Ana</PER> y')").collect()] == ["B-PER", "O"]
