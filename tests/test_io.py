"""Readers, writers and annotation runs on small files."""

import os

import pytest
from pyspark.sql import functions as F

from glossa.operators import bio
from glossa.plans import annotate, evaluate
from glossa.sources import readers, writers
from glossa.streaming.annotate import watch

XML = """<?xml version="1.0" encoding="UTF-8"?>
<MEDDOCAN>
  <TEXT> Ana &amp; Gil en Madrid</TEXT>
  <TAGS>
    <NAME id="T1" start="1" end="4" text="Ana" TYPE="NOMBRE_SUJETO_ASISTENCIA" comment=""/>
    <ZZ id="T2" start="7" end="10" text="Gil" comment=""/>
  </TAGS>
</MEDDOCAN>
"""


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "sys1"
    d.mkdir()
    return d


def test_span_xml(spark, folder):
    (folder / "a.xml").write_text(XML)
    (folder / "bad.xml").write_text("<MEDDOCAN>")
    rows = {(r.doc_id, r.ord): r for r in readers.xml_spans(spark, str(folder)).collect()}
    assert rows["a", 1].text == "Ana" and rows["a", 1].type == "NOMBRE_SUJETO_ASISTENCIA" and rows["a", 1].system == "sys1"
    assert rows["a", 2].category == "ZZ" and rows["a", 2].type is None and rows["a", 2].start_raw == "7"
    assert rows["bad", None].error
    assert [r.category for r in readers.official_spans(spark, str(folder)).where("error is null").collect()] == ["NAME"]
    assert {r.doc_id: r.text for r in readers.xml_documents(spark, str(folder)).collect()} == {"a": " Ana & Gil en Madrid", "bad": None}
    assert readers.xml_spans(spark, str(folder), base=1).where("ord = 1").first().start == 0


def test_span_xml_round_trip(spark, folder, tmp_path):
    texts = spark.createDataFrame([("x", "a < b & c"), ("y", None)], "doc_id string, text string")
    spans = spark.createDataFrame([("x", 4, 5, "LOC", "b")], "doc_id string, start int, end int, tag string, text string")
    out = {r.doc_id: r.xml for r in writers.span_xml(texts, writers.with_categories(spans)).collect()}
    (folder / "x.xml").write_text(out["x"])
    (folder / "y.xml").write_text(out["y"])
    r = readers.xml_spans(spark, str(folder)).first()
    assert (r.doc_id, r.category, r.type, r.start, r.end, r.text) == ("x", "WARNING", "LOC", 4, 5, "b")
    assert readers.xml_documents(spark, str(folder)).where("doc_id = 'x'").first().text == "a < b & c"


def test_brat(spark, folder):
    (folder / "d.ann").write_text("T1\tNAME 0 3\tAna\nT1\tTAG 5\n#1\tnote\nT2\tTAG 0 5;7 9\tx\n")
    rows = readers.brat_spans(spark, str(folder)).orderBy("ord").collect()
    assert [(r.tag, r.start, r.end, r.error is None) for r in rows] == [("NAME", 0, 3, True), ("TAG", 0, None, False)]
    (folder / "e.ann").write_text("")
    assert {r.doc_id: r.n_sentences for r in readers.sentence_counts(spark, str(folder)).collect()} == {"d": 4, "e": 0}


def test_columns_and_bio(spark, folder, tmp_path):
    (folder / "c.txt").write_text("-DOCSTART- -X- O\n\nLa DA B-LOC\nCoruña NC I-LOC\nshort\n\nb X O\n")
    rows = readers.conll_tokens(spark, str(folder)).orderBy("doc_no", "pos").collect()
    assert [(r.doc_no, r.pos, r.token, r.label) for r in rows] == [(1, 0, "La", "B-LOC"), (1, 1, "Coruña", "I-LOC"), (2, 0, "b", "O")]
    tokens = spark.createDataFrame([("q", 0, "a", "B-X"), ("q", 1, "b", "O")], "doc_id string, pos int, token string, label string")
    (folder / "q.bio").write_text(writers.bio_text(tokens).first().value)
    assert sorted(map(tuple, readers.bio_tokens(spark, str(folder)).collect())) == [("q", 0, "a", "B-X"), ("q", 1, "b", "O")]
    (folder / "r.bio").write_text("a b c\n")
    with pytest.raises(Exception, match="not two fields"):
        readers.bio_tokens(spark, str(folder)).collect()


def test_array_tokens(spark):
    df = spark.createDataFrame([("test", ["a", "b", "c"], ["O", "B-X"]), ("train", ["z"], ["O"])], "split string, tokens array<string>, ner_tags array<string>")
    assert [(r.pos, r.token, r.label) for r in readers.array_tokens(df).orderBy("pos").collect()] == [(0, "a", "O"), (1, "b", "B-X")]
    with pytest.raises(ValueError):
        readers.array_tokens(df.drop("tokens"))


def test_replies_and_texts(spark, folder):
    (folder / "a.txt").write_text("{'tagged_text': 'x', 'entities': {'PER': ['Ana', 'Ana']}}")
    (folder / "b.txt").write_text("no reply")
    (folder / "c.txt").write_text("{'tagged_text': None, 'entities': {'ORG': ('Oca', 1), 'LOC': 'Vigo', 'X': None}, 'ok': True}")
    rows = readers.replies(spark, str(folder))
    assert sorted((r.doc_id, r.tagged_text, r.entities) for r in rows.collect()) == [("a", "x", {"PER": ["Ana", "Ana"]}), ("c", "", {"ORG": ["Oca", "1"], "LOC": ["Vigo"]})]
    assert tuple(readers.entity_values(rows.where("doc_id = 'a'"), ["doc_id"]).first()) == ("a", "PER", "Ana", 2)
    assert {r.doc_id for r in readers.plain_texts(spark, str(folder)).collect()} == {"a", "b", "c"}


LOG = """2025-01-01 10:00:00,000 - INFO - Procesando archivo: a.xml
Modelo: m1
Directorio de salida: out/prompt2
Error parseando JSON
Respuesta cruda del modelo:
```json
{"a": 1}
```
2025-01-01 10:00:05,500 - INFO - Resumen final de entidades encontradas:
2025-01-01 10:01:00,000 - INFO - Procesando archivo: b.xml
Modelo: m1
"""


def test_logs(spark, folder):
    (folder / "run.log").write_text(LOG)
    lines = readers.log_lines(spark, str(folder)).orderBy("line_no").collect()
    assert len(lines) == 3 and lines[1].ts.microsecond == 500000
    blocks = readers.blocks_of(readers.whole_files(spark, str(folder)).withColumnRenamed("doc_id", "run")).orderBy("pos").collect()
    assert [(b.model, b.prompt, b.file.strip(), b.has_error, b.error_kind) for b in blocks] == [("m1", "prompt2", "a.xml", True, "delimiters"), ("m1", "prompt_desconocido", "b.xml", False, None)]


def test_report_numbers(spark):
    text = "Precision: 0.5\nRecall: 1e-05\nF1: 0.25\n0%: 3\n0-10%: 4\n"
    r = spark.createDataFrame([(text,)], "t string").select(readers.report_numbers(F.col("t")).alias("r")).first().r
    assert (r.precision, r.recall, r.f1, r.bins) == (0.5, 1e-05, 0.25, {"0%": 3, "0-10%": 4})


def test_settings():
    s = annotate.read_settings("[run]\nmodels = a, b\nprompts = prompt1, prompt5\nmax_files = x\ncontext = 100\n")
    assert (s.models, s.max_files, s.limit) == (["a", "b"], None, 90)
    assert annotate.policy("prompt5", s) == {"grammar": True, "context": 8192} and not annotate.policy("prompt1", s)["grammar"]
    with pytest.raises(ValueError):
        annotate.read_settings("[run]\ncontext = 0\n")


@pytest.fixture
def shout():
    return lambda prompts: ["no json" if "bad" in p else str({"texto_anotado": p.upper(), "entidades": {"W": p.split()}}) for p in prompts]


def test_annotate(spark, shout):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "bad"), (3, "")], "doc_id int, text string")
    out = {r.doc_id: r for r in annotate.annotate(docs, shout, ["doc_id"], annotate.Settings(context=7), wait=0).collect()}
    assert out[1].tagged_text == "A B\n\nC D" and out[1].entities == {"W": ["a", "b", "c", "d"]}
    assert out[2].tagged_text == "bad" and out[2].entities == {}


def test_resumed_runs(spark, tmp_path, shout):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id int, text string")
    run = lambda n: annotate.annotate_batch(docs, str(tmp_path / "done"), shout, "m", "p", ["doc_id"], annotate.Settings(max_files=n), wait=0)
    assert [run(2), run(None), run(None)] == [2, 3, 0]


def test_policy_of_a_batch(spark, tmp_path):
    """The context of the prompt decides what is cut in chunks, and the grammar which of the two models is asked."""
    docs = spark.createDataFrame([(1, "\n".join(["word " * 40] * 60))], "doc_id int, text string")
    settings = annotate.Settings(prompts=["prompt1", "prompt5"])
    free, bound = (lambda prompts, name=n: [str({"texto_anotado": name, "entidades": {}})] * len(prompts) for n in ("free", "bound"))
    got = {}
    for prompt in settings.prompts:
        annotate.annotate_batch(docs, str(tmp_path / prompt), free, "m", prompt, ["doc_id"], settings, constrained=bound, wait=0)
        got[prompt] = spark.read.parquet(str(tmp_path / prompt)).where("doc_id = 1").first().tagged_text.split("\n\n")
    assert set(got["prompt1"]) == {"free"} and set(got["prompt5"]) == {"bound"}
    assert len(got["prompt1"]) > len(got["prompt5"]) > 1


def test_reports(spark, tmp_path):
    scores = spark.createDataFrame([("a", 3, 1, 0, 0.75, 1.0, 0.857142)], "doc_id string, tp long, fp long, fn long, precision double, recall double, f1 double")
    assert writers.score_report(scores).first().value == "Report (a):\ntp: 3  fp: 1  fn: 0\nPrecision: 0.7500\nRecall: 1.0000\nF1: 0.8571\n"
    writers.write_csv(scores, str(tmp_path / "scores"))
    back = spark.read.option("header", True).csv(str(tmp_path / "scores")).first()
    assert (back.doc_id, back.tp, back.f1) == ("a", "3", "0.857142")


def test_token_accuracy(spark):
    rows = spark.createDataFrame([(1, 0, "B-PER", "B-PER"), (1, 1, "I-PER", "O"), (1, 2, "O", "O"), (1, 3, "B-LOC", "B-LOC")], "doc_id int, pos int, gold string, pred string")
    assert tuple(bio.token_accuracy(rows).first()) == (4, 75.0) and tuple(bio.token_accuracy(rows.limit(0)).first()) == (0, 0.0)


def test_stream(spark, tmp_path, shout):
    src = tmp_path / "in"
    src.mkdir()
    done, state = str(tmp_path / "done"), str(tmp_path / "state")
    for name in ("a", "b"):
        (src / f"{name}.txt").write_text(name)
        watch(spark, str(src), done, state, shout, "m", "p", annotate.Settings(), wait=0).awaitTermination()
        watch(spark, str(src), done, state, shout, "m", "p", annotate.Settings(), wait=0).awaitTermination()
    assert sorted((r.doc_id, r.tagged_text) for r in spark.read.parquet(done).collect()) == [("a", "A"), ("b", "B")]


def test_evaluations(spark):
    text = "Ana Gil de 34 años, Madrid"
    gold = [("NAME", 0, 3), ("NAME", 4, 7), ("AGE", 11, 18), ("LOC", 20, 26)]
    one = [("NAME", 0, 7), ("AGE", 11, 13), ("LOC", 20, 26), ("LOC", 20, 26)]
    columns = "doc_id string, ord int, category string, type string, tag string, start long, end long, text string"
    rows = lambda spans, *k: [(*k, "d", i, t, t, t, a, b, text[a:b]) for i, (t, a, b) in enumerate(spans)]
    g = spark.createDataFrame(rows(gold), columns)
    s = spark.createDataFrame(rows(one, "s1") + rows(gold, "s2"), "system string, " + columns)
    texts = spark.createDataFrame([("d", text)], "doc_id string, text string")
    sentences = spark.createDataFrame([("d", 1)], "doc_id string, n_sentences int")
    ner = evaluate.official(g, s, "ner", sentences=sentences)
    assert {r.system: (r.tp, r.fp, r.fn, r.leak) for r in ner.collect()} == {"s1": (1, 2, 3, 3.0), "s2": (4, 0, 0, 0.0)}
    assert {r.system: r.f1 for r in evaluate.official_micro(ner).collect()}["s2"] == 1.0
    merged = evaluate.official(g, s, "merged", texts)
    assert {r.system: (r.tp, r.fp, r.fn) for r in merged.collect()}["s1"] == (2, 1, 1)
    assert {r.system: (r.tp, r.fp, r.fn) for r in evaluate.relaxed(g, s, texts).collect()} == {"s1": (3, 2, 1), "s2": (4, 0, 0)}
    assert evaluate.both_tag_modes(g, s, texts).count() == 4
    assert round({r.system: r.percent for r in evaluate.missed(g, s).collect()}["s1"], 2) == 28.57
    tags, pairs = evaluate.analysed(g, s, texts)
    assert {(r.system, r.tag): (r.tp, r.fp, r.fn) for r in tags.collect()}["s1", "NAME"] == (0, 1, 2)
    assert pairs.where("system = 's2' and kind = 'TP'").agg(F.sum("n")).first()[0] == 4
    with pytest.raises(ValueError):
        evaluate.official(g, s, "other")


def test_names(spark):
    docs = spark.createDataFrame([(1, "Ana Gil vio a RUIZ; ANA."), (2, None)], "doc_id int, text string")
    reply = "NOMBRE_PACIENTE: Ana\nAPELLIDOS_PACIENTE: Gil.\nMEDICO: Dr. Ruiz\n"
    out = {r.doc_id: r.xml for r in annotate.tag_names(docs, lambda prompts: [reply] * len(prompts)).collect()}
    assert [x in out[1] for x in ('id="T1" start="0" end="3"', 'start="4" end="7"', 'start="14" end="18" text="RUIZ" TYPE="NOMBRE_PERSONAL_SANITARIO"', 'start="20" end="23"')] == [True] * 4
    assert "<NAME" not in out[2]


def test_reply_modes(spark):
    texts = spark.createDataFrame([(1, "Ana y Ana Gil")], "doc_id int, text string")
    kinds = "system string, doc_id int, tagged_text string, entities map<string,array<string>>"
    replies = spark.createDataFrame([("s", 1, "Ana y Ana <A>Gil</A>", {"B": ["Ana", "Ana"]}), ("t", 1, None, None), ("s", 9, "<A>Gil</A>", {})], kinds)
    got = sorted((r["mode"], r.system, r.doc_id, r.start, r.end, r.tag) for r in annotate.reply_spans(replies, texts).collect())
    assert got == [("entities", "s", 1, 0, 3, "B"), ("entities", "s", 1, 6, 9, "B"), ("tagged", "s", 1, 10, 13, "A")]


def test_models_and_token_lengths():
    assert annotate.known_model("m", {"m": 10}) == 10
    with pytest.raises(ValueError):
        annotate.known_model("x", {"m": 10})
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        length = annotate.token_length(path)
        assert length("") == 0 and 0 < length("a few words here") < len("a few words here")


def test_grid_and_error_report(spark):
    text = "Ana Gil de 34 años, Madrid"
    columns = "doc_id string, ord int, category string, type string, tag string, start long, end long, text string"
    rows = lambda doc, spans, *k: [(*k, doc, i, t, t, t, a, b, text[a:b]) for i, (t, a, b) in enumerate(spans)]
    spans = [("NAME", 0, 3), ("NAME", 4, 7), ("AGE", 11, 18), ("LOC", 20, 26)]
    gold = spark.createDataFrame(rows("d", spans) + rows("e", spans), columns)
    found = [("NAME", 0, 7), ("AGE", 11, 13), ("LOC", 20, 26), ("LOC", 20, 26)]
    system = spark.createDataFrame(rows("d", found, "s", "p1"), "system string, config string, " + columns)
    texts = spark.createDataFrame([("d", text), ("e", text)], "doc_id string, text string")
    # the document that the configuration lacks comes from the fallback
    grid = {r.subtrack: (r.tp, r.fp, r.fn) for r in evaluate.grid(gold, system, gold.where("start > 0"), texts).collect()}
    assert grid["ner"] == (4, 2, 4) and grid["spans"] == (4, 2, 4) and set(grid) == set(evaluate.SUBTRACKS)
    report = evaluate.error_report(gold.where("doc_id = 'd'"), system.drop("config"), texts).first().value
    assert report.startswith("Report (d):\ntp: 3  fp: 2  fn: 1\n")
    tail = ["Exact matches (1):", "  [20-26] 'Madrid' (LOC)", "Inclusions (1):", "  [0-7] 'Ana Gil' holds 2", "False positives (2):", "  [11-13] '34' (AGE)", "  [20-26] 'Madrid' (LOC)", "False negatives (1):", "  [11-18] '34 años' (AGE) - 28.6% covered"]
    assert report.split("\n")[-len(tail) :] == tail


def test_metrics_report(spark):
    totals = spark.createDataFrame([("s", 1, 0, 1, 1.0, 0.5, 0.6667), ("t", 1, 0, 0, 1.0, 1.0, 1.0)], "system string, tp long, fp long, fn long, precision double, recall double, f1 double")
    bins = spark.createDataFrame([("s", "10-20%", 1, 100.0), ("s", "0%", 0, 0.0)], "system string, bin string, n long, share double")
    out = {r.system: r.value for r in writers.metrics_report(totals, bins, 3).collect()}
    assert out["s"].endswith("TP: 1\nFP: 0\nFN: 1\n      0%:    0 (  0.0%)\n  10-20%:    1 (100.0%)\n") and "3 documents" in out["s"]
    assert out["t"].endswith("no missed spans\n")
