"""Reports, quarantine, stop words, margins and grammar."""

import json

from pyspark.sql import functions as F

from glossa.__main__ import parser, scores
from glossa.functions import text
from glossa.functions.inline import is_json, json_kind_column
from glossa.operators import bio
from glossa.plans import annotate, evaluate
from glossa.sources import readers, writers


def test_metrics_report_by_document(spark):
    totals = spark.createDataFrame([("s", 3, 1, 0, 0.75, 1.0, 0.857142)], "system string, tp long, fp long, fn long, precision double, recall double, f1 double")
    bins = spark.createDataFrame([("s", "10-20%", 1, 50.0), ("s", "0%", 1, 50.0)], "system string, bin string, n long, share double")
    docs = spark.createDataFrame([("s", "b", 0.5, 1.0, 0.6667), ("s", "a", 1.0, 1.0, 1.0)], "system string, doc_id string, precision double, recall double, f1 double")
    value = writers.metrics_report(totals, bins, 2, documents=docs, ignore_tags=True).first().value
    assert "Mode: tags ignored\n" in value and value.index("0%:") < value.index("10-20%:")
    assert value.endswith(f"By document:\n{'a':30} P=1.000 R=1.000 F1=1.000\n{'b':30} P=0.500 R=1.000 F1=0.667\n")
    assert "Mode" not in writers.metrics_report(totals, bins, 2).first().value


def test_quarantine(spark, tmp_path, capsys):
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "d.txt").write_text("Ana Gil")
    (gold / "d.ann").write_text("T1\tNAME 0 3\tAna\nT2\tNAME 4;5 7\tGil\n")
    good, bad, n, m = writers.quarantine(readers.brat_spans(spark, str(gold)), str(tmp_path / "q"))
    assert (n, m) == (1, 1) == (good.count(), bad.count()) and bad.first().error.startswith("T2") and good.columns == bad.columns
    none = readers.brat_spans(spark, str(gold)).limit(0)
    assert writers.quarantine(none, str(tmp_path / "q0"))[2:] == (0, 0)
    args = ["official", "brat", "ner", str(gold), str(gold)]
    for more in ([], ["--quarantine", str(tmp_path / "kept")]):
        r = scores(spark, parser().parse_args([*args, *more])).first()
        assert (r.tp, r.fp, r.fn) == (1, 0, 0) and "1 damaged rows left out" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "kept" / "1-gold")).where("error is not null").count() == 1


def test_stop_words_of_a_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("de\n\n# a list\nmientras # while\nde\n")
    words = text.read_stop_words(str(tmp_path / "w.txt"))
    assert words == ("de", "mientras")
    spans = "doc_id string, system string, ord int, start long, end long, tag string, text string"
    gold = spark.createDataFrame([("d", None, 0, 9, 12, "X", "Ana")], spans).drop("system")
    system = spark.createDataFrame([("d", "s", 0, 0, 12, "X", "mientras Ana")], spans)
    fp = lambda **w: evaluate.relaxed(gold, system, None, **w).first().fp
    assert fp() == 1 and fp(stop_words=words) == 0


def test_margins(spark, tmp_path):
    for mode in ("with_tags", "no_tags"):
        for m in ("0_10", "0_05", "1_00"):
            d = tmp_path / mode / f"margin_{m}"
            d.mkdir(parents=True)
            (d / "metrics_prompt8.txt").write_text(f"Precision: 0.{m[-2:]}\nRecall: 0.5\nF1-score: 0.4\n     0%:    2 ( 50.0%)\n  0-10%:    2 ( 50.0%)\n")
    (tmp_path / "metrics_x.txt").write_text("Precision: 1\n")
    rows = readers.margin_reports(spark, str(tmp_path)).collect()
    assert [(r.mode, r.margin) for r in rows] == [(m, x) for m in ("no_tags", "with_tags") for x in (0.05, 0.1, 1.0)]
    assert (rows[0].system, rows[0].precision, rows[0].bins) == ("prompt8", 0.05, {"0%": 2, "0-10%": 2})


def test_last_type_beside_all(spark):
    rows = spark.createDataFrame([("d", i, g, p) for i, (g, p) in enumerate([("B-A", "B-A"), ("B-Z", "B-Z"), ("O", "B-Z"), ("B-A", "O")])], "doc_id string, pos int, gold string, pred string")
    r = bio.overall_and_last(bio.chunk_scores(rows)).first()
    assert (r.precision, r.recall, r.legacy_last_type, r.legacy_precision, r.legacy_recall) == (66.67, 66.67, "Z", 50.0, 100.0)
    assert bio.overall_and_last(bio.chunk_scores(rows.limit(0))).first().legacy_last_type is None


def test_json_with_repeated_names(spark):
    texts = ['{"a":1,"a":2}', '{"a":{"b":1,"b":2}} x', "{'a':1}", "[1] [2]", "", "1,2", "01", '"\\q"', "null", ' {"a" : [1, {"x": NaN}]} ', '{"v":1},"v":2']

    def valid(t):
        try:
            return json.loads(t) is not ... and True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(is_json(F.col("t")).alias("x")).collect()] == [valid(t) for t in texts]
    fenced = spark.createDataFrame([('x ```json\n{"a":1,"a":2}\n```',), ('```\n{"a":1,"a":2}\n```',), ('{"a":1,"a":1}',), ("{a}",)], "t string")
    assert [r.k for r in fenced.select(json_kind_column(F.col("t")).alias("k")).collect()] == ["delimiters", "no_delimiters", "raw", "malformed"]


def test_a_model_under_a_grammar(spark, tmp_path):
    model = annotate.under_grammar(lambda prompts, rules: [str({"texto_anotado": rules.split("\n")[2], "entidades": {}})] * len(prompts), ["A", "B"])
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    free = lambda prompts: ["{}"] * len(prompts)
    annotate.annotate_batch(docs, str(tmp_path / "done"), free, "m", "prompt2", ["doc_id"], annotate.Settings(), constrained=model, wait=0)
    assert spark.read.parquet(str(tmp_path / "done")).first().tagged_text == 'name ::= "A" | "B"'


def test_functions_for_sql(spark):
    from glossa.functions import tables

    assert {"reply_values", "span_elements", "error_text", "token_count"} <= set(tables.register(spark))
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    reply = '''x {"entidades": {"A": ["Ana", "Gil"], "B": "Rex"}} y'''
    assert one(f"select * from reply_values('{reply}') order by value") == [("A", "Ana"), ("A", "Gil"), ("B", "Rex")] and one("select * from reply_values('no')") == []
    xml = '<M><TEXT>Ana Gil</TEXT><TAGS><NAME start="5" end="8" TYPE="X"/></TAGS></M>'
    assert one(f"select * from span_elements('{xml}', 1)") == [(1, "NAME", "X", 4, 7, "Gil")] and one("select * from span_elements('<M>', 0)") == []
    for t in ("  ¡José, (34)! ", "ÑÜ\u00a0x", "ſß"):
        df = spark.createDataFrame([(t,), (None,)], "t string")
        df.createOrReplaceTempView("error_texts")
        assert one("select error_text(t) from error_texts") == [tuple(r) for r in df.select(text.error_text(F.col("t"))).collect()]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    assert one(f"select token_count('hello world', '{path}'), token_count(null, '{path}')") == [(annotate.token_length(path)("hello world"), None)]


def test_dense_confusion(spark, monkeypatch):
    import pytest

    from glossa.operators import metrics

    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "B")], "gold_tag string, pred_tag string")
    got = {(r.gold_tag, r.pred_tag): r.n for r in metrics.confusion(pairs).collect()}
    assert got == {(g, p): int((g, p) in {("A", "A"), ("A", "B"), ("C", "B")}) for g in "ABC" for p in "ABC"}
    assert metrics.confusion(pairs.limit(0)).count() == 0
    monkeypatch.setattr(metrics, "MOST_LABELS", 2)
    with pytest.raises(Exception, match="more than 2 labels"):
        metrics.confusion(pairs).collect()
