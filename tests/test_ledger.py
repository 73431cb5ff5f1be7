"""How often a model is asked: a log of its calls lies beside the data, since tasks are processes of their own."""

import os
import time

import pytest
from pyspark.sql import functions as F

from glossa.plans import annotate
from glossa.plans.ledger import Ledger
from glossa.sources import files
from glossa.streaming.annotate import watch


@pytest.fixture
def model(tmp_path):
    """A model that notes each prompt in a file; calls() gives the notes."""
    log = str(tmp_path / "calls.txt")

    def predict(prompts):
        with open(log, "a") as f:
            f.writelines(repr(p) + "\n" for p in prompts)
        return [str({"texto_anotado": p.upper(), "entidades": {"W": p.split()}}) for p in prompts]

    predict.log = log
    predict.calls = lambda: open(log).read().splitlines() if os.path.exists(log) else []
    return predict


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def settings(limit=1000, **more):
    return annotate.Settings(context=limit, margin=0.0, **more)


def test_each_part_is_asked_once(spark, tmp_path, model):
    docs = documents(spark, [f"document {i}" for i in range(6)])
    annotate.annotate(docs, model, ["doc_id"], settings(), wait=0).collect()
    assert len(model.calls()) == 6
    done = str(tmp_path / "done")
    assert annotate.annotate_batch(docs, done, model, "m", "p", ["doc_id"], settings(), wait=0) == 6
    assert len(model.calls()) == 12
    # the second run, and another table with the same ledger, ask nobody
    assert annotate.annotate_batch(docs, done, model, "m", "p", ["doc_id"], settings(), wait=0) == 0
    assert annotate.annotate_batch(docs, str(tmp_path / "other"), model, "m", "p", ["doc_id"], settings(), ledger_path=done + "_replies", wait=0) == 6
    assert len(model.calls()) == 12
    # another prompt does
    assert annotate.annotate_batch(docs, done, model, "m", "q", ["doc_id"], settings(), wait=0) == 6
    assert len(model.calls()) == 18
    rows = spark.read.parquet(done).where("prompt = 'p'").collect()
    assert sorted((r.doc_id, r.tagged_text, r.entities["W"]) for r in rows) == [(i, f"DOCUMENT {i}", [str(i), "document"]) for i in range(6)]


def test_copies_are_asked_once(spark, tmp_path, model):
    docs = documents(spark, ["same"] * 20 + ["own\nsame", None, ""])
    assert annotate.annotate_batch(docs, str(tmp_path / "done"), model, "m", "p", ["doc_id"], settings(5), wait=0) == 23
    assert sorted(model.calls()) == ["''", "'own'", "'same'"]
    out = {r.doc_id: r.tagged_text for r in spark.read.parquet(str(tmp_path / "done")).collect()}
    assert out[0] == out[19] == "SAME" and out[20] == "OWN\n\nSAME" and out[21] == out[22] == ""


def test_a_text_that_fits_goes_whole(spark, model):
    docs = documents(spark, ["a\n\nb", "a\n\n" + "b" * 30, "\n" * 40])
    out = {r.doc_id: r for r in annotate.annotate(docs, model, ["doc_id"], settings(20), wait=0).collect()}
    assert out[0].tagged_text == "A\n\nB" and "'a\\n\\nb'" in model.calls()
    # cut in lines: the blank one is left out
    assert out[1].tagged_text == "A\n\n" + "B" * 30
    # too long, and without a line: nothing to ask, but not lost
    assert out[2].tagged_text == "" and out[2].entities == {} and len(model.calls()) == 3


def test_documents_without_lines_are_finished(spark, tmp_path, model):
    docs, done = documents(spark, ["\n" * 40, "x"]), str(tmp_path / "done")
    run = lambda: annotate.annotate_batch(docs, done, model, "m", "p", ["doc_id"], settings(20), wait=0)
    assert (run(), run()) == (2, 0)


def test_a_failed_task_does_not_ask_again(spark, tmp_path, model):
    """The model fails amid a task: what it had answered before lies in the ledger."""
    switch, docs = str(tmp_path / "broken"), documents(spark, [f"text {i:03}" for i in range(120)])
    open(switch, "w").close()

    def fragile(prompts):
        if os.path.exists(switch) and any(p.endswith("077") for p in prompts):
            raise RuntimeError("the model is gone")
        return model(prompts)

    done = str(tmp_path / "done")
    parts = annotate.asked_parts(docs, ["doc_id"], 1000).withColumn("digest", F.sha2("chunk", 256))
    answer = lambda chunks: annotate._answers(chunks, fragile, annotate.SLOT, 1, 0.0, None)
    ledger = Ledger(str(tmp_path / "replies"), "m", "p", "job")
    with pytest.raises(Exception, match="the model is gone"):
        ledger.fill(parts, answer, batch=4)
    first = []
    while first != (first := model.calls()):  # other tasks of the job may still be at it
        time.sleep(2)
    assert 0 < len(first) < 120 and ledger.replies(spark).count() == len(first)
    os.remove(switch)
    # the same job again, as a task that is started anew: the anti-join is not what tells it
    again = Ledger(ledger.path, "m", "p", "job", whole=False)
    again.replies = lambda spark: spark.createDataFrame([], "digest string, tagged_text string, entities map<string,array<string>>, answered boolean")
    assert again.fill(parts, answer, batch=4) == 120 - len(first)
    assert len(model.calls()) == len(set(model.calls())) == 120
    assert annotate.annotate_batch(docs, done, fragile, "m", "p", ["doc_id"], settings(), ledger_path=ledger.path, wait=0) == 120
    assert len(model.calls()) == 120


def test_replies_that_do_not_parse_are_kept_too(spark, tmp_path):
    log = str(tmp_path / "n")

    def mute(prompts):
        with open(log, "a") as f:
            f.write("x" * len(prompts))
        return ["no json"] * len(prompts)

    docs = documents(spark, ["one", "two"])
    for name in ("a", "b"):
        annotate.annotate_batch(docs, str(tmp_path / name), mute, "m", "p", ["doc_id"], settings(), ledger_path=str(tmp_path / "r"), wait=0)
    assert len(open(log).read()) == 6  # three attempts each, once
    assert {r.tagged_text for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {"one", "two"}


def test_a_long_context_is_filed_apart(spark, tmp_path, model):
    docs, done = documents(spark, ["x"]), str(tmp_path / "done")
    for s in (annotate.Settings(prompts=["prompt5", "prompt1"]), annotate.Settings(prompts=["prompt1", "prompt5"])):
        assert annotate.annotate_batch(docs, done, model, "a:b/c", "prompt5", ["doc_id"], s, wait=0) == 1
    assert sorted((r.model, r.prompt) for r in spark.read.parquet(done).collect()) == [("a:b/c", "prompt5"), ("a:b/c", "prompt5_context8192")]


def test_a_repeated_batch_of_a_stream(spark, tmp_path, model):
    src, done, state = tmp_path / "in", str(tmp_path / "done"), str(tmp_path / "state")
    src.mkdir()
    go = lambda: watch(spark, str(src), done, state, model, "m", "p", settings(), files_a_batch=2, wait=0).awaitTermination()
    for i in range(5):
        (src / f"d{i}.txt").write_text(f"text {i}")
    go()
    assert len(model.calls()) == 5
    files_before = sorted(str(p) for p in (tmp_path / "done").rglob("*.parquet"))
    # the last batch, as if the stream had died before it noted its end: the marker tells
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        p.unlink(missing_ok=True)
    go()
    assert sorted(str(p) for p in (tmp_path / "done").rglob("*.parquet")) == files_before and len(model.calls()) == 5
    # and as if it had died before the marker: its rows are written again, from the ledger
    for p in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        p.unlink(missing_ok=True)
    (mark,) = (tmp_path / "done" / "_batches").glob(f"*/{commits[-1].name}")
    mark.unlink()
    go()
    rows = spark.read.parquet(done)
    assert len(model.calls()) == 5 and sorted(r.doc_id for r in rows.collect()) == [f"d{i}" for i in range(5)]
    # a new stream leaves out what the table has
    (src / "new.txt").write_text("new")
    watch(spark, str(src), done, str(tmp_path / "state2"), model, "m", "p", settings(), wait=0).awaitTermination()
    assert len(model.calls()) == 6 and spark.read.parquet(done).count() == 6
    files.remove(spark, state)
    with pytest.raises(ValueError, match="not there any more"):
        go()


def test_merged_parts_of_many_kinds(spark):
    rows = [(1, 1, "b", {"X": ["2", "1"], "Y": []}), (1, 0, "a", {"X": ["1", "1"]}), (1, 2, None, None), (2, 0, "c", {})]
    answers = spark.createDataFrame(rows, "doc_id int, part int, tagged_text string, entities map<string,array<string>>")
    out = {r.doc_id: r for r in annotate.merge_parts(answers, ["doc_id"]).collect()}
    assert (out[1].tagged_text, out[1].entities) == ("a\n\nb", {"X": ["1", "2"], "Y": []}) and (out[2].tagged_text, out[2].entities) == ("c", {})
    all_ = {r.doc_id: r for r in annotate.merge_parts(answers, ["doc_id"], True).collect()}
    assert all_[1].entities["X"] == ["1", "1", "1", "2"]
    plan = annotate.merge_parts(answers, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
