"""The command line's scores of two small folders."""

import pytest

from glossa.__main__ import parser, scores


@pytest.fixture
def folders(tmp_path):
    def put(name, lines):
        d = tmp_path / name
        d.mkdir()
        (d / "d.txt").write_text("Ana Gil de 34 años, Madrid")
        (d / "d.ann").write_text("".join(f"T{i}\t{t} {a} {b}\tx\n" for i, (t, a, b) in enumerate(lines, 1)))
        return str(d)

    gold = put("gold", [("NAME", 0, 3), ("NAME", 4, 7), ("AGE", 11, 18), ("LOC", 20, 26)])
    one = put("one", [("NAME", 0, 7), ("AGE", 11, 13), ("LOC", 20, 26)])
    return gold, one


@pytest.mark.parametrize("args, want", [(["official", "brat", "ner"], (1, 2, 3)), (["official", "brat", "spans"], (1, 2, 3)), (["official", "brat", "merged"], (2, 1, 1)), (["relaxed", "brat"], (3, 1, 1)), (["relaxed", "brat", "-v", "--ignore-tags"], (3, 1, 1))])
def test_scores(spark, folders, args, want):
    r = scores(spark, parser().parse_args([*args, *folders])).first()
    assert r.system == "one" and (r.tp, r.fp, r.fn) == want


def test_leak(spark, folders):
    gold, one = folders
    args = ["official", "brat", "ner", gold, one, "--sentences", gold]
    assert scores(spark, parser().parse_args(args)).first().leak == 3 / 4


def test_bad_subtrack():
    with pytest.raises(SystemExit):
        parser().parse_args(["official", "brat", "other", "a", "b"])


def test_tags_and_comparison(spark, folders):
    gold, one = folders
    got = {r.tag: (r.tp, r.fp, r.fn) for r in scores(spark, parser().parse_args(["tags", "brat", gold, one])).collect()}
    assert got == {"NAME": (0, 1, 2), "AGE": (0, 1, 1), "LOC": (1, 0, 0)}
    got = {r.tag: r.f1_diff for r in scores(spark, parser().parse_args(["compare", "brat", gold, one, gold])).collect()}
    assert got == {"NAME": 1.0, "AGE": 1.0, "LOC": 0.0}
    with pytest.raises(SystemExit):
        scores(spark, parser().parse_args(["compare", "brat", gold, one, one]))


def test_errors(spark, folders):
    report = scores(spark, parser().parse_args(["errors", "brat", *folders])).first()
    assert report.doc_id == "d" and "Inclusions (1):\n  [0-7] 'Ana Gil' holds 2" in report.value


def test_chunks_and_logs(spark, tmp_path, capsys):
    for name, files in {"g": {"a": "Ana B-PER\nve O\n", "b": "x O\n"}, "p": {"a": "Ana B-PER\nve O\n", "b": "x O\ny O\n"}}.items():
        (tmp_path / name).mkdir()
        for doc, lines in files.items():
            (tmp_path / name / f"{doc}.bio").write_text(lines)
    got = {r.type: (r.n_gold, r.n_correct) for r in scores(spark, parser().parse_args(["chunks", str(tmp_path / "g"), str(tmp_path / "p")])).collect()}
    assert got == {None: (1, 1), "PER": (1, 1)} and "b: line count" in capsys.readouterr().out
    (tmp_path / "logs").mkdir()
    stamp = "2024-05-01 10:00:00,000 - INFO - "
    (tmp_path / "logs" / "run.log").write_text("".join(f"{stamp}Procesando archivo: f{i}.xml\nModelo: m\nDirectorio de salida: out/prompt1\n{'Error parseando JSON' if i else ''}\n" for i in range(3)))
    r = scores(spark, parser().parse_args(["logs", str(tmp_path / "logs")])).first()
    assert (r.model, r.prompt, r.total, r.failed) == ("m", "prompt1", 3, 2)
