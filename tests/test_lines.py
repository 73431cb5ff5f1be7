"""Files in many splits against the same files read as a whole, in plain Python."""

import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from glossa.sources import readers
from glossa.sources.lines import file_lines, numbered


@contextmanager
def splits(spark, size):
    """Files are cut into splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, str(size))
    yield
    for n in names:
        spark.conf.unset(n)


@pytest.fixture(params=[64, 700, 100_000_000])
def cut(spark, request):
    with splits(spark, request.param):
        yield request.param


def test_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\n" * 1000)
    with splits(spark, 200):
        assert file_lines(spark, str(tmp_path)).select("split_start").distinct().count() > 20
        assert [r.line_no for r in numbered(file_lines(spark, str(tmp_path))).orderBy("line_no").collect()] == list(range(1000))


def test_numbers(spark, tmp_path, cut):
    """Random ends and valid lines, and lines longer than a split."""
    rng = random.Random(cut)
    texts = {f"f{k}": [rng.choice(["", "-", "x", "x y", "y" * rng.choice([1, 300])]) for _ in range(rng.choice([0, 1, 40, 400]))] for k in range(8)}
    texts["plain"] = ["x"] * 500
    texts["ends"] = [""] * 300
    for name, lines in texts.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n" * bool(lines))
    line = F.col("line")
    got = {}
    for r in numbered(file_lines(spark, str(tmp_path)), line == "", line.startswith("x")).collect():
        got.setdefault(readers_stem(r.path), []).append((r.line_no, r.line, r.part, *((r.group_no, r.pos) if r.line.startswith("x") else ())))
    for name, lines in texts.items():
        part, group, pos, want = 0, 0, 0, []
        for i, x in enumerate(lines):
            if x == "":
                part, pos = part + 1, 0
            if x.startswith("x"):
                group += pos == 0
                pos += 1
                want.append((i, x, part, group, pos - 1))
            else:
                want.append((i, x, part))
        assert sorted(got.get(name, [])) == want, name


def readers_stem(path):
    return re.search(r"([^/]+)\.txt$", path)[1]


LOG = "2024-01-02 03:04:05,678 - "


def log(rng, n):
    out = ["preamble", ""]
    for i in range(n):
        head = LOG + "INFO - Procesando archivo: " if i % 7 else "glued " + LOG + "INFO - Procesando archivo: x.xml " + LOG + "INFO - Procesando archivo: "
        out.append(f"{head}doc{i}.xml")
        out.append(f"{LOG}INFO - Modelo: m{i % 3}")
        if i % 4:
            out.append(f"{LOG}INFO - Directorio de salida: out/prompt{i % 5}")
        if i % 3 == 0:
            out += [f"{LOG}WARNING - Error parseando JSON", f"{LOG}INFO - Respuesta cruda del modelo:", "{", '"a": 1', "", "}" if i % 2 else "", f"{LOG}INFO - Resumen final de entidades encontradas:"]
        out += ["free text " * rng.randrange(9)] * rng.randrange(3)
    return out


@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_logs(spark, tmp_path, cut, feed):
    for k, n in enumerate((0, 1, 60)):
        (tmp_path / f"run{k}.log").write_text(feed.join(log(random.Random(k), n)), newline="")
    whole = readers.whole_files(spark, str(tmp_path)).select(F.col("doc_id").alias("run"), "content")
    want, got = readers.blocks_of(whole), readers.log_blocks(spark, str(tmp_path))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 60
    lines = {(r.run, r.line_no, r.level, r.message) for r in readers.log_lines(spark, str(tmp_path)).collect()}
    assert lines == {(f"run{k}", i, m[1], m[2]) for k, n in enumerate((0, 1, 60)) for i, x in enumerate(log(random.Random(k), n)) if (m := re.match(rf"{re.escape(LOG)}(\w+) - (.*)$", x))}


def test_columns(spark, tmp_path, cut):
    rng = random.Random(7)
    files = {f"c{k}": [rng.choice(["", " ", "-DOCSTART- x x", "w1 N O", "w2 V B-PER", "broken", "three more fields here"]) for _ in range(n)] for k, n in enumerate((0, 3, 50, 600))}
    files["one"] = ["w N O"] * 300
    for name, lines in files.items():
        (tmp_path / f"{name}.txt").write_text("\r\n".join(lines), newline="")
    want = []
    for name, lines in files.items():
        doc, pos = 0, 0
        for x in lines:
            f = x.split()
            if not f or x.startswith("-DOCSTART-"):
                pos = 0
            elif len(f) > 2:
                doc += pos == 0
                want.append((name, doc, pos, *f[:3]))
                pos += 1
    assert sorted(map(tuple, readers.conll_tokens(spark, str(tmp_path)).collect())) == sorted(want)


def test_pairs(spark, tmp_path, cut):
    for name, n in (("a", 300), ("b", 0), ("c", 1)):
        (tmp_path / f"{name}.bio").write_text("".join(f"w{i} O\n" + "\n" * (i % 3) for i in range(n)))
    got = sorted((r.doc_id, r.pos, r.token) for r in readers.bio_tokens(spark, str(tmp_path)).collect())
    assert got == sorted([("a", i, f"w{i}") for i in range(300)] + [("c", 0, "w0")])
    (tmp_path / "d.bio").write_text("one two\nonly\n")
    with pytest.raises(Exception, match="not two fields"):
        readers.bio_tokens(spark, str(tmp_path)).collect()


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n" * 100)
    plan = readers.log_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("MapInArrow") :] if "MapInArrow" in plan else plan
    # only the one row a split goes through an exchange
    assert plan.count("hashpartitioning") <= 2 and "line" in lines
