"""Many values at once and packing by tokens, against the plain ways that they replace."""

import random
import re
import time

import pytest

from pyspark.sql import functions as F

from glossa.functions import inline

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def plain_places(text, value):
    out, at = [], text.find(value) if value else -1
    while at >= 0:
        out.append(at)
        at = text.find(value, at + 1)
    return out


def plain_loose(text, value):
    value = inline.fold_marks(value)
    return [m.span() for m in re.finditer(re.escape(value), inline.fold_marks(text), re.IGNORECASE)] if value else []


@pytest.mark.parametrize("seed", range(5))
def test_all_occurrences(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("abé😀 ", k=400))
    values = ["".join(rng.choices("abé😀 ", k=rng.randrange(0, 4))) for _ in range(rng.choice([3, 60]))]
    assert inline.all_occurrences(text, values) == {v: plain_places(text, v) for v in values}


@pytest.mark.parametrize("seed", range(5))
def test_placed_entities(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("aab ", k=300))
    entities = {t: ["".join(rng.choices("ab ", k=rng.randrange(0, 4))) for _ in range(rng.choice([2, 40]))] for t in "XYZ"}
    want = [(p, p + len(v), t, v) for t, values in entities.items() for v in dict.fromkeys(values) for p in inline.first_occurrences(text, v, values.count(v))]
    assert inline.place_entities(text, entities) == want


@pytest.mark.parametrize("seed", range(5))
def test_loose_matches(seed):
    rng = random.Random(seed)
    letters = "aÁáäsSſßkKKİiıIμµΜσςΣǅǆ ñÑ."
    text = "".join(rng.choices(letters, k=300))
    values = ["".join(rng.choices(letters, k=rng.randrange(0, 3))) for _ in range(40)]
    assert inline.all_loose_matches(text, values) == [plain_loose(text, v) for v in values]


def test_characters_that_are_equal_whatever_their_case():
    """The table agrees with regular expressions on every character and its relatives."""
    table = inline._one_case()
    one = lambda c: c.translate(table)
    for code in range(0x20, 0x1E944):
        c = chr(code)
        for other in {c.lower(), c.upper(), c.casefold(), c.swapcase(), one(c)} - {c}:
            if len(other) == 1:
                assert (re.fullmatch(re.escape(other), c, re.IGNORECASE) is not None) == (one(c) == one(other)), (c, other)


def test_many_values_take_near_linear_time():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    words = [word() for _ in range(150_000)]
    text, values = " ".join(words), words[:5000] + [word() for _ in range(5000)]
    began = time.perf_counter()
    spans = inline.place_entities(text, {"X": values})
    took = time.perf_counter() - began
    assert len(spans) >= 5000 and took < 10
    for a, b, _, v in spans[:200]:
        assert text[a:b] == v and a == text.find(v)
    tagged = " ".join(f"<X>{w}</X>" for w in words[:5000])
    assert len(inline.align(text, tagged)) == 5000


def plain_pack(text, length, limit, template="{texto_clinico}"):
    """Line by line, the whole prompt measured for each."""
    whole = lambda lines: length(template.replace("{texto_clinico}", "\n".join(lines)))
    out, held = [], []
    for line in filter(str.strip, text.split("\n")):
        if held and whole([*held, line]) >= limit:
            out.append(held)
            held = []
        held.append(line)
    out += [held] if held else []
    return [("\n".join(x), whole(x) >= limit) for x in out]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("template", ["{texto_clinico}", "Tarea: {texto_clinico}\n\nFin", "{texto_clinico} y {texto_clinico}", "nothing"])
def test_packing(seed, template):
    rng = random.Random(seed)
    text = "\n".join(rng.choice(["", " ", "a b", "word " * rng.randrange(1, 9), "x" * rng.randrange(1, 60)]) for _ in range(120))
    words = lambda t: len(re.findall(r"\w+|\n", t))
    for length in (len, words, lambda t: len(t.encode())):
        for limit in (1, 7, 30, 100, 5000):
            assert inline.pack_lines(text, length, limit, template) == plain_pack(text, length, limit, template), (limit,)


def test_packing_by_tokens():
    """The same chunks as line by line, and a tokenizer that reads a few times the text."""
    from tokenizers import Tokenizer

    tokenizer, read = Tokenizer.from_file(TOKENIZER), []

    def length(text):
        read.append(len(text))
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeio", k=rng.randrange(1, 9)))
    text = "\n".join(" ".join(word() for _ in range(rng.randrange(0, 14))) for _ in range(1500))
    template = "Busca los nombres.\n{texto_clinico}\n"
    for limit in (20, 200, 1843):
        read.clear()
        got = inline.pack_lines(text, length, limit, template)
        assert sum(read) < 8 * (len(text) + len(got) * len(template))
        assert got == plain_pack(text, length, limit, template)


@pytest.mark.parametrize("pattern", [1, 2, 3, 4])
def test_tag_counts_by_built_in_functions(spark, pattern):
    """The same numbers as the walk over matches, on random runs of brackets and tags."""
    rng = random.Random(pattern)
    parts = ["<", "<<<A>>>", "<<</A>>>", "<A>", "</A>", "<*A>", "<*/A>", "<*A*>", "<*/A*>", "<B_C>", "</B_C>", "x", "\n", " y", ">", "<<", "<b>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(500)] + ["<A>" + "x" * 50_000 + "</A><" * 3, ""]
    correct, wrong = inline.tag_counts_of(F.col("t"), pattern)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", correct.alias("c"), wrong.alias("w"), inline.without_tags(F.col("t")).alias("plain"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        n, bad = inline.compliance(texts[r.i], pattern)
        assert (r.c, r.w) == (n, len(bad)) and r.plain == inline.untagged(texts[r.i])
