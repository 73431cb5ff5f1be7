import random

import public_tokenizers
import pytest

from glossa.llm import tokencount


def library_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'S", "1", "23", "é", "ß", "<|endoftext|>", "!", "..", "中", "😀", "\x00", "-", "\r\n", "the", " thing", "²"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    path, sample = public_tokenizers.path(name), texts(600)
    assert tokencount.counter(path)(sample) == library_counts(path, sample)


def test_small_memory_of_words(monkeypatch):
    path, sample = public_tokenizers.path("byte_bpe_50k.json"), texts(200)
    monkeypatch.setattr(tokencount, "MAX_WORDS", 10)
    assert tokencount.counter(path)(sample) == library_counts(path, sample)


def test_cache(spark, make, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    rows = [(None, None), (1, ""), (2, "one two"), (2, "one two"), (3, "é" * 50_000), (4, "word " * 2000)]
    want = sorted((str(i), len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library_counts(path, [t or "" for _, t in rows]), strict=True))
    run = lambda docs: sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, path, cache).collect())
    assert run(make(rows, ["digest", "n_tokens"])) == want
    assert spark.read.parquet(cache).count() == 4  # distinct texts
    assert run(make([*rows, (5, "new")])) == sorted([*want, ("5", 3, 1, False)])
    assert spark.read.parquet(cache).count() == 5
    assert run(make([])) == []
    other = public_tokenizers.path("word_bpe_49k.json")
    tokencount.count_tokens(make([(1, "new")]), other, cache).collect()
    assert spark.read.parquet(cache).count() == 6  # another tokenizer has its own entries


def test_hits_stay_where_they_are(spark, make, tmp_path):
    """With a full cache and a hot text among the hits and one among the misses, only misses are encoded, each once."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    known = [(i, f"known text {i % 5}") for i in range(60)]
    tokencount.count_tokens(make(known), path, cache).collect()
    before = spark.read.parquet(cache).count()
    rows = [*known, *((100 + i, "a hot miss") for i in range(50)), (200, "one more"), (None, None), (None, "")]
    out = tokencount.count_tokens(make(rows, ["key", "digest"]), path, cache)
    want = library_counts(path, [t or "" for _, t in rows])
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(i), n) for (i, _), n in zip(rows, want, strict=True))
    added = spark.read.parquet(cache)
    assert before == 5 and added.count() == 8 == added.select("digest").distinct().count()
    tokencount.count_tokens(make(rows), path, cache).collect()
    assert spark.read.parquet(cache).count() == 8
