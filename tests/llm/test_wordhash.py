"""Hashes of words: no collision by structure, and exact numbers where hashes do collide."""

import numpy as np
import pyarrow as pa

from glossa.llm import jaccard, qualityrules, wordhash
from glossa.llm.wordhash import find_words, hash_runs, same_bytes, space_words, word_numbers


def thue_morse(n):
    """Two complementary words of 2^n letters: they collide under every polynomial modulo 2^64 if n is 10 or more."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_runs_of_all_lengths():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    start = np.repeat(np.arange(40), 41)
    end = start + np.tile(np.arange(41), 40)
    hashes = hash_runs(data, start, end)
    texts = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert len(set(zip(texts, hashes.tolist(), strict=True))) == len(set(texts)) == len(set(hashes.tolist()))
    # the place in the block does not matter
    assert (hash_runs(data, start + 256, end + 256) == hashes).all()
    assert len(hash_runs(data, start[:0], end[:0])) == 0


def test_structured_words_do_not_collide():
    for n in (10, 12):
        words = [*thue_morse(n), "ab" * 2 ** (n - 1), "ba" * 2 ** (n - 1)]
        w = next(find_words(pa.array([" ".join(words)]), space_words()))
        assert len(set(w.hash.tolist())) == 4


def test_same_bytes():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    at = lambda *x: np.array(x)
    assert same_bytes(data, at(0, 0, 2, 1), at(3, 3, 2, 3), data, at(6, 3, 5, 1), at(9, 6, 5, 2)).tolist() == [True, False, True, False]


def test_numbers_tell_colliding_words_apart(monkeypatch):
    monkeypatch.setattr(wordhash, "hash_runs", lambda data, start, end: np.full(len(start), 7, np.uint64))
    numbers = wordhash.Numbers()
    first = word_numbers(next(find_words(pa.array(["a b a", "c b"]), space_words())), numbers)
    second = word_numbers(next(find_words(pa.array(["c a d"]), space_words())), numbers)
    assert first.tolist() == [0, 1, 0, 2, 1] and second.tolist() == [2, 0, 3]


def test_repeats_do_not_hang_on_hashes(monkeypatch):
    """Lines and windows are counted by their bytes even if all hashes are equal."""
    texts = ["a\nb\na\nc\nb\na", "b\na", "a b c d e f g h i a b c d e f g h j", "one two three four five six seven eight nine " * 2]
    want, _ = qualityrules.statistics(pa.array(texts))
    monkeypatch.setattr(qualityrules, "hash_runs", lambda data, start, end: np.full(len(start), 7, np.uint64))
    monkeypatch.setattr(qualityrules, "hash_windows", lambda words, size: np.full(max(0, len(words) - size + 1), 7, np.uint64))
    got, _ = qualityrules.statistics(pa.array(texts))
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    assert got["n_dup_lines"].tolist() == [3, 0, 0, 0] and got["n_repeat_words"].tolist() == [0, 0, 16, 18]


def test_documents_of_structured_words(make):
    a, b = thue_morse(10)
    docs = make([(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a} x"), (5, f"{a}\n{b}\n{a}")])
    assert {r.doc_id: r.component_id for r in jaccard.report(docs).collect()} == {i: i for i in range(1, 6)}
    assert {r.doc_id: r.n_dup_lines for r in qualityrules.judge(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
