"""Line dedup against a loop over all chunks, and on planted passages."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from glossa.llm import linededup as d
from glossa.llm.wordhash import find_words, space_words


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}{rng.choice(['', '', '', '.', ','])}" for _ in range(n))


def chunks(text):
    """(bytes, lines, words, first byte, end byte, head) of each chunk of one text."""
    w = next(find_words(pa.array([text]), space_words(), lower=False), None)
    if w is None or not len(w.start):
        return []
    c = d.cut(w)
    out = []
    for j in range(len(c.hash)):
        a, b = int(w.start[c.first[j]]), int(w.end[c.first[j + 1] - 1])
        out.append((bytes(w.data[a:b]), int(c.lines[j]), int(c.first[j + 1] - c.first[j]), a, b))
    return out


def brute(rows):
    """Removed words of each different (id, text), by marking every later occurrence of equal bytes."""
    places, marked = defaultdict(list), defaultdict(set)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, (raw, lines, *_) in enumerate(chunks(t or "")):
            if lines > 1:
                places[raw].append((i, t, k))
    for found in places.values():
        for i, t, k in found[1:]:
            marked[i, t].add(k)
    out = {}
    for i, t in set(rows):
        c, m = chunks(t or ""), set(marked[i, t])
        removed, k = 0, 0
        while k < len(c):
            e = k
            while e in m:
                e += 1
            words = sum(x[2] for x in c[k:e])
            removed += words if e > k and words >= d.LEAST_WORDS else 0
            k = max(e, k + 1)
        out[i, t] = removed
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (55, 80, 9, 30)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.choice([3, 20, 60])) for _ in range(rng.randrange(1, 5))]
        for p in passages:
            if rng.random() < 0.4:
                parts.insert(rng.randrange(len(parts) + 1), p)
        rows.append((i, "\n".join(parts)))
    return passages, [*rows, (100, rows[3][1]), (5, rows[5][1])]


@pytest.mark.parametrize("seed", range(2))
def test_report(make, seed):
    _, rows = corpus(seed)
    rows = [*rows, (None, None), (200, None), (201, ""), (202, "  \n "), (203, "x" * 50_000), (204, "same words. " * 4000)]
    got = d.report(make(rows, ["nos", "key", "hash"])).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_removed_words) for r in got) == sorted((str(i), want[i, t]) for i, t in rows)


def test_planted_passages_go(make):
    passages, rows = corpus(7)
    docs = make(rows, ["nos"])
    cleaned = d.clean(docs)
    assert cleaned.columns == docs.columns
    texts = [r.text for r in cleaned.collect()]
    for p in (p for p in passages if len(p.split()) > 50):
        assert sum(p in t for _, t in rows) > 2 and sum(p in t for t in texts) == 1
    # what stands once stays
    alone = [line for _, t in rows[:40] for line in t.split("\n") if sum(line in u for _, u in rows) == 1]
    assert all(any(line in t for t in texts) for line in alone)


def test_copies_are_emptied(make):
    rng = random.Random(3)
    text = prose(rng, 120)
    docs = make([(1, text), (2, text), (3, prose(rng, 60)), (4, ""), (5, None)])
    assert {r.doc_id: r.text for r in d.clean(docs).collect()}[2] == ""
    assert {r.doc_id for r in d.clean(docs, drop_emptied=True).collect()} == {1, 3, 4, 5}


def test_an_insertion_shifts_few_boundaries():
    rng = random.Random(5)
    words = prose(rng, 2000).split()
    a = {c[0] for c in chunks(" ".join(words))}
    b = {c[0] for c in chunks(" ".join(words[:1000] + ["inserted"] + words[1000:]))}
    assert len(a - b) <= 4


def test_empty(make):
    assert d.report(make([])).count() == 0 and d.clean(make([])).count() == 0


def planted(rng, passage, join):
    """Two texts with the passage between words of their own."""
    return [join.join([prose(rng, 150), passage, prose(rng, 150)]) for _ in range(2)]


def removed(texts):
    """Words removed of the second of two texts, by what cut() and removals() say."""
    seen = {c[0] for c in chunks(texts[0])}
    w = next(find_words(pa.array(texts[1:]), space_words(), lower=False))
    c = d.cut(w)
    nos = [k for k, x in enumerate(chunks(texts[1])) if x[0] in seen]
    return sum(int(c.first[b] - c.first[a]) for a, b in d.removals(w, c, 0, nos, d.LEAST_WORDS))


def test_passages_amid_longer_lines_go():
    rng = random.Random(11)
    gone = [removed(planted(rng, prose(rng, n), " ")) / n for n in range(51, 61) for _ in range(10)]
    assert sum(g == 0 for g in gone) <= 1 and sum(gone) / len(gone) > 0.7


def test_a_passage_amid_a_longer_line_goes(make):
    rng = random.Random(12)
    rows = [(10 * n + k, t) for n in range(51, 61) for k, t in enumerate(planted(rng, prose(rng, n), " "))]
    got = {r.doc_id: r.n_removed_words for r in d.report(make(rows)).collect()}
    assert all(got[10 * n] == 0 for n in range(51, 61)) and sum(got[10 * n + 1] >= d.LEAST_WORDS for n in range(51, 61)) >= 9


def test_blocks_of_short_lines_go_whole(make):
    rng = random.Random(13)
    rows, sizes = [], {}
    for n in range(8):
        lines = [prose(rng, k) for k in (8, 8, 3, 8, 1, 8, 8, 2, 8, 8)]
        sizes[10 * n + 1] = sum(len(x.split()) for x in lines)
        rows += [(10 * n + k, t) for k, t in enumerate(planted(rng, "\n".join(lines), "\n"))]
    got = {r.doc_id: r.n_removed_words for r in d.report(make(rows)).collect()}
    assert {i: got[i] for i in sizes} == sizes


def test_a_lone_short_line_that_stands_once_stays(make):
    rng = random.Random(14)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [r.text for r in d.clean(make([(1, f"{a}\n{b}"), (2, f"{a}\nonce\n{b}"), (3, f"{a}\njust once\n{b}")])).orderBy("doc_id").collect()]
    assert [t.split() for t in texts[1:]] == [["once"], ["just", "once"]]


# The rules once more, in plain Python over single words, without the module's code.

ALL = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def mix_one(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def word_hash(word):
    pieces = [word[i : i + 8] for i in range(0, len(word), 8)]
    total = sum(mix_one(int.from_bytes(p, "little") ^ mix_one((i * GOLDEN + 1) & ALL)) for i, p in enumerate(pieces)) & ALL
    return mix_one(total ^ mix_one(len(word)))


def plain_chunks(text):
    """(first byte, end byte, words, begins a physical line) of each chunk."""
    raw = text.encode()
    lines = []  # lists of words (start, end) and whether the line begins and ends a physical line
    for m in re.finditer(rb"[^\n]+", raw):
        words = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(rb"[^\x20\x09-\x0D]+", m.group())]
        if not words:
            continue
        cuts = [k for k, (a, b) in enumerate(words[:-1]) if raw[b - 1 : b] in (b".", b"!", b"?") or word_hash(raw[a:b]) % d.WORDS_A_LINE == 0]
        if not cuts and len(words) > 1:
            cuts = [0]
        ends = [k + 1 for k in cuts] + [len(words)]
        lines += [(words[a:b], a == 0, b == len(words)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    lone = [opens and closes for _, opens, closes in lines]  # one word alone on its line
    forced = [closes and (i + 1 == len(lines) or not lone[i] or not lone[i + 1]) for i, (_, _, closes) in enumerate(lines)]
    c1, c2 = (mix_one((i + (13 << 20)) * GOLDEN & ALL) | 1 for i in (1, 2))
    last = [word_hash(raw[w[-1][0] : w[-1][1]]) for w, _, _ in lines]
    head = [i == 0 or forced[i - 1] for i in range(len(lines))]
    roll = [mix_one((last[i] * c1 + (0 if head[i] else last[i - 1]) * c2) & ALL) for i in range(len(lines))]
    out, own = [], []
    for i, (words, opens, _) in enumerate(lines):
        own += [(words, opens)]
        inner = not forced[i] and not head[i] and not forced[i + 1]
        if forced[i] or inner and roll[i] < roll[i - 1] and roll[i] <= roll[i + 1]:
            out.append((own[0][0][0][0], own[-1][0][-1][1], sum(len(w) for w, _ in own), own[0][1]))
            own = []
    return out


def plain_report(rows):
    """(id, words, chunks, removed words, removed chunks, digest) of each row."""
    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    texts, seen, later = {}, {}, defaultdict(set)
    for row in order:
        texts[row] = plain_chunks(row[1] or "")
        for k, (a, b, *_) in enumerate(texts[row]):
            if seen.setdefault((row[1] or "").encode()[a:b], (row, k)) != (row, k):
                later[row].add(k)
    out = []
    for row in rows:
        raw, chunks_, marks = (row[1] or "").encode(), texts[row], later[row]
        kept, at, words, gone, k = [], 0, 0, 0, 0
        while k < len(chunks_):
            e = k
            while e in marks:
                e += 1
            n = sum(c[2] for c in chunks_[k:e])
            if e > k and n >= d.LEAST_WORDS:
                words, gone = words + n, gone + e - k
                if chunks_[k][3]:  # with what parts it from the next word
                    kept.append(raw[at : chunks_[k][0]])
                    at = chunks_[e][0] if e < len(chunks_) else len(raw)
                else:  # from the end of the word before
                    kept.append(raw[at : chunks_[k - 1][1]])
                    at = chunks_[e - 1][1]
            k = max(e, k + 1)
        sha = hashlib.sha256(b"".join([*kept, raw[at:]])).hexdigest()
        out.append((str(row[0]), sum(c[2] for c in chunks_), len(chunks_), words, gone, sha))
    return sorted(out)


@pytest.mark.parametrize("seed, most", [(21, 1000), (22, 1), (23, 40)])
def test_against_the_rules(make, monkeypatch, seed, most):
    """Also without hot chunks, and with many of them."""
    monkeypatch.setattr(d.repeated_chunks, "__defaults__", (most,))
    _, rows = corpus(seed)
    rows = [(i, t.replace("c1", "é") if i and i % 5 == 0 else t) for i, t in rows]
    rows += [(None, None), (None, rows[2][1]), (None, rows[2][1]), (200, None), (201, ""), (202, "  \n "), (203, "x" * 9_000), (204, "x" * 9_000), (205, "same words. " * 400), (206, "a\nb\nc\n" * 30)]
    got = d.report(make(rows, ["nos", "key", "id"])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_chunks, r.n_removed_words, r.n_removed_chunks, r.text_sha256) for r in got) == plain_report(rows)


def lines_of(rng, *sizes):
    return [prose(rng, n) for n in sizes]


@pytest.mark.parametrize("seed", range(4))
def test_several_repeated_lines_go_and_a_single_one_stays(make, seed):
    """Two lines of 8 and 7 words in six documents go from five of them; a line of 12 words stays, and so do two lines of three words."""
    rng = random.Random(seed)
    two, one, short = lines_of(rng, 8, 7), lines_of(rng, 12), lines_of(rng, 3, 3)
    rows = []
    for i in range(6):
        rows.append((i, "\n".join([*lines_of(rng, 9, 14), *two, *lines_of(rng, 11, 6)])))
        rows.append((10 + i, "\n".join([*lines_of(rng, 9, 14), *one, *lines_of(rng, 11, 6)])))
        rows.append((20 + i, "\n".join([*lines_of(rng, 9, 14), *short, *lines_of(rng, 11, 6)])))
    got = {r.doc_id: r.n_removed_words for r in d.report(make(rows)).collect()}
    assert [got[i] for i in range(6)] == [0, 15, 15, 15, 15, 15]
    assert all(got[i] == 0 for i in got if i >= 10)
    texts = {r.doc_id: r.text for r in d.clean(make(rows)).collect()}
    assert texts[1] == rows[3][1].replace("\n".join(two) + "\n", "")
