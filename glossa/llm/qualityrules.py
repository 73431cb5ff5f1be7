"""Quality rules as weak supervision: rules vote or abstain, and a label model weighs them.

One pass computes the statistics of every whole text and the rules' votes; the votes of
all documents, counted by pattern, give the rules' accuracies by expectation-
maximisation; a document is kept if its posterior probability of good quality is at
least one half and none of the two base rules rejects it.  Only pattern counts (at most
3^rules) reach the driver.

Defined cases: null and empty texts have no words, fail the base rule and are not kept;
repeated documents are judged each alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import weaksup
from glossa.llm.shared import table, written
from glossa.llm.wordhash import find_words, hash_runs, hash_windows, mix, same_bytes, space_words, word_numbers

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes long"
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeats", "letters", "upper_case", "marks")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(0x41, 0x5B)))
_LETTER = _table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
_MARK = _table(b"!?|~^=_\\@")
_FIRST_BYTE = ~_table(bytes(range(0x80, 0xC0)))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags stand in each [bounds[i], bounds[i+1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def repeated(keys: np.ndarray, owner: np.ndarray, equal, exact) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does its owner have the same thing twice or more; is it a later one of those?

    Keys are hashes.  equal(i, j): are the things behind these keys the same; exact(i):
    something hashable that tells the thing, for the rare keys whose hashes collide.
    """
    with np.errstate(over="ignore"):
        both = keys ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    i, j = order[:-1][same], order[1:][same]
    wrong = ~((owner[i] == owner[j]) & equal(i, j)) if len(i) else np.zeros(0, bool)
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    for hash_ in set(both[j[wrong]].tolist()):
        first: dict = {}
        for k in np.flatnonzero(both == np.uint64(hash_)).tolist():
            before = first.setdefault((int(owner[k]), exact(k)), k)
            later[k], any_[k] = before != k, before != k
            any_[before] |= before != k
    return any_, later


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics of each text, and further counts that the rules read (one column each)."""
    n = len(column)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    more = np.zeros((n, 5), np.int64)  # bytes, letters, upper-case letters, marks, lines with words
    for w in find_words(column, space_words(), lower=False):
        at = slice(w.row, w.row + w.documents)
        out["n_words"][at] = np.diff(w.first)
        total = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_FIRST_BYTE[w.data], out=total[1:])
        chars = np.concatenate([[0], np.cumsum(total[w.end] - total[w.start])])
        out["word_chars"][at] = np.diff(chars[w.first])
        out["n_symbols"][at] = _sums(_SYMBOL[w.data], w.text)
        for j, flags in enumerate((_LETTER, _UPPER, _MARK), 1):
            more[at, j] = _sums(flags[w.data], w.text)
        more[at, 0] = np.diff(w.text)
        # windows of words that their text has twice
        h, owner = hash_windows(w.hash, REPEAT_WINDOW), w.owner()
        inside = np.flatnonzero(np.arange(len(h)) + REPEAT_WINDOW <= w.first[1:][owner[: len(h)]])

        def windows(i: np.ndarray) -> np.ndarray:  # the words of windows, by place
            return inside[i, None] + np.arange(REPEAT_WINDOW)  # noqa: B023

        def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            own, places = np.unique(np.stack([windows(i), windows(j)]), return_inverse=True)
            numbers = word_numbers(w, own=own)[places.reshape(2, len(i), REPEAT_WINDOW)]  # noqa: B023
            return (numbers[0] == numbers[1]).all(axis=1)

        def exact(i: int) -> tuple:
            return tuple(w.data[w.start[k] : w.end[k]].tobytes() for k in windows(np.array([i]))[0].tolist())  # noqa: B023

        twice, _ = repeated(h[inside], owner[inside], equal, exact)
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, inside[twice], 1)
        np.add.at(cover, inside[twice] + REPEAT_WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out["n_repeat_words"][at] = _sums(covered, w.first)
        # lines with a word that their text has had before
        breaks = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate([w.text[:-1], breaks + 1]))
        line_owner = np.searchsorted(w.text[1:], start, "right") if len(w.data) else np.zeros(len(start), np.int64)
        keep = line_owner < w.documents
        start, line_owner = start[keep], line_owner[keep]
        end = np.minimum(np.append(start[1:], len(w.data)), w.text[1:][line_owner])
        # a line ends before its line break
        end = end - ((end > start) & (w.data[np.maximum(end - 1, 0)] == 10) if len(w.data) else 0)
        end = np.maximum(end, start)
        wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end, line_owner = start[wordy], end[wordy], line_owner[wordy]
        _, later = repeated(
            hash_runs(w.data, start, end), line_owner,
            lambda i, j: same_bytes(w.data, start[i], end[i], w.data, start[j], end[j]),  # noqa: B023
            lambda i: w.data[start[i] : end[i]].tobytes(),  # noqa: B023
        )
        out["n_dup_lines"][at] = np.bincount(line_owner[later], minlength=w.documents)
        more[at, 4] = np.bincount(line_owner, minlength=w.documents)
    return out, more


def vote(stats: dict[str, np.ndarray], more: np.ndarray) -> np.ndarray:
    """One column a rule of RULES: ABSTAIN, BAD or GOOD."""
    n = stats["n_words"]
    words, bytes_, lines = np.maximum(n, 1), np.maximum(more[:, 0], 1), np.maximum(more[:, 4], 1)
    length = stats["word_chars"] / words

    def rule(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(n == 0, weaksup.ABSTAIN, np.where(bad, weaksup.BAD, np.where(good, weaksup.GOOD, weaksup.ABSTAIN)))

    repeats, doubles = stats["n_repeat_words"] / words, stats["n_dup_lines"] / lines
    symbols, letters = stats["n_symbols"] / words, more[:, 1] / bytes_
    upper, marks = more[:, 2] / np.maximum(more[:, 1], 1), more[:, 3] / words
    return np.stack([
        rule(n < LEAST_WORDS, n >= 50),
        rule((length < 2.5) | (length > 12), (length > 3) & (length < 9)),
        rule(symbols > 0.1, symbols < 0.02),
        rule(doubles > 0.3, doubles < 0.1),
        rule(repeats > 0.3, repeats < 0.1),
        rule(letters < 0.6, letters > 0.7),
        rule(upper > 0.4, upper < 0.15),
        rule(marks > 0.1, marks < 0.03),
    ], axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats, more = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in stats.values()), pa.array(weaksup.encode(vote(stats, more)))], ["doc_id", *stats, "votes"])


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and quality (the posterior)."""
    stats = written(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_measure, STATS), "rules")
    counted = stats.groupBy("votes").count().collect()  # at most 3^8 rows
    patterns = np.array([r["votes"] for r in counted], np.int64)
    votes = weaksup.decode(patterns, len(RULES))
    model = weaksup.fit(votes, np.array([r["count"] for r in counted], float))
    quality = stats.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, model.posterior(votes), strict=True)], "votes long, quality double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return stats.join(F.broadcast(quality), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The label model is iterative: no SQL; the tests hold it against brute force.
SQL = None
