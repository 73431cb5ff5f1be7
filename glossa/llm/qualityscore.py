"""Quality classifier without hand labels.

Heuristic labellers, each looking at one trait of a text, vote good or bad or abstain.
Expectation-maximisation over the votes of all documents (counted by pattern, at most
3^labellers of them) estimates how right each is, and gives every pattern a posterior
probability of good quality.  A linear scorer over hashed features of the text (byte
trigrams, and whether a word is like the one before or like an earlier one, by its
length) is trained to those posteriors on a bounded sample of the documents, the
SAMPLE_ROWS ones with the least hashes; it never sees a vote.  All documents are then scored with it, each task
with its own copy of the weights.  Only pattern counts and the sample are shuffled.

Defined cases: a null or empty text, or one without words, has score 0 and is rejected; repeated documents are
judged each alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import weaksup
from glossa.llm.qualityrules import statistics
from glossa.llm.shared import table, written
from glossa.llm.wordhash import blocks, find_words, mix, space_words

LABELLERS = ("symbols", "marks", "upper_case", "letters", "repeated_words", "repeated_windows", "word_length", "duplicate_lines")
#: Documents on which the scorer is trained, at most: a parameter of score().
SAMPLE_ROWS = 3000
BUCKETS = 4096
#: Hashed features of words: kinds of repetition by length of the word.
WORD_BUCKETS = 64
FEATURES = BUCKETS + WORD_BUCKETS
THRESHOLD = 0.5
LEAST_TRIGRAMS, LEAST_WORDS = 100, 20


def votes_of(column: pa.Array) -> np.ndarray:
    """One column a labeller: ABSTAIN, BAD or GOOD."""
    stats, more = statistics(column)
    n = stats["n_words"]
    doubles = np.zeros(len(column), np.int64)  # words like the one before
    for w in find_words(column, space_words(), lower=False):
        same = np.zeros(len(w.hash) + 1, np.int64)
        if len(w.hash) > 1:
            np.cumsum((w.hash[1:] == w.hash[:-1]) & ~np.isin(np.arange(1, len(w.hash)), w.first), out=same[2:])
        doubles[w.row : w.row + w.documents] = np.diff(same[w.first])
    words, bytes_, lines = np.maximum(n, 1), np.maximum(more[:, 0], 1), np.maximum(more[:, 4], 1)

    def labeller(value: np.ndarray, bad: float, good: float, least: int = 1) -> np.ndarray:
        vote = np.where(value > bad, weaksup.BAD, np.where(value < good, weaksup.GOOD, weaksup.ABSTAIN))
        return np.where(n < least, weaksup.ABSTAIN, vote)

    length = stats["word_chars"] / words
    return np.stack([
        labeller(stats["n_symbols"] / words, 0.1, 0.02),
        labeller(more[:, 3] / words, 0.15, 0.03),
        labeller(more[:, 2] / np.maximum(more[:, 1], 1), 0.3, 0.15, 3),
        labeller(1 - more[:, 1] / bytes_, 0.4, 0.25, 5),
        labeller(doubles / words, 0.2, 0.05, 5),
        labeller(stats["n_repeat_words"] / words, 0.5, 0.1, 20),
        labeller(np.abs(length - 6), 4.5, 3.0, 5),
        labeller(stats["n_dup_lines"] / lines, 0.5, 0.1, 3),
    ], axis=1)


def _word_features(column: pa.Array) -> np.ndarray:
    """Shares of a text's words by hashed kind: new, like an earlier one of the text, like the one before; and by length."""
    out = np.zeros((len(column), WORD_BUCKETS), np.float32)
    for w in find_words(column, space_words(), lower=False):
        n, owner = w.documents, w.owner()
        order = np.lexsort((np.arange(len(owner)), w.hash, owner))
        seen = np.zeros(len(owner), np.uint64)
        seen[order[1:]] = (w.hash[order[1:]] == w.hash[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        seen[1:] += ((w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])).astype(np.uint64)
        kind = mix(np.stack([seen, seen << np.uint64(8) | np.minimum(w.end - w.start, 20).astype(np.uint64) + np.uint64(1 << 16)])) % np.uint64(WORD_BUCKETS)
        counts = sum(np.bincount(owner * WORD_BUCKETS + k.astype(np.int64), minlength=n * WORD_BUCKETS) for k in kind).reshape(n, WORD_BUCKETS)
        out[w.row : w.row + n] = counts / np.maximum(np.diff(w.first), LEAST_WORDS)[:, None]
    return out


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each block: number of its first document, and a row of features for each of its documents."""
    words = np.sqrt(_word_features(column))
    for data, text, row in blocks(column):
        n = len(text) - 1
        code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(text))[: len(code)]
        inside = np.arange(len(code)) + 3 <= text[1:][owner]
        for at in range(0, n, 256):  # bounds the dense rows
            own = slice(*np.searchsorted(owner, [at, min(at + 256, n)]))
            rows = min(256, n - at)
            counts = np.bincount((owner[own] - at)[inside[own]] * BUCKETS + bucket[own][inside[own]], minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)
            counts /= np.maximum(counts.sum(axis=1, keepdims=True), LEAST_TRIGRAMS)  # short texts say less
            yield row + at, np.concatenate([np.sqrt(counts), words[row + at : row + at + rows]], axis=1)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> Scorer:
    """Logistic regression to probabilities, by gradient steps with momentum."""
    weights, bias = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return Scorer(weights, bias)
    speed, speed0 = np.zeros_like(weights), 0.0
    for _ in range(rounds):
        error = ((1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y)).astype(np.float32)
        speed = 0.9 * speed - 0.5 * (x.T @ error / len(x) + ridge * weights)
        speed0 = 0.9 * speed0 - 0.5 * float(error.mean())
        weights, bias = weights + speed, bias + speed0
    return Scorer(weights, bias)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(weaksup.encode(votes_of(batch.column("text"))))], ["h", "votes"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = weaksup.encode(votes_of(batch.column("text")))
        for row, x in features(batch.column("text")):
            at = slice(row, row + len(x))
            yield pa.RecordBatch.from_arrays([batch.column("h")[at], pa.array(votes[at]), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["h", "votes", "x"])


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """The scorer, from all documents' votes and a sample's features."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 40)).alias("h")).where("text is not null and text <> ''")
    votes = written(rows.mapInArrow(_vote, "h long, votes long"), "votes")
    counted = votes.groupBy("votes").count().collect()  # at most 3^8 rows
    patterns = np.array([r["votes"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], float)
    model = weaksup.fit(weaksup.decode(patterns, len(LABELLERS)), counts)
    posterior = dict(zip(patterns.tolist(), model.posterior(weaksup.decode(patterns, len(LABELLERS))).tolist(), strict=True))
    # rows alike in id and text share a hash and count once; of the rest some more than needed are looked at, and the least hashes taken
    below = int((1 << 40) * min(1.0, 1.5 * sample_rows / max(counts.sum(), 1)))
    near = rows.where(F.col("h") < below).dropDuplicates(["h"]).select("h", "text").mapInArrow(_featured, "h long, votes long, x binary")
    picked = near.orderBy("h").limit(sample_rows).collect()
    x = np.stack([np.frombuffer(r.x, np.float16).astype(np.float32) for r in picked]) if picked else np.zeros((0, FEATURES), np.float32)
    return train(x, np.array([posterior[r.votes] for r in picked], np.float32))


def _scores(scorer: Scorer, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for row, x in features(column):
        out[row : row + len(x)] = np.where(x[:, BUCKETS:].any(axis=1), scorer(x), 0.0)
    return out


def score(docs: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score (probability of good quality) and kept of every document."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(scorer.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(s >= threshold)], ["doc_id", "score", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all their columns as they were, that the scorer keeps."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer.value, batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


#: The model is fitted: no SQL; the tests hold it against labels that it has not seen.
SQL = None
