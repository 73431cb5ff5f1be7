"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded texts.

Folding undoes disguises: small letters without accents, look-alikes of other scripts and
digits or signs that stand for letters become the letter that they look like; i, l and 1
are one letter, and so is ! or | between two others.  What is no letter or digit then parts words.

Terms are beginnings of folded words (so "idiot" finds "idiots"), learned with their
weights from labels: for each beginning the different contexts (word before, word, word
after) in toxic and in other texts are counted, so near copies count once; the weight is
the logarithm of the ratio of the two shares, and a term needs a ratio that is large beyond
doubt.  Of terms that begin alike the one that tells most is taken.  Exception phrases
(given ones, and those of one or two words that the labels show to be harmless) hide the
terms that lie within them.

A text's score is a logistic function of the logarithms of its sum of weights and of its
number of words, so that weights are normalised by length; how strongly is fitted.

Learning looks at a sample: of each class the LEARN_ROWS labelled documents with the least
hashes of doc_id, told before any text is read.  All texts are scored whole, where they stand.

Defined cases: null and empty texts have no words and get the score of a text without a
term; rows alike score alike; a doc_id with several label rows counts as toxic if one says
so, null and other labels say nothing; a null doc_id is not held out and has no label;
without labels of both classes every score is 0; an empty table gives an empty result;
columns of other names are not looked at.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written

#: Labelled documents of each class from which is learned, at most: a parameter of learn().
LEARN_ROWS = 4000
#: Terms, and phrases, of a lexicon at most: bounds what is sent to every task.
MOST_TERMS = 5000
#: Letters of a term; different contexts in toxic texts that it needs at least.
TERM_LETTERS = range(3, 13)
LEAST_CONTEXTS = 6
#: A longer term stands for a shorter one of whose contexts in toxic texts it has this share.
STANDS_FOR = 0.9
#: A term's ratio of shares is at least this with some 98 % certainty (two standard errors).
LEAST_RATIO, ERRORS = 4.0, 2.0
THRESHOLD = 0.7
#: Words of a text whose contexts are gathered together.
BLOCK_WORDS = 100_000
#: Phrases that hold a word of insult in a harmless sense.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clown loach", "sore loser rule", "pond scum")

# Characters that look like Latin letters, and the letters that they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ʀ": "r", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴛ": "t", "ᴜ": "u",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
# Letters that cannot be told from others once folded.
ALIKE = {"l": "i"}


@functools.cache
def folding() -> dict[int, str | None]:
    """What str.translate does to each character: a letter, nothing (marks and joiners) or a blank."""
    out: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cs", "Cn", "Co"):
            folded: str | None = " "
        elif category in ("Mn", "Me", "Cf"):
            folded = None
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x) not in ("Mn", "Me")).lower()
            plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
            plain = "".join(ALIKE.get(y, y) for y in (SUBSTITUTES.get(x, x) for x in plain))
            folded = "".join(x if x.isalnum() else " " for x in plain)
        if folded != c:
            out[code] = folded
    return out


_BLANKS = re.compile(" +")


#: Signs that stand for a letter only between two.
_INNER = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def fold(text: str) -> str:
    """The folded text; words are what blanks part."""
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    return text.translate(folding())


@dataclass
class Lexicon:
    """terms: weights by folded beginning of a word; phrases: folded exceptions; a score is logistic(slope * log(1 + sum) - power * log(1 + words) + base)."""

    terms: dict[str, float] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    slope: float = 0.0
    power: float = 0.0
    base: float = -np.inf

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(" " + term, (len(term), weight, None))
        for phrase in self.phrases:
            # a term may end where a phrase does, and a phrase may be a term
            found.add_word(f" {phrase} ", (len(phrase), 0.0, phrase))
        found.make_automaton()
        return found

    def score(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.base == -np.inf:  # nothing learned
            return np.zeros(len(sums))
        at = self.slope * np.log1p(sums) - self.power * np.log1p(words) + self.base
        return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


def weigh(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """The sum of the weights of a text's terms outside of exception phrases, and its number of words."""
    folded = _BLANKS.sub(" ", f" {fold(text or '')} ")
    words = folded.count(" ") - 1
    hits: list[tuple[int, int, float]] = []
    hidden: list[tuple[int, int]] = []
    for end, (length, weight, phrase) in automaton.iter(folded) if len(automaton) else ():
        if phrase is None:
            hits.append((end - length + 1, end + 1, weight))
        else:
            hidden.append((end - length, end))
    if hidden and hits:
        # both come in order of their ends; a hit is hidden if the phrase that ends next, or one after it, begins no later
        starts = np.minimum.accumulate(np.array([a for a, _ in hidden])[::-1])[::-1]
        ends = np.array([b for _, b in hidden])
        at = np.searchsorted(ends, [b for _, b, _ in hits])
        hits = [h for h, i in zip(hits, at.tolist(), strict=True) if i == len(ends) or starts[i] > h[0]]
    return sum(w for _, _, w in hits), words


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different words with the words beside them."""
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = fold(text or "").split()
            for at in range(0, len(words), BLOCK_WORDS):  # what is equal in several blocks meets later
                own = words[at : at + BLOCK_WORDS]
                found = sorted(set(zip(["", *own[:-1]] if not at else [words[at - 1], *own[:-1]], own, [*own[1:], *(words[at + BLOCK_WORDS : at + BLOCK_WORDS + 1] or [""])], strict=True)))
                before, word, after = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(before), pa.array(word), pa.array(after)], ["toxic", "before", "word", "after"])


def _log_ratio(totals: tuple[int, int]) -> tuple[F.Column, F.Column]:
    """Of counts t and c: the logarithm of the ratio of their shares, and its standard error."""
    ratio = F.log((F.col("t") + 0.5) / (totals[0] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[1] + 1.0))
    return ratio, F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))


def sample(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of the documents that is learned from, and how many labelled ones there are by class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = written(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for x in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 2 * rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    return texts.select("toxic", "text"), n


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon with its weights, exception phrases and normalisation."""
    texts, n = sample(docs, labels, rows)
    phrases = {" ".join(fold(p).split()) for p in exceptions} - {""}
    if len(n) < 2:
        return Lexicon(phrases=tuple(sorted(phrases)))
    texts = written(texts, "labelled")
    spread = texts.repartition(max(2, min(64, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    contexts = written(spread.mapInArrow(_contexts, "toxic int, before string, word string, after string").groupBy("before", "word", "after").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c")), "contexts")
    both = [F.sum("t").alias("t"), F.sum("c").alias("c")]
    totals = tuple(int(x or 0) for x in contexts.agg(*both).first())
    ratio, error = _log_ratio(totals)
    sure = ratio - ERRORS * error
    words = contexts.groupBy("word").agg(*both)
    ends = F.array(*map(F.lit, TERM_LETTERS))
    begun = words.select(F.explode(F.filter(ends, lambda k: k <= F.length("word"))).alias("k"), "word", "t", "c").groupBy(F.substring("word", F.lit(1), F.col("k")).alias("term")).agg(*both)
    told = begun.where((F.col("t") >= LEAST_CONTEXTS) & (sure >= float(np.log(LEAST_RATIO)))).select("term", "t", ratio.alias("weight"), (F.col("t") * sure).alias("gain"))
    terms = _apart({r["term"]: r for r in told.orderBy(F.desc("gain"), "term").limit(MOST_TERMS).collect()})
    phrases |= _harmless(contexts, terms, totals)
    return _normalised(Lexicon(terms, tuple(sorted(phrases))), spread, n)


def _apart(told: dict[str, Row]) -> dict[str, float]:
    """Terms none of which begins another: of those that begin alike the one that comes first, or a longer one that stands for it."""
    longer: dict[str, list[str]] = {}
    for term in told:
        for k in range(1, len(term)):
            longer.setdefault(term[:k], []).append(term)
    terms: dict[str, float] = {}
    begins: set[str] = set()
    for term in told:
        if term in begins or any(term[:k] in terms for k in range(1, len(term) + 1)):
            continue
        full = [x for x in longer.get(term, []) if told[x]["t"] >= STANDS_FOR * told[term]["t"]]
        best = max(full, key=lambda x: (len(x), x), default=term)
        terms[best] = told[best]["weight"]
        begins.update(best[:k] for k in range(1, len(best) + 1))
    return terms


def _harmless(contexts: DataFrame, terms: dict[str, float], totals: tuple[int, int]) -> set[str]:
    """Words and pairs of words that hold a term and stand in other texts rather than in toxic ones, beyond doubt."""
    if not terms:
        return set()
    heads = F.array(*(F.substring("word", 1, k) for k in TERM_LETTERS))
    with_term = contexts.where(F.arrays_overlap(heads, F.array(*map(F.lit, sorted(terms)))))
    pair = lambda a, b: F.when((F.col(a) != "") & (F.col(b) != ""), F.concat_ws(" ", a, b))
    found = with_term.select(F.explode(F.array_compact(F.array(F.col("word"), pair("before", "word"), pair("word", "after")))).alias("phrase"), "t", "c")
    counted = found.groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio, error = _log_ratio(totals)
    return {r["phrase"] for r in counted.where((F.col("c") >= LEAST_CONTEXTS) & (ratio + ERRORS * error < 0)).orderBy(F.desc("c"), "phrase").limit(MOST_TERMS).select("phrase").collect()}


def _normalised(lexicon: Lexicon, texts: DataFrame, n: dict[int, int], step: float = 0.05) -> Lexicon:
    """Fits slope, power and base to a histogram of log sums and log words; classes weigh as in all labelled documents."""
    found = lexicon.automaton

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = found()
        for batch in batches:
            sums, words = np.array([weigh(automaton, t) for t in batch.column("text").to_pylist()], float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(np.rint(np.log1p(v) / step).astype(np.int64)) for v in (sums, words))], ["toxic", "s", "w"])

    # logarithms in steps of 0.05: some hundreds by hundreds of cells, whatever the sample holds
    cells = texts.mapInArrow(measure, "toxic int, s long, w long").groupBy("toxic", "s", "w").count().collect()
    if not cells:
        return lexicon
    y, s, w, count = np.array([[r["toxic"], r["s"] * step, r["w"] * step, r["count"]] for r in cells], float).T
    share = {c: n[c] / count[y == c].sum() for c in (0, 1) if (y == c).any()}
    weight = count * np.array([share[c] for c in y.astype(int)])
    beta = logistic(np.stack([s, -w, np.ones_like(s)], axis=1), y, weight / weight.sum())
    return Lexicon(lexicon.terms, lexicon.phrases, *map(float, beta))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; weights add up to 1, the last column is the constant."""
    beta, keep = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 0.01)

    def loss(b: np.ndarray) -> float:
        at = x @ b
        return float(weight @ (np.logaddexp(0, at) - y * at) + keep @ (b * b) / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        gradient = x.T @ (weight * (p - y)) + keep * beta
        move = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(keep), gradient)
        size = 1.0
        while loss(beta - size * move) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * move
        if np.abs(move).max() * size < 1e-10:
            break
    return beta


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, weight (of the terms found) and n_words of every document."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # MOST_TERMS terms and phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value.automaton()
        for batch in batches:
            sums, words = np.array([weigh(automaton, t.as_py()) for t in batch.column("text")], float).reshape(-1, 2).T
            s = held.value.score(sums, words)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(sums), pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "weight", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, weight double, n_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


#: The lexicon is learned: no SQL; the tests hold it against labels that it has not seen, and the scores against a plain search.
SQL = None
