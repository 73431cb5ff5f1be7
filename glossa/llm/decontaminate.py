"""Benchmark decontamination: test n-grams looked up in training token windows.

The normalised n-grams of the test items form a hash set that is broadcast to every task.
A task slides windows over the words of its documents, looks their hashes up, and
compares the words of each hit byte by byte.

Up to MAX_WINDOWS n-grams of items of MAX_ITEM_BYTES the set has their words too, and no document moves: there is no
shuffle.  A larger benchmark becomes a table of n-grams; what is broadcast are bare
hashes, MAX_HASHES at a time, and documents are scanned once for each such portion for
windows that may be hits.  Those alone, with their words, are joined to the table, and
documents then meet their hits by one shuffle.  No text is written.

Defined cases: a null or empty text has no words and no hits; an item with fewer words
than a window is one window of its own, an item without words is never found; items
with a null id mark words but are not counted or listed; repeated documents are judged
each alone; repeated items count once; empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written
from glossa.llm.skew import join_skewed
from glossa.llm.wordhash import Words, alphanumeric_words, find_words, hash_windows

WINDOW = 10
#: n-grams that are broadcast with their words (about 300 bytes each).
MAX_WINDOWS = 200_000
#: Bytes of items whose n-grams are broadcast with their words: a word may be as long as its item.
MAX_ITEM_BYTES = 8 << 20
#: Hashes of n-grams that are broadcast at once (8 bytes each).
MAX_HASHES = 8_000_000

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class NgramSet:
    """Hashes of the n-grams of some items, with their words and the items that have them."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.found: dict[int, dict[int, dict[bytes, set]]] = defaultdict(dict)
        ids, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.string())
        for words in find_words(texts, alphanumeric_words()):
            for k in range(words.documents):
                a, b = words.first[k], words.first[k + 1]
                size = int(min(window, b - a))
                if not size:
                    continue
                for at, h in zip(range(a, b), hash_windows(words.hash[a:b], size).tolist(), strict=False):
                    same = self.found[size].setdefault(h, {})
                    same.setdefault(window_words(words, at, size), set()).add(ids[words.row + k])
        self.hashes = Hashes({size: np.array(list(x), np.uint64) for size, x in self.found.items()})

    def hits(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """First word, number of words and items of each window of the block that is in the set."""
        for size, _, at, h in self.hashes.hits(words):
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                items = self.found[size][x].get(window_words(words, i, size))
                if items is not None:
                    yield i, size, items


class Hashes:
    """Hashes of n-grams by number of words."""

    def __init__(self, by_size: dict[int, np.ndarray]):
        self.by_size = {size: np.sort(x) for size, x in by_size.items()}
        self.near = {size: self._marks(x) for size, x in self.by_size.items()}

    @staticmethod
    def _marks(hashes: np.ndarray) -> np.ndarray:
        """Which low bits occur: most windows of a text are told off by this table alone."""
        bits = min(26, max(20, len(hashes).bit_length() + 3))
        marks = np.zeros(1 << bits, bool)
        marks[hashes & np.uint64((1 << bits) - 1)] = True
        return marks

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Number of words; document, first word and hash of each window of the block whose hash is known."""
        owner_end = np.repeat(words.first[1:], np.diff(words.first))
        for size, known in self.by_size.items():
            h = hash_windows(words.hash, size)
            at = np.flatnonzero(self.near[size][h & np.uint64(len(self.near[size]) - 1)])
            at = at[at + size <= owner_end[at]]
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            yield size, np.searchsorted(words.first, at, "right") - 1, at, h[at]


def window_words(words: Words, at: int, size: int) -> bytes:
    """The words from `at` on, joined by a blank."""
    return b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(at, at + size))


def _scan(ngrams):
    """`hit` (a bit a word) and `items` of each document, by a set that has all n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, items = [None] * batch.num_rows, [None] * batch.num_rows
            for words in find_words(batch.column("text"), alphanumeric_words()):
                if not len(words.start):
                    continue
                marks, lists = np.zeros(len(words.start), bool), defaultdict(set)
                for at, size, ids in ngrams.value.hits(words):
                    marks[at : at + size] = True
                    lists[int(np.searchsorted(words.first, at, "right")) - 1] |= ids
                for k, ids in lists.items():
                    hit[words.row + k] = np.packbits(marks[words.first[k] : words.first[k + 1]]).tobytes()
                    items[words.row + k] = sorted(i for i in ids if i is not None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text", "hit", "items"])

    return run


def _items(benchmark: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The different items, and whether their n-grams are few and short enough to be broadcast with their words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words, size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.sum(F.octet_length("text"))).first()
    return rows, (words or 0) <= limit and (size or 0) <= MAX_ITEM_BYTES


def _windows(window: int):
    """size, hash, gram and item_id of the n-grams of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in find_words(batch.column("text"), alphanumeric_words()):
                for k in range(words.documents):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    size = min(window, b - a)
                    if size:
                        h = hash_windows(words.hash[a:b], size)
                        grams = [window_words(words, a + i, size) for i in range(len(h))]
                        item = batch.column("item_id")[words.row + k]
                        yield pa.RecordBatch.from_arrays([pa.array([size] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(grams, pa.binary()), pa.array([item.as_py()] * len(h), pa.int64())], ["size", "hash", "gram", "item_id"])

    return run


def _candidates(hashes):
    """doc_id, key (a hash of the text), first word, size and words of the windows whose hashes are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for words in find_words(batch.column("text"), alphanumeric_words()):
                if not len(words.start):
                    continue
                for size, document, at, _ in hashes.value.hits(words):
                    rows = pa.array(words.row + document)
                    grams = [window_words(words, i, size) for i in at.tolist()]
                    own = (at - words.first[document]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(rows), keys.take(rows), pa.array(own), pa.array([size] * len(at), pa.int32()), pa.array(grams, pa.binary())], ["doc_id", "key", "at", "size", "gram"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns the places of hits into a bit a word."""
    for batch in batches:
        bits, items = [], []
        for places, ids in zip(batch.column("places").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if not places:
                bits.append(None)
                items.append(None)
                continue
            marks = np.zeros(max(p["at"] + p["size"] for p in places), bool)
            for p in places:
                marks[p["at"] : p["at"] + p["size"]] = True
            bits.append(np.packbits(marks).tobytes())
            items.append(sorted({i for own in ids for i in own if i is not None}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text", "hit", "items"])


def _hits_by_table(rows: DataFrame, items: DataFrame, window: int, most: int) -> DataFrame:
    """doc_id, key, places and ids (lists of item ids) of the documents with hits, for a benchmark of any size."""
    spark = rows.sparkSession
    grams = items.mapInArrow(_windows(window), "size int, hash long, gram binary, item_id long")
    grams = written(grams.groupBy("size", "hash", "gram").agg(F.collect_set("item_id").alias("ids")), "grams")
    hashes = grams.select("size", "hash").distinct()
    parts = hashes.count() // most + 1
    found = None
    for j in range(parts):
        own = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == j).toPandas()  # about `most` hashes
        known = Hashes({int(n): x["hash"].to_numpy(np.int64).view(np.uint64) for n, x in own.groupby("size")})
        hits = rows.mapInArrow(_candidates(spark.sparkContext.broadcast(known)), "doc_id long, key long, at int, size int, gram binary")
        found = hits if found is None else found.unionByName(hits)
    hits = join_skewed(written(found, "windows"), grams.select("size", "gram", "ids"), ["size", "gram"])
    return hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("places"), F.collect_set("ids").alias("ids"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_WINDOWS, hashes: int = MAX_HASHES) -> DataFrame:
    """doc_id, text, hit (a bit for each word up to the last hit, null without hits) and items of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, few = _items(benchmark, limit)
    if few:
        ngrams = docs.sparkSession.sparkContext.broadcast(NgramSet([(r.item_id, r.text) for r in items.collect()], window))
        return rows.mapInArrow(_scan(ngrams), "doc_id long, text string, hit binary, items array<long>")
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = _hits_by_table(rows, items, window, hashes).select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "places", "ids")
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left")
    return both.select("doc_id", "text", "places", "ids").mapInArrow(_marked, "doc_id long, text string, hit binary, items array<long>")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for words in find_words(batch.column("text"), alphanumeric_words()):
            n[words.row : words.row + words.documents] = np.diff(words.first)
        hits = np.zeros(batch.num_rows, np.int64)
        for i, bits in enumerate(batch.column("hit").to_pylist()):
            if bits:
                hits[i] = np.unpackbits(np.frombuffer(bits, np.uint8)).sum()
        items = [[] if x is None else x for x in batch.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() if x else nothing for x in items]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(hits > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """One row a document: words, words in test n-grams, and which items were met."""
    return find_overlaps(docs, benchmark, window, **limits).mapInArrow(_report, REPORT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, texts = batch.column("hit").to_pylist(), batch.column("text").to_pylist()
        for words in find_words(batch.column("text"), alphanumeric_words(), lower=False):
            for k in range(words.documents):
                row = words.row + k
                if hit[row]:
                    a, b, base = words.first[k], words.first[k + 1], words.text[k]
                    marks = np.unpackbits(np.frombuffer(hit[row], np.uint8))[: b - a]
                    bits = np.concatenate([[0], marks, np.zeros(b - a - len(marks), np.uint8), [0]]).astype(np.int8)
                    raw, kept, last = texts[row].encode(), [], 0
                    for s, e in zip(np.flatnonzero(np.diff(bits) == 1), np.flatnonzero(np.diff(bits) == -1), strict=True):
                        kept.append(raw[last : words.start[a + s] - base])
                        last = words.end[a + e - 1] - base
                    texts[row] = b"".join([*kept, raw[last:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([x is not None for x in hit])], ["doc_id", "text", "changed"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """doc_id, text without the words of test n-grams (from the first to the last of each run), changed."""
    return find_overlaps(docs, benchmark, window, **limits).mapInArrow(_cut, "doc_id long, text string, changed boolean")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_WINDOWS, hashes: int = MAX_HASHES) -> DataFrame:
    """The rows of docs, all their columns as they were, whose text has no test n-gram."""
    items, few = _items(benchmark, limit)
    if few:
        ngrams = docs.sparkSession.sparkContext.broadcast(NgramSet([(r.item_id, r.text) for r in items.collect()], window))
        return docs.mapInArrow(_clean_rows(ngrams), docs.schema)
    own = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(own[0].alias("doc_id"), F.col("text").cast("string").alias("text"), own[1].alias("key"))
    found = _hits_by_table(rows, items, window, hashes).select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_k")), "left_anti")


def _clean_rows(ngrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for words in find_words(batch.column("text"), alphanumeric_words()):
                if len(words.start):
                    for at, _, _ in ngrams.value.hits(words):
                        clean[words.row + int(np.searchsorted(words.first, at, "right")) - 1] = False
            yield batch.filter(pa.array(clean))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hits AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (size, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""
