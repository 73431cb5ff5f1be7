"""Token counts with a digest cache.

Texts are told by the SHA-256 of their normalised content (null is empty, else the
bytes as they are: any other folding would change counts), tokenizers by the SHA-256 of
their file.  Stored counts are joined by both digests; only the distinct texts that the
cache lacks are encoded, and their counts are appended to it.  Copies within a batch
are dropped before the shuffle, so a text that a third of all documents share reaches
the encoder a few times per task at most, and once in the end.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are returned
each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.scatter import bitmap_of, maybe_in
from glossa.llm.shared import shared_folder, table, written
from glossa.llm.skew import join_skewed

LIMIT = 1024
#: Words whose counts a worker remembers (about 100 bytes each).
MAX_WORDS = 500_000
CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def counter(path: str):
    """A function from texts to their numbers of tokens, by the file's own library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by Spark
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    return _by_word(model, whole) or whole


def _by_word(model, whole):
    """Counts by the words that byte-level BPE works on, each distinct one encoded once; None for other tokenizers.

    Words are found by the tokenizer's published pattern.  Texts beyond Latin letters,
    where the two libraries' character tables could differ, are encoded whole.
    """
    import json

    import public_tokenizers
    import regex

    spec = json.loads(model.to_str())
    first = spec["pre_tokenizer"] or {}
    plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex") or not plain:
        return None
    find = regex.compile(public_tokenizers.PATTERN).findall
    special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
    beyond_latin = regex.compile(r"[^\x00-\u024F]")
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if beyond_latin.search(text):
                out += whole([text])
                continue
            parts = special.split(text)
            words = [w for part in parts for w in find(part)]
            new = list(set(words).difference(known))
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
                new = list(set(words))
            known.update(zip(new, whole(new), strict=True))
            out.append(sum(map(known.__getitem__, words)) + len(parts) - 1)
        return out

    return count


_COUNTERS: dict[str, object] = {}


def _distinct_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[bytes] = set()
        first = [not (d in seen or seen.add(d)) for d in batch.column("digest").to_pylist()]
        yield batch.filter(pa.array(first))


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:  # a worker that runs several tasks loads the file once
            _COUNTERS[path] = counter(path)
        count = _COUNTERS[path]
        seen: set[bytes] = set()
        for batch in batches:
            new = pa.array([not (d in seen or seen.add(d)) for d in batch.column("digest").to_pylist()])
            batch = batch.filter(new)
            texts, counts = batch.column("text"), []
            for at in range(0, len(texts), 64):  # bounds what the encodings hold at once
                counts += count(texts.slice(at, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return run


def _misses(rows: DataFrame, digests: DataFrame, stored: DataFrame) -> DataFrame:
    """digest and text of the texts that the cache lacks.

    Digests alone, each once, are held against the cache.  Texts whose digest may be lacking,
    told by a bitmap of bounded size, are sent once a batch; those of hits stay where they are.
    """
    lacking = written(digests.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti").withColumn("key", F.xxhash64("digest")), "lacking")
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(lacking.select("key"), "key"))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(bitmap.value, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))

    found = rows.select("digest", "text", F.xxhash64("digest").alias("key")).mapInArrow(maybe, "digest binary, text string, key long")
    found = found.select("digest", "text").mapInArrow(_distinct_in_batch, "digest binary, text string")
    return found.join(lacking.select("digest"), "digest", "left_semi")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; what was encoded is appended to the Parquet table `cache`."""
    spark, version = docs.sparkSession, version_of(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    digests = written(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    misses = _misses(rows, digests, stored) if stored.limit(1).count() else rows.select("digest", "text").mapInArrow(_distinct_in_batch, "digest binary, text string")
    misses.repartition("digest").mapInArrow(_encode(path, version), CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # a text that many documents share does not make one task's work
    return join_skewed(digests, counts, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from an empty cache of its own, so that every run does and shows the whole work."""
    import uuid

    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")


#: SQL has no tokenizer; the tests hold the counts against the library's own.
SQL = None
