"""Line dedup by content-defined chunks.

A text's lines are cut at line breaks, and again after a sentence's end and after words
that their own hash picks, or else after the first word, so lines are short and cut alike
wherever they stand.  A rolling hash over the last words of two lines picks the ends of
chunks: where it is less than before and not more than after, so a chunk has three lines
or so; so do the two ends of a line that was cut again.  Ends that would leave a chunk of
one line are passed over, so only a single word on a line between others is a chunk by
itself.  Every rule looks at neighbouring lines alone: an insertion shifts no boundary
beyond the next ones.  Chunks that occur more than once in the corpus are compared byte
by byte, and all but the first occurrence, by doc_id and place, count as repeated.  Runs
of repeated chunks are removed from their texts if they hold several lines: LEAST_LINES
whole physical lines (of LINE_WORDS words together, so that words on lines of their own do
not go by chance), or LEAST_WORDS words, which count as several lines wherever line breaks
stand.  A single physical line that is shorter than that stays, however often it is repeated.

Three scans.  The first counts the hashes of all chunks, by bucket.  The second sends what
may be repeated, told by a bitmap of bounded size, to the bucket of its hash, each text
once a batch, where bytes are compared and the first occurrence is found.  The third
removes.  A hot chunk, of more than one in MOST_HOT of all repeated occurrences, sends
one row a batch; its first occurrence is told to all tasks, which find the others for
themselves.  Shuffled are hashes, places and texts of chunks that may be repeated, and the
documents once, to the numbers of their repeated chunks.

Defined cases: null and empty texts stay as they are; rows alike in id and text are one
document and are treated alike; a null id comes after all others; an empty table stays
empty; a document all of whose words were repeated is left with an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.scatter import bitmap_of, bucket_bits, dealt, gathered, maybe_in, packed, schema
from glossa.llm.shared import table, written
from glossa.llm.skew import MOST_HOT
from glossa.llm.wordhash import Words, constants, find_words, hash_parts, mix, same_bytes, space_words

#: Words that a run of repeated chunks needs to be removed, if it holds fewer than LEAST_LINES whole physical lines: shorter repetitions are formulas, and stay.
LEAST_WORDS = 20
#: Whole physical lines that count as several, and words that they have together.
LEAST_LINES, LINE_WORDS = 2, 8
#: One word in so many ends a line.
WORDS_A_LINE = 2
#: A hot chunk with a longer text is not told to all tasks.
HOT_BYTES = 4096

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?")] = True

REPORT = "doc_id long, n_words long, n_chunks long, n_removed_words long, n_removed_chunks long, text_sha256 string"


@dataclass
class Chunks:
    """first: each chunk's first word (and the end of all); lines: lines in it; hash; owner: its document in the block."""

    first: np.ndarray
    lines: np.ndarray
    hash: np.ndarray
    owner: np.ndarray
    #: Does the chunk begin a physical line?
    head: np.ndarray
    #: Physical lines that begin before each chunk (and the end of all); does the chunk end one?
    begun: np.ndarray
    closed: np.ndarray


def cut(w: Words) -> Chunks:
    n = len(w.start)
    if not n:
        e = np.zeros(0, np.int64)
        return Chunks(np.zeros(1, np.int64), e, e.astype(np.uint64), e, e.astype(bool), np.zeros(1, np.int64), e.astype(bool))
    last = np.zeros(n, bool)  # the last word of a physical line: the one before a line break
    before = np.searchsorted(w.start, np.flatnonzero(w.data == 10)) - 1
    last[before[before >= 0]] = True
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    ends = _SENTENCE_END[w.data[w.end - 1]] | (w.hash % np.uint64(WORDS_A_LINE) == 0) | last
    physical_end = np.flatnonzero(last) + 1
    physical_start = np.concatenate([[0], physical_end[:-1]])
    # a physical line that nothing cuts is cut after its first word
    ends[physical_start[np.add.reduceat(ends, physical_start, dtype=np.int64) == 1]] = True
    line_end = np.flatnonzero(ends) + 1
    line_start = np.concatenate([[0], line_end[:-1]])
    with np.errstate(over="ignore"):
        line = hash_parts(w.hash, line_start, line_end - line_start)
        closes = last[line_end - 1]
        opens = np.concatenate([[True], closes[:-1]])
        whole = opens & closes  # a physical line that was not cut
        final = np.zeros(len(line), bool)  # the last line of its document
        final[np.searchsorted(line_end, w.first[1:][np.diff(w.first) > 0])] = True
        forced = closes & (final | ~whole | np.append(~whole[1:], True))
        head = np.concatenate([[True], forced[:-1]])
        c1, c2 = constants(2, 13)
        word = w.hash[line_end - 1]  # each line's last
        rolling = mix(word * c1 + np.where(head, np.uint64(0), np.concatenate([[np.uint64(0)], word[:-1]])) * c2)
        # less than the one before and no more than the next: never two in a row
        picked = np.concatenate([[False], rolling[1:] < rolling[:-1]]) & np.append(rolling[:-1] <= rolling[1:], False)
        # not a first line, not the one before a last
        picked &= ~forced & ~head & ~np.append(forced[1:], True)
        chunk_end = np.flatnonzero(picked | forced) + 1
        chunk_start = np.concatenate([[0], chunk_end[:-1]])
        chunk = hash_parts(line, chunk_start, chunk_end - chunk_start)
    first = np.concatenate([line_start[chunk_start], [n]])
    owner = np.searchsorted(w.first, first[:-1], "right") - 1
    begun = np.concatenate([[0], np.cumsum(opens)])[np.append(chunk_start, len(line))]
    return Chunks(first, chunk_end - chunk_start, chunk, owner, opens[chunk_start], begun, closes[chunk_end - 1])


def _numbers(c: Chunks, documents: int) -> np.ndarray:
    """Each chunk's number in its document."""
    first = np.searchsorted(c.owner, np.arange(documents))
    return np.arange(len(c.owner)) - first[c.owner]


def _hashes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c.hash for c in map(cut, find_words(batch.column("text"), space_words(), lower=False))]
            keys, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            out = packed(bits, keys, counts.astype(np.uint32))
            if out:
                yield out

    return run


def _repeated(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.add.reduceat(counts.astype(np.int64), first)
    yield pa.RecordBatch.from_arrays([pa.array(keys[first][times > 1].view(np.int64)), pa.array(times[times > 1])], ["hash", "times"])


#: What is sent of an occurrence: hash, document (null?, id, hash of the text), chunk number, length of its text or SAME as the one before.
_PLACE = (np.uint64, np.uint8, np.int64, np.int64, np.int32, np.int64)
SAME = -1
_OCCURRENCES = "bucket long, " + ", ".join(f"c{i} binary" for i in range(len(_PLACE))) + ", texts binary"


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of all the runs, one after the other."""
    n = end - start
    first = np.cumsum(n) - n
    return data[np.repeat(start - first, n) + np.arange(int(n.sum()))]


def _occurrences(bits: int, bitmap, hot: np.ndarray):
    """The chunks that may be repeated, by bucket; of a hot chunk the first occurrence in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids, keys = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("key").to_numpy()
            for w in find_words(batch.column("text"), space_words(), lower=False):
                c = cut(w)
                at = np.flatnonzero(maybe_in(bitmap.value, c.hash))
                if not len(at):
                    continue
                row, no = w.row + c.owner[at], _numbers(c, w.documents)[at]
                order = np.lexsort((no, keys[row], ids[row], null[row], c.hash[at]))
                at, row, no = at[order], row[order], no[order]
                start, end, h = w.start[c.first[at]], w.end[c.first[at + 1] - 1], c.hash[at]
                same = np.concatenate([[False], (h[1:] == h[:-1]) & same_bytes(w.data, start[1:], end[1:], w.data, start[:-1], end[:-1])])
                keep = ~(same & _is_hot(hot, h, end - start))
                h, row, no, start, end, same = (x[keep] for x in (h, row, no, start, end, same))
                length = np.where(same, SAME, end - start)
                columns = [x.astype(t) for x, t in zip((h, null[row], ids[row], keys[row], no, length), _PLACE, strict=True)]
                texts, size = _gather(w.data, start[~same], end[~same]), np.concatenate([[0], np.cumsum(np.where(same, 0, end - start))])
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                spans = list(zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in columns), pa.array([texts[size[a] : size[b]].tobytes() for a, b in spans], pa.binary())],
                    ["bucket", *(f"c{i}" for i in range(len(_PLACE))), "texts"],
                )

    return run


def _is_hot(hot: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes) & (length <= HOT_BYTES) if len(hot) else np.zeros(len(hashes), bool)


_LATER = "hash long, doc_id long, key long, no int, text binary"


def _later(hot: np.ndarray):
    """All occurrences of a bucket's chunks but the first of each; of hot chunks the first, with its text."""

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        h, null, ids, keys, no, length = (np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate(_PLACE))
        data = np.frombuffer(b"".join(p[-1] for p in parts), np.uint8)
        own = np.maximum(length, 0)
        end = np.cumsum(own)
        source = np.maximum.accumulate(np.where(length == SAME, 0, np.arange(len(h))))  # whose text it is
        start, end = (end - own)[source], end[source]
        order = np.lexsort((no, keys, ids, null, h))
        h, null, ids, keys, no, start, end = (x[order] for x in (h, null, ids, keys, no, start, end))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
        equal = same_bytes(data, start, end, data, start[head], end[head])
        firsts: dict = {}
        for i in np.flatnonzero(~equal).tolist():  # equal hashes of different texts
            head[i] = firsts.setdefault((int(h[i]), data[start[i] : end[i]].tobytes()), i)
        # rows alike in id and text are one occurrence
        first = (null == null[head]) & (ids == ids[head]) & (keys == keys[head]) & (no == no[head])
        told = _is_hot(hot, h, end - start)
        at = np.flatnonzero(np.where(told, head == np.arange(len(h)), ~first))
        texts = [data[a:b].tobytes() if t else None for a, b, t in zip(start[at].tolist(), end[at].tolist(), told[at].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[at], mask=null[at] > 0), pa.array(keys[at]), pa.array(no[at]), pa.array(texts, pa.binary())], ["hash", "doc_id", "key", "no", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for bucket in sorted(held):
            yield merged(held.pop(bucket))

    return run


def repeated_chunks(docs: DataFrame, most: int = MOST_HOT) -> tuple[DataFrame, list]:
    """doc_id, key (a hash of the text) and nos: the numbers of the document's chunks that stand elsewhere before; and the hot chunks' first occurrences."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    bits = bucket_bits(rows)
    hashes = rows.select("text").mapInArrow(_hashes(bits), schema(1))
    twice = written(dealt(hashes, bits).mapInArrow(gathered((np.uint32,), _repeated), "hash long, times long"), "chunks")
    total = twice.agg(F.sum("times")).first()[0] or 0
    hot = np.sort(np.array([r["hash"] for r in twice.where(F.col("times") * most > total).select("hash").collect()], np.int64).view(np.uint64))  # fewer than `most`
    bitmap = spark.sparkContext.broadcast(bitmap_of(twice.select("hash"), "hash"))
    seen = rows.withColumn("key", F.xxhash64("text")).mapInArrow(_occurrences(bits, bitmap, hot), _OCCURRENCES)
    later = written(dealt(seen, bits).mapInArrow(_later(hot), _LATER), "later")
    told = later.where("text is not null").collect()  # HOT_BYTES each at most
    nos = later.where("text is null").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("no")).alias("nos"))
    return nos, told


class Told:
    """The hot chunks, by hash: their texts and first occurrences."""

    def __init__(self, rows: list):
        self.by_hash: dict[int, list] = {}
        for r in rows:
            self.by_hash.setdefault(r["hash"] & (1 << 64) - 1, []).append((bytes(r["text"]), (r["doc_id"], r["key"], r["no"])))
        self.hashes = np.sort(np.array(list(self.by_hash), np.uint64))

    def later(self, w: Words, c: Chunks, ids: list, keys: list) -> dict[int, list[int]]:
        """The numbers of each document's hot chunks that are not the first occurrence."""
        found: dict[int, list[int]] = {}
        if not len(self.hashes) or not len(c.hash):
            return found
        at = np.flatnonzero(self.hashes[np.minimum(np.searchsorted(self.hashes, c.hash), len(self.hashes) - 1)] == c.hash)
        no = _numbers(c, w.documents)
        for i in at.tolist():
            k, text = int(c.owner[i]), w.data[w.start[c.first[i]] : w.end[c.first[i + 1] - 1]].tobytes()
            for known, first in self.by_hash[int(c.hash[i])]:
                if known == text and first != (ids[w.row + k], keys[w.row + k], int(no[i])):
                    found.setdefault(k, []).append(int(no[i]))
        return found


def removals(w: Words, c: Chunks, document: int, nos: list[int], least: int) -> list[tuple[int, int]]:
    """The runs of the document's repeated chunks that are long enough, as first chunk and end of the block's chunks."""
    base, marks = int(np.searchsorted(c.owner, document)), set(nos)
    out, run = [], None
    for no in [*sorted(marks), None]:
        if run and no != run[1]:
            a, b = base + run[0], base + run[1]
            words, lines = c.first[b] - c.first[a], c.begun[b] - c.begun[a] - (not c.closed[b - 1])
            if words >= least or (lines >= LEAST_LINES and words >= LINE_WORDS):
                out.append((a, b))
            run = None
        if no is not None:
            run = (run[0] if run else no, no + 1)
    return out


def _without(w: Words, c: Chunks, document: int, runs: list[tuple[int, int]]) -> bytes:
    data, end_of_text = w.data, int(w.text[document + 1])
    kept, at = [], int(w.text[document])
    for a, b in runs:
        i, j = int(c.first[a]), int(c.first[b])
        following = int(w.start[j]) if j < w.first[document + 1] else end_of_text
        if c.head[a]:  # from the line's head: what parts it from the next word goes too
            kept.append(data[at : w.start[i]].tobytes())
            at = following
        else:
            kept.append(data[at : w.end[i - 1]].tobytes())
            at = int(w.end[j - 1])
    return b"".join([*kept, data[at:end_of_text].tobytes()])


def _clean(names: list[str], told: Told, least: int, emit):
    """names: columns with the id as a number, the hash of the text and the numbers of repeated chunks; they come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, lists = (batch.column(x).to_pylist() for x in names)
            texts = batch.column("text").to_pylist()
            facts = np.zeros((4, batch.num_rows), np.int64)
            for w in find_words(batch.column("text"), space_words(), lower=False):
                c = cut(w)
                at = slice(w.row, w.row + w.documents)
                facts[0, at], facts[1, at] = np.diff(w.first), np.bincount(c.owner, minlength=w.documents)
                hot = told.later(w, c, ids, keys)
                for k in range(w.documents):
                    if lists[w.row + k] or k in hot:
                        runs = removals(w, c, k, [*(lists[w.row + k] or ()), *hot.get(k, ())], least)
                        facts[2, w.row + k] = sum(c.first[b] - c.first[a] for a, b in runs)
                        facts[3, w.row + k] = sum(b - a for a, b in runs)
                        if runs:
                            texts[w.row + k] = _without(w, c, k, runs).decode()
            yield emit(batch, texts, facts)

    return run


def _with_lists(docs: DataFrame) -> tuple[DataFrame, list[str], Told]:
    """The documents and three columns, of names not used so far: see _clean."""
    names = ["id", "key", "nos"]
    while {x.lower() for x in docs.columns} & set(names):
        names = [x + "_" for x in names]
    lists, told = repeated_chunks(docs)
    lists = lists.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), F.col("nos").alias("_n"))
    own = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    joined = docs.join(lists, own[0].eqNullSafe(F.col("_i")) & (own[1] == F.col("_k")), "left")
    return joined.select(*(docs[c] for c in docs.columns), *(x.alias(n) for x, n in zip((*own, F.col("_n")), names, strict=True))), names, Told(told)


def _report(batch: pa.RecordBatch, texts: list, facts: np.ndarray) -> pa.RecordBatch:
    sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(facts[i]) for i in range(4)), pa.array(sha)], ["doc_id", "n_words", "n_chunks", "n_removed_words", "n_removed_chunks", "text_sha256"])


def report(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row a document: words, chunks, how many of either are removed, and a digest of what stays."""
    rows, names, told = _with_lists(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_clean(names, told, least, _report), REPORT)


def clean(docs: DataFrame, least: int = LEAST_WORDS, drop_emptied: bool = False) -> DataFrame:
    """All rows with all their columns; texts lose their repeated runs.  drop_emptied: rows that lose all words go."""
    rows, names, told = _with_lists(docs)

    def emit(batch: pa.RecordBatch, texts: list, facts: np.ndarray) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 3)]
        out = pa.RecordBatch.from_arrays(columns, batch.schema.names[:-3])
        return out.filter(pa.array((facts[2] == 0) | (facts[2] < facts[0]))) if drop_emptied else out

    return rows.mapInArrow(_clean(names, told, least, emit), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: Content-defined chunking has no SQL; the tests hold the result against brute force.
SQL = None
