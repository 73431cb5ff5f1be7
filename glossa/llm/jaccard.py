"""N-gram Jaccard join: all pairs of documents whose shingle sets overlap enough.

T-occurrence search with DivideSkip's division of the inverted lists, over a corpus:

* Texts with equal sets are one node, told by 95 bits of hash and the set's size.
* A node with n shingles needs T = ceil(0.8 n) of them in any partner.  Its L = T - MEETINGS
  longest lists are set aside, so a partner must stand on T - L = MEETINGS of its other,
  short lists at least (on fewer only if both sets need fewer).  (shingle, node) entries of
  short lists go through one shuffle, by shingle.  Lists are ordered by estimated length
  (shingles that are frequent within partitions, counted over all of them, come last) and
  by hash, the same for all nodes.
* The short lists: in each task a node's lists, less the entries whose sizes and places leave
  no room for T, are merged with a heap that counts on how many of them a partner stands.
  A node's lists lie in many tasks; the counts of all of them are added, and who comes to
  T - L is a candidate, if bitmaps of both sets (exact bounds on the difference) allow it.
* A list of more than SHORT nodes is never expanded into pairs: the most alike nodes of it
  are linked first (a spanning forest by bitmap distance), verified, and after that only
  nodes outside the list's largest component are compared with those of other components.
  So who meets on one long list need not meet MEETINGS times.
  Lists that are known to be hot are dealt over many tasks from the start.
* The long lists: candidates are dealt in portions of bounded size, each with the texts of
  its nodes, once a node.  A portion's inverted lists are built, those set aside among them,
  and for each candidate the lists of the smaller set are probed for the larger one by
  binary search, until T is reached or out of reach.  Shingles found so are compared word
  by word, as bytes.

Every bound is exact: no link between different texts is lost, whatever the frequencies.
The estimated lengths only order the lists.

Defined cases: a null text or one without words has an empty set and is linked with
nothing (its component is its own id); repeated rows and rows without an id are members
of their text's node; the least id of a component counts those that are not null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.components import components
from glossa.llm.scatter import bitmap_of, bucket_bits, dealt, gathered, maybe_in, packed, schema
from glossa.llm.shared import table, written
from glossa.llm.skew import join_skewed
from glossa.llm.wordhash import Numbers, Words, find_words, hash_windows, mix, space_words, word_numbers

SHINGLE = 5
PERCENT = 80
#: T - L: on so many short lists of a node its partners must stand.
MEETINGS = 2
#: Nodes on a list that is expanded into pairs.
SHORT = 64
#: Portions that get one node's text from one row: more portions share copies of it.
COPIES = 64
#: Shingles whose estimated frequency orders them; the rest are ordered by hash.  Broadcast: 6 MB.
MAX_FREQUENT = 1 << 19
#: Nodes of a long list that one task compares with as many.
BLOCK = 4096
#: Bytes of texts that the candidates of one portion bring along, about.
PORTION = 4 << 20
MARK_WORDS = 16
#: A node's n holds its size in the lower bits and a hash of its own in the upper ones.
SIZE = (1 << 32) - 1

_MARKS = [f"m{i}" for i in range(MARK_WORDS)]


def needed(na, nb, percent: int = PERCENT):
    """The least overlap of sets of these sizes: the least k with 100 k >= percent (na + nb - k)."""
    return -(-(na + nb) * percent // (100 + percent))


def shingles_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: distinct shingle hashes by document in ascending order, each one's first word, where each document's begin."""
    count = np.diff(w.first)
    h = hash_windows(w.hash, SHINGLE)
    owner = w.owner()
    inside = np.flatnonzero(np.arange(len(h)) + SHINGLE <= w.first[1:][owner[: len(h)]])
    keys, places = [h[inside]], [inside]
    for k in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        keys.append(hash_windows(w.hash[w.first[k] : w.first[k + 1]], int(count[k])))
        places.append(w.first[k : k + 1])
    key, place = np.concatenate(keys), np.concatenate(places)
    who = owner[place]
    order = np.lexsort((key, who))
    key, who, place = key[order], who[order], place[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])]) if len(key) else np.zeros(0, bool)
    key, who, place = key[new], who[new], place[new]
    return key, place, np.searchsorted(who, np.arange(w.documents + 1))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each block: number of its first document, distinct shingle hashes by document in ascending order, where each document's begin."""
    for w in find_words(column, space_words()):
        key, _, first = shingles_of(w)
        yield w.row, key, first


def _nodes_of(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's sig and n, and the size of its set."""
    size = np.diff(first)
    with np.errstate(over="ignore"):
        second = _signatures(key ^ np.uint64(0x9FB21C651E98DF25), first) >> np.uint64(33)
    return _signatures(key, first), np.where(size > 0, second.astype(np.int64) << 32 | size, 0), size


def _signatures(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each document's set."""
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
        return mix((total[first[1:]] - total[first[:-1]]) + n.astype(np.uint64))


def _marks(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bitmap of each set: bit j is the parity of its shingles that fall on j.  Sets differ by as many shingles as bitmaps do by bits, at least."""
    size = 64 * MARK_WORDS
    place = (key >> np.uint64(20)).astype(np.int64) % size
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    odd = np.zeros((len(first) - 1, size), np.uint8)
    flat = np.bincount(owner * size + place, minlength=odd.size) & 1 if len(key) else odd.ravel()
    return np.packbits(flat.astype(np.uint8).reshape(odd.shape), axis=1).view(np.uint64).reshape(len(first) - 1, MARK_WORDS)


_NODE_COLUMNS = f"doc_id long, n long, sig long, {', '.join(f'{m} long' for m in _MARKS)}, bucket long, k binary, c0 binary"


def _nodes(bits: int):
    """A row for each document (bucket is null), and the shingles that several sets of a batch have, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            pool = []
            for row, key, first in shingle_sets(batch.column("text")):
                sig, n, size = _nodes_of(key, first)
                marks = [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(_marks(key, first).T)]
                ids = batch.column("doc_id").slice(row, len(n))
                none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sig.view(np.int64)), *marks, *none], ["doc_id", "n", "sig", *_MARKS, "bucket", "k", "c0"])
                fresh = np.array([not (s in seen or seen.add(s)) for s in sig.tolist()], bool)
                pool.append(key[np.repeat(fresh, size)])
            key, count = np.unique(np.concatenate([*pool, np.zeros(0, np.uint64)]), return_counts=True)
            out = packed(bits, key[count > 1], count[count > 1].astype(np.uint32))
            if out:
                m = out.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * (3 + MARK_WORDS) + out.columns, ["doc_id", "n", "sig", *_MARKS, "bucket", "k", "c0"])

    return run


def _frequent(bucket: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key)
    key, count = key[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(count, first))], ["shingle", "times"])


def frequent_shingles(counts: DataFrame, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most `most`, in ascending order, and their frequencies."""
    by_count = counts.groupBy(F.least("times", F.lit(1 << 16)).alias("times")).agg(F.count(F.lit(1)).alias("shingles")).orderBy(F.desc("times")).collect()  # at most 2^16 rows
    least, total = None, 0
    for row in by_count:
        total += row.shingles
        if total > most:
            break
        least = row.times
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("times") >= least).toPandas()
    key = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], rows["times"].to_numpy(np.int64)[order]


def _entries(bits: int, frequent, block: int, percent: int, meetings: int):
    """Each node's short lists: shingle, node, place in the node's order, and the part of the list if it is known to be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for batch in batches:
            seen: set[int] = set()
            entries = []
            for _, key, first in shingle_sets(batch.column("text")):
                sig, n, size = _nodes_of(key, first)
                fresh = np.array([not (s in seen or seen.add(s)) for s in sig.tolist()], bool)
                owner = np.repeat(np.arange(len(n)), size)
                rank = np.zeros(len(key), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    rank = np.where(known[at] == key, times[at], 0)
                order = np.lexsort((rank, owner)) if rank.any() else np.arange(len(key))
                place = np.arange(len(key)) - first[:-1][owner]
                short = (place < (size - needed_alone(size, percent) + meetings)[owner]) & fresh[owner]
                key, rank, owner = key[order][short], rank[order][short], owner[short]
                parts = 1 + rank // max(2, block // 4)
                # dealt anew for each token: nodes of one group meet others of it on each of their hot lists
                part = np.where(parts > 1, 1 + (mix(sig[owner] ^ key) % parts.astype(np.uint64)).astype(np.int64), 0)
                entries.append((key, sig[owner], n[owner], place[short].astype(np.uint32), part.astype(np.uint64)))
            if entries:
                key, *columns, part = (np.concatenate(x) for x in zip(*entries, strict=True))
                out = packed(bits, key, *columns, part, spread=part)
                if out:
                    yield out

    return run


def needed_alone(n, percent: int = PERCENT):
    """The least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def fits(na, nb, pa_, pb, percent: int = PERCENT, meetings: int = 1):
    """May sets of these sizes, na <= nb, that meet at these places of their orders, at most for the last of `meetings` times, reach the overlap?"""
    need = needed(na, nb, percent)
    return (100 * na >= percent * nb) & (meetings + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


def heap_counted(lists: list[list[int]]) -> list[tuple[int, int]]:
    """What stands on the ascending lists, in ascending order, and on how many of them."""
    if len(lists) == 1:
        return [(x, 1) for x in lists[0]]
    return [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*lists))]


def heap_merged(lists: list[list[int]], least: int = 1) -> list[int]:
    """What stands on `least` of the ascending lists or more."""
    return [x for x, k in heap_counted(lists) if k >= least]


def _meetings(short: int, block: int, percent: int, meetings: int):
    """Pairs of nodes on short lists (token is null: a, na, b, nb, and in `block` on how many of this bucket's lists) and the nodes of long ones (token, a, na, block)."""

    def run(bucket: int, key: np.ndarray, sig: np.ndarray, n: np.ndarray, place: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((n, sig, part, key))
        key, sig, n, place, part = key[order], sig[order], n[order], place[order].astype(np.int64), part[order].astype(np.int64)
        list_ = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        new = list_ | np.concatenate([[True], (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])])  # a node's entry may come from several batches
        key, sig, n, place, part, list_ = key[new], sig[new], n[new], place[new], part[new], list_[new]
        start = np.flatnonzero(list_)
        length = np.diff(np.append(start, len(key)))
        long_ = (length > short) | (part[start] > 0)
        size = n & SIZE
        found = [np.zeros((3, 0), np.int64)]  # list, smaller and larger set: entries
        for k in np.unique(length[(length > 1) & ~long_]).tolist():
            i, j = np.triu_indices(k, 1)
            lists = start[(length == k) & ~long_]
            for at in range(0, len(lists), max(1, (1 << 20) // len(i))):
                base = lists[at : at + max(1, (1 << 20) // len(i)), None]
                x, y = (base + i).ravel(), (base + j).ravel()
                x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
                ok = fits(size[x], size[y], place[x], place[y], percent, meetings)
                found.append(np.stack([np.repeat(base[:, 0], len(i))[ok], x[ok], y[ok]]))
        at, x, y = np.concatenate(found, axis=1)
        if len(x):
            # nodes by number; one that is met on several lists has an entry on each
            _, one, number = np.unique(np.stack([sig.view(np.int64), n]), axis=1, return_index=True, return_inverse=True)
            x, y = number.ravel()[x], number.ravel()[y]
            order = np.lexsort((y, at, x))
            at, x, y = at[order], x[order], y[order]
            a, b, times = [], [], []
            query = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            cuts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (at[1:] != at[:-1])]))
            cuts, others = np.append(cuts, len(x)).tolist(), y.tolist()
            own = np.append(np.searchsorted(cuts, query), len(cuts) - 1).tolist()
            for q, s, e in zip(x[query].tolist(), own[:-1], own[1:], strict=True):
                met = heap_counted([others[cuts[i] : cuts[i + 1]] for i in range(s, e)])
                a += [q] * len(met)
                b += [m for m, _ in met]
                times += [k for _, k in met]
            a, b = one[a], one[b]
            yield _meeting(pa.nulls(len(a), pa.int64()), sig[a], n[a], sig[b], n[b], np.array(times, np.int64))
        for s, k in zip(start[long_].tolist(), length[long_].tolist(), strict=True):
            at = np.arange(s, s + k)
            at = at[np.argsort(mix(sig[at] ^ key[at]))]
            yield _meeting(pa.array(key[at].view(np.int64)), sig[at], n[at], sig[at], n[at], part[at] if part[s] else np.arange(k) // block)

    return run


_MEETING = "token long, a long, na long, b long, nb long, block long"


def _meeting(token: pa.Array, a, na, b, nb, block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([token, pa.array(a.view(np.int64)), pa.array(na), pa.array(b.view(np.int64)), pa.array(nb), pa.array(block)], ["token", "a", "na", "b", "nb", "block"])


def _allowed(na, nb, percent: int):
    """By how many shingles sets of these sizes may differ; less than 0 where their sizes alone part them."""
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    return np.where(100 * least >= percent * most, na + nb - 2 * needed(na, nb, percent), -1)


def _forest(percent: int):
    """Of each block of a long list: pairs that span what the bitmaps allow, the most alike first (Prim's method)."""

    def pairs(n: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.ones(len(n), bool)
        best, parent = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
        for _ in range(len(n)):
            open_ = np.flatnonzero(left)
            i = int(open_[np.argmin(best[open_])])
            left[i] = False
            if parent[i] >= 0:
                yield int(parent[i]), i
            d = np.bitwise_count(marks ^ marks[i]).sum(axis=1).astype(np.int64)
            closer = left & (d <= _allowed(n, n[i], percent)) & (d < best)
            best[closer], parent[closer] = d[closer], i

    return _by_block(lambda x: pairs(x["n"], x["marks"]))


def _across(percent: int):
    """Of a block of a list's scattered nodes (side 0) and a block of all its nodes (side 1): pairs of different components that the bitmaps allow."""

    def pairs(x: dict) -> Iterator[tuple[int, int]]:
        n, marks, label, side, v = (x[k] for k in ("n", "marks", "label", "side", "v"))
        right = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0).tolist():
            j = right[(label[right] != label[i]) & (~x["scattered"][right] | (v[right] > v[i]))]  # two scattered nodes meet twice
            d = np.bitwise_count(marks[j] ^ marks[i]).sum(axis=1)
            for k in j[d <= _allowed(n[j], n[i], percent)].tolist():
                yield i, k

    return _by_block(pairs)


def _by_block(pairs):
    """For applyInArrow over rows of a block or two (about BLOCK rows each): yields its pairs."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        x = {c: batch.column(c).to_numpy() for c in batch.column_names if c in ("n", "v", "label", "side", "scattered")}
        node, x["n"] = x["n"], x["n"] & SIZE
        x["marks"] = np.stack([batch.column(m).to_numpy() for m in _MARKS], axis=1).view(np.uint64)
        sig = batch.column("a").to_numpy()
        i, j = np.array(list(pairs(x)), np.int64).reshape(-1, 2).T
        return pa.table({c: pa.array(y) for c, y in zip(_PAIR_NAMES, (sig[i], node[i], x["v"][i], sig[j], node[j], x["v"][j]), strict=True)})

    return run


_PAIR_NAMES = ("a", "na", "va", "b", "nb", "vb")
_PAIR = ", ".join(f"{c} long" for c in _PAIR_NAMES)


def _size(n: str) -> Column:
    return F.col(n).bitwiseAND(F.lit(SIZE).cast("long"))


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """needed() of two columns."""
    total = (na + nb) * percent + F.lit(99 + percent)
    return ((total - F.pmod(total, F.lit(100 + percent))) / F.lit(100 + percent)).cast("long")


def _alike(met: DataFrame, nodes: DataFrame, percent: int, meetings: int) -> DataFrame:
    """The pairs of nodes (a, na, b, nb) that met often enough and whose bitmaps allow the overlap, each once, with the nodes' numbers."""
    x = nodes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"), *(F.col(m).alias("a" + m) for m in _MARKS))
    y = nodes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"), *(F.col(m).alias("b" + m) for m in _MARKS))
    differ = F.bit_count(F.col("am0").bitwiseXOR(F.col("bm0")))
    for m in _MARKS[1:]:
        differ = differ + F.bit_count(F.col("a" + m).bitwiseXOR(F.col("b" + m)))
    need = _needed(_size("na"), _size("nb"), percent)
    often = met.groupBy("a", "na", "b", "nb").agg(F.sum("times").alias("times")).where(F.col("times") >= F.least(F.lit(meetings).cast("long"), need)).drop("times")
    return often.join(x, ["a", "na"]).join(y, ["b", "nb"]).where(differ <= _size("na") + _size("nb") - 2 * need).select(*_PAIR_NAMES)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller set first."""
    first = (_size("na") < _size("nb")) | ((_size("na") == _size("nb")) & (F.col("va") < F.col("vb")))
    swap = dict(zip(_PAIR_NAMES, _PAIR_NAMES[3:] + _PAIR_NAMES[:3], strict=True))
    return pairs.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in swap.items())).distinct()


def _texts_of(bitmap):
    """sig, n and text of the nodes that may be in the bitmap, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for row, key, first in shingle_sets(batch.column("text")):
                sig, n, size = _nodes_of(key, first)
                at = [k for k in np.flatnonzero(maybe_in(bitmap.value, sig) & (size > 0)).tolist() if not (int(sig[k]) in seen or seen.add(int(sig[k])))]
                yield pa.RecordBatch.from_arrays([pa.array(sig[at].view(np.int64)), pa.array(n[at]), batch.column("text").take(pa.array([row + k for k in at], pa.int64()))], ["sig", "n", "text"])

    return run


class Portion:
    """Inverted lists over the shingles of some texts: for each shingle the numbers of its texts, in ascending order."""

    def __init__(self, texts: pa.Array):
        numbers, keys, grams, sizes = Numbers(), [np.zeros(0, np.uint64)], [np.zeros((0, SHINGLE), np.int32)], []
        for w in find_words(texts, space_words()):
            key, place, first = shingles_of(w)
            words = np.append(word_numbers(w, numbers), np.full(SHINGLE, -1)).astype(np.int32)
            end = w.first[1:][np.repeat(np.arange(w.documents), np.diff(first))]
            at = place[:, None] + np.arange(SHINGLE)
            keys.append(key)
            grams.append(np.where(at < end[:, None], words[at], -1))
            sizes.append(np.diff(first))
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.grams = np.concatenate(grams)
        _, token = np.unique(np.concatenate(keys), return_inverse=True)
        self.token, self.count = token, max(1, len(self.size))
        postings = token * self.count + np.repeat(np.arange(len(self.size)), self.size)
        self.entry = np.argsort(postings)
        self.postings = postings[self.entry]

    def linked(self, a: int, b: int, percent: int) -> bool:
        """Does b stand on as many of a's lists as both sets need?  Probes by binary search, compares the words of what is found."""
        need, got = needed(int(self.size[a]), int(self.size[b]), percent), 0
        end = int(self.first[a + 1])
        for at in range(int(self.first[a]), end, 256):
            if got + end - at < need:
                return False
            own = np.arange(at, min(at + 256, end))
            probe = self.token[own] * self.count + b
            i = np.minimum(np.searchsorted(self.postings, probe), len(self.postings) - 1)
            hit = self.postings[i] == probe
            got += int((self.grams[own[hit]] == self.grams[self.entry[i[hit]]]).all(axis=1).sum())
            if got >= need:
                return True
        return got >= need


def _verify(percent: int):
    """Of a portion's pairs and its nodes' texts: the linked pairs."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        portion = Portion(texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.string()))
        number = {v: i for i, v in enumerate(texts.column("v").to_pylist())}
        va, vb = pairs.column("va").to_pylist(), pairs.column("vb").to_pylist()
        ok = [portion.linked(number[x], number[y], percent) for x, y in zip(va, vb, strict=True)]
        return pairs.select(["va", "vb"]).rename_columns(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(texts: DataFrame, pairs: DataFrame, percent: int, portion: int = PORTION) -> DataFrame:
    """The pairs that reach the overlap (a and b: numbers of nodes), verified in portions with the texts of their nodes."""
    spark = texts.sparkSession
    bytes_ = 8 * (_size("na") + _size("nb"))
    total = pairs.agg(F.sum(bytes_)).first()[0]
    if not total:
        return pairs.select(F.col("va").alias("a"), F.col("vb").alias("b"))
    # pairs of one node stand together, as far as they make up one portion
    load = pairs.groupBy("va").agg((F.lit(1) + F.floor(F.sum(bytes_) / portion)).cast("long").alias("parts"))
    load = load.where("parts > 1")  # of some nodes alone
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // portion) + 1)
    block = F.pmod(F.xxhash64("va", F.pmod(F.xxhash64("vb"), F.coalesce("parts", F.lit(1).cast("long")))), F.lit(many))
    pairs = written(join_skewed(pairs, load, ["va"], "left").select(*_PAIR_NAMES, block.alias("block")), "portions")
    needed_ = pairs.select(F.col("block").alias("portion"), F.col("a").alias("sig"), F.col("na").alias("n"), F.col("va").alias("v")).union(pairs.select("block", "b", "nb", "vb")).distinct()
    needed_ = written(needed_, "needed")
    # a node that many portions need brings several copies of its text, so none of them meets more than COPIES rows
    copies = needed_.groupBy("sig", "n").agg(F.floor(F.count(F.lit(1)) / COPIES).alias("more")).where("more > 0")
    needed_ = join_skewed(needed_, copies, ["sig", "n"], "left").withColumn("copy", F.pmod(F.xxhash64("portion"), F.coalesce("more", F.lit(0)) + 1)).drop("more")
    bitmap = spark.sparkContext.broadcast(bitmap_of(needed_.select("sig").distinct(), "sig"))
    found = texts.mapInArrow(_texts_of(bitmap), "sig long, n long, text string")
    # equal nodes have equal sets: any copy will do
    found = found.groupBy("sig", "n").agg(F.first("text").alias("text"))
    found = found.join(copies, ["sig", "n"], "left").select("sig", "n", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("more", F.lit(0).cast("long")))).alias("copy"))
    found = needed_.join(found, ["sig", "n", "copy"]).select("portion", "v", "text")
    links = pairs.select("block", "va", "vb").groupBy("block").cogroup(found.groupBy("portion")).applyInArrow(_verify(percent), "a long, b long")
    return written(links, "verified")


def _scattered(marked: DataFrame, block: int) -> DataFrame:
    """Rows of lists whose nodes are in several components, in pairs of blocks: nodes outside the largest one (side 0) with all (side 1)."""
    by_label = marked.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    lists = by_label.groupBy("token").agg(F.sum("k").alias("all"), F.max_by("label", F.struct("k", "label")).alias("largest"), F.max("k").alias("k"))
    rows = marked.drop("block").join(lists.where(F.col("k") < F.col("all")), "token").withColumn("scattered", F.col("label") != F.col("largest"))
    parts = F.ceil((F.col("all") - F.col("k")) / block), F.ceil(F.col("all") / block)
    place = [F.pmod(F.xxhash64("v", F.lit(i)), n) for i, n in enumerate(parts)]
    each = [F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) for n in parts]
    left = rows.where("scattered").select("*", F.lit(0).alias("side"), place[0].alias("p"), each[1].alias("q"))
    return left.union(rows.select("*", F.lit(1).alias("side"), each[0].alias("p"), place[1].alias("q")))


def join(docs: DataFrame, percent: int = PERCENT, short: int = SHORT, block: int = BLOCK, meetings: int = MEETINGS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least id that links lead to), sig and n (its node), component (of nodes)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.select("text").where("text is not null")
    bits = bucket_bits(rows)
    first = written(rows.mapInArrow(_nodes(bits), _NODE_COLUMNS), "nodes")
    members = first.where("bucket is null")
    counts = written(dealt(first.where("bucket is not null").select("bucket", "k", "c0"), bits).mapInArrow(gathered((np.uint32,), _frequent), "shingle long, times long"), "frequent")
    frequent = spark.sparkContext.broadcast(frequent_shingles(counts))
    nodes = members.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("least"), *(F.max(m).alias(m) for m in _MARKS))
    nodes = written(nodes.withColumn("v", F.monotonically_increasing_id()), "distinct")  # a number for each node, once written

    entries = texts.mapInArrow(_entries(bits, frequent, block, percent, meetings), schema(4))
    met = written(dealt(entries, bits).mapInArrow(gathered((np.uint64, np.int64, np.uint32, np.uint64), _meetings(short, block, percent, meetings)), _MEETING), "met")
    pairs = _alike(met.where("token is null").select("a", "na", "b", "nb", F.col("block").alias("times")), nodes, percent, meetings)
    long_ = met.where("token is not null").select("token", "a", F.col("na").alias("n"), "block")
    hot = bool(long_.limit(1).count())
    if hot:
        marked = written(long_.join(nodes.select(F.col("sig").alias("a"), "n", "v", *_MARKS), ["a", "n"]), "lists")
        pairs = pairs.union(marked.groupBy("token", "block").applyInArrow(_forest(percent), _PAIR))
    alike = written(_ordered(pairs), "alike")
    links = _links(texts, alike, percent)
    labels = components(links)
    if hot:
        labels = written(labels, "labels")
        marked = join_skewed(marked, labels.select(F.col("vertex").alias("v"), "label"), ["v"], "left").withColumn("label", F.coalesce("label", "v"))
        rest = _scattered(marked, block).groupBy("token", "p", "q").applyInArrow(_across(percent), _PAIR)
        rest = written(_ordered(rest).join(alike, list(_PAIR_NAMES), "left_anti"), "rest")
        if rest.limit(1).count():
            labels = components(links.union(_links(texts, rest, percent)))
    labels = written(labels, "labels")
    named = nodes.select("sig", "n", "v", "least").join(labels.withColumnRenamed("vertex", "v"), "v", "left")
    named = written(named.select("sig", "n", "least", F.coalesce("label", "v").alias("label")), "named")
    heads = named.groupBy("label").agg(F.min("least").alias("head"))
    named = join_skewed(named, heads, ["label"]).select("sig", "n", "head", "label")
    out = join_skewed(members.select("doc_id", "sig", "n"), named, ["sig", "n"], "left")
    return out.select("doc_id", _size("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("doc_id")).alias("component_id"), "sig", "n", F.col("label").alias("component"))


def _with_nodes(columns: list[str], names: tuple[str, str], empty: bool):
    """Adds each row's node; either the rows with empty sets, or the others, each id and node once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen, keep = batch.column("doc_id").to_pylist(), set(), np.zeros(batch.num_rows, bool)
            sig, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, key, first in shingle_sets(batch.column("text")):
                at = slice(row, row + len(first) - 1)
                s, n[at], _ = _nodes_of(key, first)
                sig[at] = s.view(np.int64)
            for i, x in enumerate(zip(ids, sig.tolist(), n.tolist(), strict=True)):
                if empty or x[2] == 0:
                    keep[i] = empty and x[2] == 0
                elif x not in seen:
                    seen.add(x)
                    keep[i] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig), pa.array(n)], [*columns, *names]).filter(pa.array(keep))

    return run


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all their columns as they were: of each component the document with the least id.

    An id that is null comes last; of rows alike in id and set, one stays.  Every
    document without words is a group of its own.
    """
    names = ("_sig", "_n")
    while set(names) & set(docs.columns):
        names = (names[0] + "_", names[1] + "_")
    found = join(docs, percent).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("sig").alias("sig"), F.col("n").alias("n"))
    # a component of texts without any id is told by its label
    heads = found.groupBy("component").agg(F.min(place).alias("p")).select("p.id", "p.sig", "p.n")
    wide = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType())])
    rows = docs.mapInArrow(_with_nodes(docs.columns, names, False), wide)
    kept = rows.join(heads, rows["doc_id"].cast("long").eqNullSafe(heads["id"]) & (rows[names[0]] == heads["sig"]) & (rows[names[1]] == heads["n"]), "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", *names).orderBy(F.lit(1)))
    kept = kept.withColumn("_one" + names[0], one).where(F.col("_one" + names[0]) == 1).select(*docs.columns)
    return kept.unionByName(docs.mapInArrow(_with_nodes(docs.columns, names, True), wide).select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.v = w.doc_id
"""
