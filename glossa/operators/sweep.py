"""Spans of two sides of a document met in one pass over both.

Both sides go through one shuffle by document and are sorted by it; then whole documents
are taken from the stream of sorted rows, many at once, and their spans are matched by
sorted places: what can meet a span lies between two binary searches, one for each
class of lengths (powers of two), so a long span does not widen the search for others.
Time is near the number of spans and of pairs that meet.

Places are 0-based code points, ends exclusive.  Keys that are null are equal here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are looked at together: bounds the temporary arrays.
PAIRS = 1 << 21
#: Bytes of texts that are taken from a batch together: bounds what is made of them.
PIECE = 1 << 20

Work = Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, as many at once as have so many bytes in a column of texts; a longer text comes alone."""
    total, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def _changes(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """For each row: do the keys differ?  Null equals null."""
    out = np.zeros(a.num_rows, bool)
    for k in keys:
        x, y = a.column(k), b.column(k)
        out |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | (pc.is_null(x).to_numpy(zero_copy_only=False) != pc.is_null(y).to_numpy(zero_copy_only=False))
    return out


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows whose keys differ from those of the row before, without the first."""
    n = batch.num_rows
    return np.flatnonzero(_changes(batch.slice(1), batch.slice(0, n - 1), keys)) + 1


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole documents, with each row's document counted from 0; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        new = np.zeros(t.num_rows, np.int64)
        new[_starts(t.to_batches()[0], keys)] = 1
        return t, np.cumsum(new)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = _starts(batch, keys)
        if held and _changes(held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1), keys)[0]:
            cut = np.concatenate([[0], cut])
        if len(cut):
            if held or cut[-1]:
                yield whole([*held, batch.slice(0, cut[-1])] if cut[-1] else held)
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
    if held:
        yield whole(held)


#: So many neighbouring rows of a document travel as one.
RUN = 16


def _bundled(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys as one row: the keys, and the other columns as a compressed batch in `_rows`.  Shorter runs stay as they are."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = np.concatenate([[0], _starts(batch, keys)])
        size = np.diff(np.append(first, n))
        long = size >= RUN
        alone = batch.take(pa.array(np.flatnonzero(~np.repeat(long, size))))
        names = [*batch.schema.names, "_rows"]
        yield pa.RecordBatch.from_arrays([*alone.columns, pa.nulls(alone.num_rows, pa.binary())], names)
        values = batch.drop_columns(keys)
        runs = [values.slice(a, k).serialize() for a, k in zip(first[long].tolist(), size[long].tolist(), strict=True)]
        blobs = [x.size.to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in runs]
        at = pa.array(first[long])
        columns = [batch.column(f.name).take(at) if f.name in keys else pa.nulls(len(blobs), f.type) for f in batch.schema]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], names)


def _unbundled(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of _bundled, in the same order of keys."""
    for batch in (piece for whole in batches for piece in pieces(whole, "_rows", PIECE // 4)):
        plain = batch.drop_columns(["_rows"])
        names = plain.schema.names
        schema = plain.drop_columns(keys).schema
        parts, at = [], 0
        for i, blob in enumerate(batch.column("_rows").to_pylist()):
            if blob is None:
                continue
            if at < i:
                parts.append(plain.slice(at, i - at))
            run = pa.ipc.read_record_batch(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd"), schema)
            own = {k: plain.column(k).take(pa.array(np.full(run.num_rows, i))) for k in keys}
            parts.append(pa.RecordBatch.from_arrays([own[c] if c in own else run.column(c) for c in names], schema=plain.schema))
            at = i + 1
        if at < batch.num_rows:
            parts.append(plain.slice(at))
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def by_document(rows: DataFrame, keys: list[str], work: Work, schema: str, together: bool = False) -> DataFrame:
    """work's tables for whole documents, many at a time: one shuffle, and one sort by the keys.

    together: the rows of a document mostly stand together already (as tokens do); they
    then go through the shuffle as one compressed row, in a third of the bytes or so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, document in _gathered(_unbundled(batches, keys) if together else batches, keys):
            for out in work(table, document):
                yield from out.combine_chunks().to_batches()

    if together:
        rows = rows.mapInArrow(lambda batches: _bundled(batches, keys), ", ".join([*kinds(rows, rows.columns), "_rows binary"]))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def swept(left: DataFrame, right: DataFrame, keys: list[str], work: Work, schema: str, together: bool = False) -> DataFrame:
    """by_document for two sides: work gets columns keys, _side (0 left, 1 right), and those of both sides by name, null on the other side's rows."""
    columns = lambda df: [c for c in df.columns if c not in keys]
    every = {**{c: left.schema[c].dataType for c in columns(left)}, **{c: right.schema[c].dataType for c in columns(right)}}
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in every.items()))
    return by_document(side(left, 0).unionByName(side(right, 1)), keys, work, schema, together)


def kinds(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def meeting(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of left and right spans that touch or are `slack` apart at most; each side is (group, start, end), equal groups meet."""
    (d1, a1, b1), (d2, a2, b2) = left, right
    if not len(d1) or not len(d2):
        return
    b1, b2 = np.maximum(a1, b1), np.maximum(a2, b2)
    low = min(int(a1.min()), int(a2.min()))
    width = max(int(b1.max()), int(b2.max())) - low + slack + 2
    place = lambda d, at: d * width + np.clip(at - low, 0, width - 1)
    order = np.argsort(place(d2, a2), kind="stable")
    classes = np.where(b2 > a2, np.frexp((b2 - a2).astype(np.float64))[1], 0)
    for c in np.unique(classes).tolist():
        own = order[classes[order] == c]
        keys = place(d2[own], a2[own])
        lo = np.searchsorted(keys, place(d1, a1 - slack - (1 << c)), "left")
        n = np.maximum(np.searchsorted(keys, place(d1, b1 + slack), "right") - lo, 0)
        some = np.flatnonzero(n)
        total, at = np.cumsum(n[some]), 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            i, count = some[at:to], n[some[at:to]]
            first = np.cumsum(count) - count
            j = own[np.repeat(lo[i], count) + np.arange(int(count.sum())) - np.repeat(first, count)]
            i = np.repeat(i, count)
            near = b2[j] >= a1[i] - slack
            yield i[near], j[near]
            at = to


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values; -1 for null."""
    encoded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [pc.fill_null(table.column(n).cast(pa.int64()), 0).to_numpy() for n in names]


def met_pairs(left: DataFrame, right: DataFrame, keys: list[str], slack: int = 0) -> DataFrame:
    """All pairs of a left span (start, end) and a right one (r_start, r_end) of equal keys, none null, that touch or are `slack` apart at most."""
    mine, other = ([c for c in df.columns if c not in keys] for df in (left, right))

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("_side").to_numpy()
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)  # noqa: E741
        a, b, c, d = numbers(table, "start", "end", "r_start", "r_end")
        for i, j in meeting((document[l], a[l], b[l]), (document[r], c[r], d[r]), slack):
            at, to = pa.array(l[i]), pa.array(r[j])
            yield pa.table([*(table.column(x).take(at) for x in (*keys, *mine)), *(table.column(x).take(to) for x in other)], names=[*keys, *mine, *other])

    there = lambda df: df.dropna(subset=keys)
    return swept(there(left), there(right), keys, work, ", ".join([*kinds(left, [*keys, *mine]), *kinds(right, other)]))


def _rank(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the columns, and for each row in that order whether it differs from the one before."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, new


def matched_exactly(document: np.ndarray, side: np.ndarray, order: np.ndarray, on: list[np.ndarray]) -> np.ndarray:
    """Rows that have a partner on the other side, one to one, equal ones in their order."""
    rows, new = _rank(document, *on)
    group = np.empty(len(rows), np.int64)
    group[rows] = np.cumsum(new) - 1
    by_side = np.lexsort((order, side, group))
    key = group[by_side] * 2 + side[by_side]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    nth = np.empty(len(rows), np.int64)
    nth[by_side] = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    n = np.bincount(group * 2 + side, minlength=2 * (int(group.max(initial=-1)) + 1)).reshape(-1, 2)
    return nth < n.min(axis=1)[group] if len(rows) else np.zeros(0, bool)


def best_of(i: np.ndarray, *worse: np.ndarray) -> np.ndarray:
    """For each number in i the place of its best pair: least in the first column, then the next."""
    order, _ = _rank(i, *worse)
    return order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order


def _listed(owner: np.ndarray, documents: int, columns: dict[str, pa.Array]) -> pa.ListArray:
    """A list of structs a document; owners are sorted."""
    offsets = np.searchsorted(owner, np.arange(documents + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def document_matches(gold: DataFrame, system: DataFrame, keys: list[str], on: list[str], by_tag: bool = True, inclusion: bool = True, overlaps: bool = False, modes: list[tuple[list[str], bool]] | None = None, lists: bool = False) -> DataFrame:
    """One row a document (and mode, if there are several: pairs of on and by_tag), from one pass over its spans (ord, start, end, tag, and text if there):

    n_gold, n_sys; n_both: spans equal in `on`, one to one; n_inside: gold spans left that
    lie within a system span left; held: those system spans, with the number of gold
    spans and what these leave of them (places from the span's start); lost: gold spans that
    neither finds, with the largest share that a system span covers, and the first of
    those; and, if asked for, all that overlap.  lists: also exact, the gold spans that have
    an equal one, and surplus, the system spans that neither phase uses.  by_tag: inclusions and overlaps are
    of equal tags, which are not null.
    """
    texts = "text" in system.columns
    names = ["ord", "start", "end", "tag", *(["text"] if texts else [])]
    own = {n: gold.schema[n].dataType.simpleString() for n in names if n in gold.columns}
    sys_ = {n: system.schema[n].dataType.simpleString() for n in names}
    piece = "array<struct<start:bigint,end:bigint>>"
    held_kind = ",".join([*(f"sys_{n}:{t}" for n, t in sys_.items()), "n_gold:bigint", f"uncovered:{piece}"])
    lost_kind = ",".join([*(f"{n}:{t}" for n, t in own.items()), "percent:double", f"sys_ord:{sys_['ord']}", *([f"overlaps:array<struct<sys_ord:{sys_['ord']},percent:double>>"] if overlaps else [])])
    several = modes is not None
    modes = modes or [(on, by_tag)]
    schema = ", ".join([*kinds(gold, keys), *(["mode int"] if several else []), "n_gold long", "n_sys long", "n_both long", "n_inside long", f"held array<struct<{held_kind}>>", f"lost array<struct<{lost_kind}>>"])
    if lists:
        schema += "".join(f", {c} array<struct<{','.join(f'{n}:{t}' for n, t in k.items())}>>" for c, k in (("exact", own), ("surplus", sys_)))

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        for mode, (on, by_tag) in enumerate(modes):
            yield matched(table, document, mode, on, by_tag)

    def matched(table: pa.Table, document: np.ndarray, mode: int, on: list[str], by_tag: bool) -> pa.Table:
        n = int(document[-1]) + 1
        side = table.column("_side").to_numpy().astype(np.int64)
        order, start, end = numbers(table, "ord", "start", "end")
        tag = codes(table.column("tag"))
        values = {"start": start, "end": end, "tag": tag}
        equal = matched_exactly(document, side, order, [values[c] if c in values else codes(table.column(c)) for c in on])
        count = lambda rows: np.bincount(document[rows], minlength=n)
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        group = document * (int(tag.max(initial=0)) + 2) + tag + 1 if by_tag else document
        usable = tag >= 0 if by_tag else np.ones(len(tag), bool)
        left = np.flatnonzero((side == 0) & ~equal)
        inside = np.zeros(len(side), bool)
        held_rows = np.zeros(0, np.int64)
        if inclusion:
            g, s = left[usable[left]], np.flatnonzero((side == 1) & ~equal & usable)
            held_rows, n_gold, uncovered, found = _included((group[s], start[s], end[s], order[s]), (group[g], start[g], end[g]))
            held_rows = s[held_rows]
            inside[g[found]] = True
        lost = left[~inside[left]]
        all_sys = theirs[usable[theirs]]
        share, which, every = _covered((group[lost], start[lost], end[lost]), (group[all_sys], start[all_sys], end[all_sys], order[all_sys]), usable[lost], overlaps)
        take = lambda name, rows: table.column(name).take(pa.array(rows)).combine_chunks()
        flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        none = np.zeros(len(held_rows) + 1, np.int32)
        if inclusion:
            pieces = uncovered
        else:
            n_gold, pieces = np.zeros(0, np.int64), pa.ListArray.from_arrays(pa.array(none), pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["start", "end"]))
        held = _listed(document[held_rows], n, {**{f"sys_{c}": flat(take(c, held_rows)) for c in sys_}, "n_gold": pa.array(n_gold), "uncovered": pieces})
        sys_ord = pa.array(np.append(all_sys, 0)[which], mask=which < 0)
        extra = {}
        if overlaps:
            i, j, percent = every
            extra["overlaps"] = _listed(i, len(lost), {"sys_ord": flat(take("ord", all_sys[j])), "percent": pa.array(percent)})
        missed = _listed(document[lost], n, {**{c: flat(take(c, lost)) for c in own}, "percent": pa.array(share), "sys_ord": flat(table.column("ord").take(sys_ord)), **extra})
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        counts = [pa.array(count(rows)) for rows in (ours, theirs, ours[equal[ours]], np.flatnonzero(inside))]
        told = [pa.array([mode] * n, pa.int32())] if several else []
        more = []
        if lists:
            used = np.zeros(len(side), bool)
            used[held_rows] = True
            spare = theirs[~equal[theirs] & ~used[theirs]]
            more = [_listed(document[rows], n, {c: flat(take(c, rows)) for c in names_}) for rows, names_ in ((ours[equal[ours]], own), (spare, sys_))]
        return pa.table([*(table.column(k).take(pa.array(first)) for k in keys), *told, *counts, held, missed, *more], names=[*keys, *(["mode"] if several else []), "n_gold", "n_sys", "n_both", "n_inside", "held", "lost", *(["exact", "surplus"] if lists else [])])

    pick = lambda df: df.select(*keys, *(c for c in names if c in df.columns))
    return swept(pick(gold), pick(system), keys, work, schema)


def _included(outer: tuple[np.ndarray, ...], inner: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, pa.ListArray, np.ndarray]:
    """Outer spans with inner ones inside, in the order of their groups and then of theirs: their numbers, how many are inside, what is left over; and the inner spans that are inside of any."""
    g, a, b, rank = outer
    _, c, d = inner
    found = [(i[k], j[k]) for i, j in meeting((g, a, b), inner) for k in [np.flatnonzero((a[i] <= c[j]) & (d[j] <= b[i]))]]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((d[j], c[j], i))
    i, j = i[order], j[order]
    spans, n_gold = np.unique(i, return_counts=True)
    # inner spans that hold something, as places within the outer one
    real = d[j] > c[j]
    at, x, y = i[real], c[j][real] - a[i[real]], d[j][real] - a[i[real]]
    length = b - a
    # the outer span's two ends stand before and after what is inside
    owner = np.concatenate([spans, at, spans])
    sort = np.lexsort((np.concatenate([np.zeros(len(spans)), np.ones(len(at)), np.full(len(spans), 2)]), owner))
    owner = owner[sort]
    x = np.concatenate([np.zeros(len(spans), np.int64), x, length[spans]])[sort]
    y = np.concatenate([np.zeros(len(spans), np.int64), y, length[spans]])[sort]
    big = int(y.max(initial=0)) + 1
    number = np.searchsorted(spans, owner)
    reached = np.maximum.accumulate(y + number * big) - number * big if len(y) else y
    gap = np.flatnonzero((owner[1:] == owner[:-1]) & (x[1:] > reached[:-1])) + 1
    pieces = _listed(number[gap], len(spans), {"start": pa.array(reached[gap - 1]), "end": pa.array(x[gap])})
    sort = np.lexsort((rank[spans], g[spans]))
    return spans[sort], n_gold[sort], pieces.take(pa.array(sort)), np.unique(j)


def _covered(lost: tuple[np.ndarray, ...], system: tuple[np.ndarray, ...], usable: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For each lost span: the largest share in percent that one system span covers, and the number of the first such, or -1; and all overlaps, if asked for."""
    g, a, b = lost
    _, c, d, rank = system
    rows = np.flatnonzero(usable)
    share, which, kept = np.zeros(len(a)), np.full(len(a), -1, np.int64), []
    for i, j in meeting((g[rows], a[rows], b[rows]), (system[0], c, d)):
        i = rows[i]
        both = np.minimum(b[i], d[j]) - np.maximum(a[i], c[j])
        real = both > 0
        i, j = i[real], j[real]
        percent = 100.0 * both[real] / (b[i] - a[i])
        if every:
            kept.append((i, j, percent))
        first = best_of(i, -percent, rank[j])
        i, j, percent = i[first], j[first], percent[first]
        better = (percent > share[i]) | ((percent == share[i]) & (which[i] >= 0) & (rank[j] < rank[np.maximum(which[i], 0)]))
        share[i[better]], which[i[better]] = percent[better], j[better]
    if not kept:
        return share, which, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    i, j, percent = (np.concatenate(x) for x in zip(*kept, strict=True))
    sort = np.lexsort((rank[j], i))
    return share, which, (i[sort], j[sort], percent[sort])
