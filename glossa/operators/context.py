"""Errors of a system with the text around them, from one pass over each document.

Both sides and the text meet by document in one shuffle.  A text is walked once, whatever
the number of its errors: what is cut out of it is found by where its code points begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.matching import KEYS
from glossa.operators.official import _ranges
from glossa.operators.sweep import PIECE, _rank, by_document, codes, kinds, numbers, pieces

#: Code points on either side of a span.
REACH = 30
_GOLD, _SYSTEM, _TEXT = range(3)
_KINDS = pa.array(["fn", "fp"])
#: What stands around the parts of a context; it goes before the texts that are cut.
_MARKS, _DOTS, _OPEN, _CLOSE = "...>>><<<", 0, 3, 6


class _Cuts:
    """`...before>>>span<<<after...` of spans (start, end) of texts, clipped to the text; which: the text of each span."""

    def __init__(self, texts: pa.Array, which: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int):
        filled = pc.fill_null(texts, "")
        parts = pa.concat_arrays([pa.array([_MARKS], filled.type), filled])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), pa.scalar("", filled.type))
        self.bytes = np.frombuffer(joined[0].as_buffer(), np.uint8)
        begins = np.append(np.flatnonzero((self.bytes & 0xC0) != 0x80), len(self.bytes))
        length = pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
        first, most = (len(_MARKS) + np.cumsum(length) - length)[which], length[which]
        left, a, b, right = (begins[first + np.clip(at, 0, most)] for at in (start - reach, start, end, end + reach))
        fixed = lambda n: np.full(len(which), n)
        self.first = np.stack([fixed(_DOTS), left, fixed(_OPEN), a, fixed(_CLOSE), b, fixed(_DOTS)], axis=1)
        self.size = np.stack([fixed(3), a - left, fixed(3), np.maximum(b - a, 0), fixed(3), right - b, fixed(3)], axis=1)

    def parts(self) -> Iterator[tuple[slice, pa.Array]]:
        """The contexts in order, as many at once as have so many bytes."""
        total, at = np.cumsum(self.size.sum(axis=1)), 0
        while at < len(total):
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + PIECE, "right")))
            offsets = np.append(0, total[at:to] - before).astype(np.int32)
            data = self.bytes[_ranges(self.first[at:to].ravel(), self.size[at:to].ravel())]
            yield slice(at, to), pa.StringArray.from_buffers(to - at, pa.py_buffer(offsets), pa.py_buffer(data))
            at = to


def _lone(table: pa.Table, document: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Spans without one of equal start, end and tag (null equals null) on the other side, in the order of their documents."""
    spans = np.flatnonzero(side != _TEXT)
    if not len(spans):
        return spans
    order, new = _rank(document[spans], *(codes(table.column(c))[spans] for c in ("start", "end", "tag")))
    rows, first = spans[order], np.flatnonzero(new)
    has = lambda n: np.logical_or.reduceat(side[rows] == n, first)
    return rows[np.repeat(has(_GOLD) != has(_SYSTEM), np.diff(np.append(first, len(rows))))]


def errors_in_context(rows: DataFrame, texts: DataFrame, keys: list[str] = KEYS, reach: int = REACH) -> DataFrame:
    """matching.analyzer_sides' errors (fp, fn) whose document has a text, with what stands around them: keys, tag, kind, start, end, context.

    The context is null where the text or a place is null; of several texts with equal keys each gives its own.
    """
    columns = ["tag", "start", "end"]
    spans = rows.select(*keys, F.col("s").cast("int").alias("_side"), *columns, F.lit(None).cast("string").alias("text"))
    words = texts.select(*keys, F.lit(_TEXT).alias("_side"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns), F.col("text").cast("string").alias("text"))
    every = spans.unionByName(words).dropna(subset=keys)

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("_side").to_numpy()
        errors = _lone(table, document, side)
        start, end = numbers(table, "start", "end")
        placed = pc.is_valid(table.column("start")).to_numpy() & pc.is_valid(table.column("end")).to_numpy()
        at = np.flatnonzero(side == _TEXT)
        lo, hi = (np.searchsorted(document[errors], document[at], x) for x in ("left", "right"))
        some = np.flatnonzero(hi > lo)
        held = pa.RecordBatch.from_arrays([table.column("text").take(pa.array(at[some])).combine_chunks(), pa.array(lo[some]), pa.array(hi[some] - lo[some])], ["text", "lo", "n"])
        for piece in pieces(held):
            texts, first, n = piece.column("text"), piece.column("lo").to_numpy(), piece.column("n").to_numpy()
            which, own = np.repeat(np.arange(len(n)), n), errors[_ranges(first, n)]
            known = placed[own] & pc.is_valid(texts).to_numpy(zero_copy_only=False)[which]
            for part, context in _Cuts(texts, which, start[own], end[own], reach).parts():
                if not known[part].all():
                    context = pc.if_else(pa.array(known[part]), context, pa.scalar(None, pa.string()))
                taken = pa.array(own[part])
                take = lambda c, taken=taken: table.column(c).take(taken)
                yield pa.table([*map(take, keys), take("tag"), _KINDS.take(pa.array(side[own[part]])), take("start"), take("end"), context], names=[*keys, "tag", "kind", "start", "end", "context"])

    schema = ", ".join([*kinds(every, [*keys, "tag"]), "kind string", *kinds(every, ["start", "end"]), "context string"])
    return by_document(every, keys, work, schema)
