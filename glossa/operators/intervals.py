"""Joins of spans by place, and folds over the spans of a document.

Places are 0-based code points, ends exclusive.  Joins by place sweep over both sides of
a document (sweep.py), so a long document is not compared span by span.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.sweep import met_pairs, pieces

def contained(inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Column:
    """Closed: outer.start <= inner.start and inner.end <= outer.end."""
    return (outer[0] <= inner[0]) & (inner[1] <= outer[1])


def overlapping(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Half-open: the spans share a place."""
    return F.greatest(a[0], b[0]) < F.least(a[1], b[1])


def near(a: tuple[Column, Column], b: tuple[Column, Column], tolerance: int) -> Column:
    """Any two of the four ends are within the tolerance."""
    out = F.lit(False)
    for x in a:
        for y in b:
            out = out | (F.abs(x - y) <= tolerance)
    return out


def overlap_length(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))


def overlap_percent(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Shared places in percent of a's length; 0 for an empty a."""
    return F.coalesce(F.try_divide(100.0 * overlap_length(a, b), (a[1] - a[0]).cast("double")), F.lit(0.0))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], on: Column, how: str = "inner", slack: int = 0) -> DataFrame:
    """Pairs of rows with equal keys whose spans meet (or are `slack` apart at most) and that satisfy `on`.

    left has start and end, right has r_start and r_end; other columns are told apart by
    name.  One pass over both sides of each document, after one shuffle.
    """
    pairs = met_pairs(left, right, keys, slack).where(on)
    if how == "inner":
        return pairs
    mine = [c for c in right.columns if c not in keys]
    return left.join(pairs.select(*left.columns, *mine), left.columns, "left")


def merged_spans(spans: DataFrame, texts: DataFrame, key: str = "doc_id", side: str | None = None) -> DataFrame:
    """Spans joined over gaps without a letter or digit: key, start, end (and side, if spans have several to be joined apart).

    Only the gap to the span before counts, also if that one ends later; the end is the
    last span's end, so it can shrink over nested spans.
    """
    # a document's text meets its spans once, not once a span or a side
    rank = F.col(side).cast("long") if side else F.lit(0).cast("long")
    one = F.struct(rank.alias("side"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    grouped = spans.groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("s")).join(texts.select(key, "text"), key)
    kind = dict(grouped.dtypes)[key]
    rows = grouped.select(key, "text", *(F.col(f"s.{c}").alias(c) for c in ("side", "start", "end"))).mapInArrow(_islands, f"key {kind}, side long, start long, end long")
    return rows.select(F.col("key").alias(key), "start", "end", *([F.col("side").alias(side)] if side else []))


@functools.cache
def _alphanumeric() -> np.ndarray:
    """True for the code points of letters and digits (categories L and N)."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)])


def _islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each document's sorted spans; gaps are looked up in running counts of letters and digits, so a text is walked once."""
    for batch in (piece for whole in batches for piece in pieces(whole)):
        out = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            side, start, end = (batch.column(c)[i].values.to_numpy() for c in (2, 3, 4))
            if text is None or not len(start):
                continue
            before = np.concatenate([[0], np.cumsum(_alphanumeric()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])])
            at, to = (np.clip(x, 0, len(before) - 1) for x in (end[:-1], start[1:]))
            new = np.concatenate([[True], (side[1:] != side[:-1]) | (before[to] > before[at])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            # places are sorted, so an island's first start is its least
            out.append((np.full(len(first), i), side[first], start[first], end[last]))
        at, *columns = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], ["key", "side", "start", "end"])


def uncovered(length: Column, covered: Column) -> Column:
    """array<struct<start, end>>: what sorted spans leave of [0, length), in order; touching spans merge."""
    clipped = F.filter(
        F.transform(covered, lambda x: F.struct(F.greatest(F.lit(0).cast("long"), x["start"].cast("long")).alias("start"), F.least(length.cast("long"), x["end"].cast("long")).alias("end"))),
        lambda x: x["start"] < x["end"],
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, x: Column) -> Column:
        piece = F.struct(done["at"].alias("start"), x["start"].alias("end"))
        out = F.when(x["start"] > done["at"], F.concat(done["out"], F.array(piece))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("out"))

    end = F.aggregate(F.array_sort(clipped), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)
    tail = F.struct(end["at"].alias("start"), length.cast("long").alias("end"))
    return F.when(end["at"] < length, F.concat(end["out"], F.array(tail))).otherwise(end["out"])
