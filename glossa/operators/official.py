"""Official counts of many systems and subtracks, from one pass over each document.

Gold spans, the spans of all systems, what stands in for missing ones, and the text meet by
document, once, whatever the number of systems and subtracks: nothing is repeated for
each system before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.intervals import _alphanumeric
from glossa.operators.sweep import by_document, codes, kinds, numbers

#: The three subtracks.
SUBTRACKS = ("ner", "spans", "merged")
KINDS = ("tp", "fp", "fn")
_GOLD, _SYSTEM, _FALLBACK, _TEXT = range(4)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of n[i] numbers each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _sets(group: np.ndarray, side: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Different rows: group, columns, and whether either side (0 gold, 1 system) has them."""
    order = np.lexsort((*columns[::-1], group))
    keys = [x[order] for x in (group, *columns)]
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(order) else np.zeros(0, np.int64)
    has = lambda n: np.maximum.reduceat(side[order] == n, first) if len(first) else np.zeros(0, bool)
    return keys[0][first], [k[first] for k in keys[1:]], has(0), has(1)


class _Texts:
    """Running counts of letters and digits of all texts, one after the other."""

    def __init__(self, texts: dict[int, str], documents: int):
        self.length, self.base = np.full(documents, -1, np.int64), np.zeros(documents, np.int64)
        parts, at = [], 0
        for d, text in texts.items():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            parts.append(np.concatenate([[0], np.cumsum(_alphanumeric()[points])]))
            self.length[d], self.base[d] = len(points), at
            at += len(points) + 1
        self.counts = np.concatenate(parts) if parts else np.zeros(1, np.int64)

    def before(self, document: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.counts[self.base[document] + np.clip(place, 0, np.maximum(self.length[document], 0))]


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray, in_gold: np.ndarray, in_sys: np.ndarray, runs: int, texts: _Texts) -> tuple[np.ndarray, ...]:
    """group, start, end and kind (a place in KINDS) of what matches and of the errors.

    The intersection holds strict and merged spans alike; a span of one side alone is
    an error unless a span of the intersection contains it.
    """
    # islands of each side: a gap without a letter or digit joins spans
    rows = np.concatenate([np.flatnonzero(in_gold), np.flatnonzero(in_sys)])
    side = np.repeat([0, 1], [int(in_gold.sum()), int(in_sys.sum())])
    some = texts.length[group[rows] // runs] >= 0
    rows, side = rows[some], side[some]
    order = np.lexsort((end[rows], start[rows], side, group[rows]))
    rows, side = rows[order], side[order]
    g, a, b = group[rows], start[rows], end[rows]
    document = g // runs
    joined = (np.zeros(0, np.int64),) * 3
    if len(rows):
        apart = (g[1:] != g[:-1]) | (side[1:] != side[:-1]) | (texts.before(document[1:], a[1:]) > texts.before(document[:-1], b[:-1]))
        first = np.flatnonzero(np.concatenate([[True], apart]))
        last = np.append(first[1:], len(rows)) - 1
        gi, (ai, bi), of_gold, of_sys = _sets(g[first], side[first], [a[first], b[last]])
        both = of_gold & of_sys
        joined = gi[both], ai[both], bi[both]
    own = np.concatenate([np.ones(len(group), np.int64), np.zeros(len(joined[0]), np.int64)])
    g, a, b = (np.concatenate(x) for x in zip((group, start, end), joined, strict=True))
    mine, theirs = (np.concatenate([x, np.ones(len(joined[0]), bool)]) for x in (in_gold, in_sys))
    order = np.lexsort((b, a, g))
    g, a, b, own, mine, theirs = (x[order] for x in (g, a, b, own, mine, theirs))
    if not len(g):
        return g, a, b, g
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    most = lambda x: np.maximum.reduceat(x, first)
    both, fp, fn = most(mine & theirs), most((own > 0) & theirs & ~mine), most((own > 0) & mine & ~theirs)
    g, a, b = g[first], a[first], b[first]
    # what a match that starts no later and ends no earlier contains is no error
    order = np.lexsort((~both, a, g))
    g, a, b, both, fp, fn = (x[order] for x in (g, a, b, both, fp, fn))
    rank, big = np.cumsum(np.concatenate([[False], g[1:] != g[:-1]])), int(b.max()) + 2
    reached = np.maximum.accumulate(np.where(both, b, -1) + rank * big) - rank * big
    held = reached >= b
    kind = np.where(both, 0, np.where(held, -1, np.where(fp, 1, np.where(fn, 2, -1))))
    told = kind >= 0
    return g[told], a[told], b[told], kind[told]


def _texts_of(table: pa.Table, document: np.ndarray, side: np.ndarray) -> _Texts:
    rows = np.flatnonzero(side == _TEXT)
    texts = table.column("text").take(pa.array(rows)).to_pylist()
    return _Texts({d: t for d, t in zip(document[rows].tolist(), texts, strict=True) if t is not None}, int(document[-1]) + 1)


def merged_rows(gold: DataFrame, system: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches of spans or of merged spans, and the errors: key, start, end, kind (tp, fp, fn); one pass over each document."""
    none = F.lit(None).cast("string").alias("text")
    rows = lambda df, side: df.select(key, F.lit(side).alias("_side"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), none)
    place = F.lit(None).cast("long")
    words = texts.select(key, F.lit(_TEXT).alias("_side"), place.alias("start"), place.alias("end"), F.col("text").cast("string").alias("text"))

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("_side").to_numpy()
        start, end = numbers(table, "start", "end")
        at = np.flatnonzero(side != _TEXT)
        group, (a, b), in_gold, in_sys = _sets(document[at], side[at], [start[at], end[at]])
        g, a, b, kind = _merged(group, a, b, in_gold, in_sys, 1, _texts_of(table, document, side))
        first = pa.array(np.searchsorted(document, g))
        yield pa.table([table.column(key).take(first), a, b, pa.array(KINDS).take(pa.array(kind))], names=[key, "start", "end", "kind"])

    every = rows(gold, _GOLD).unionByName(rows(system, _SYSTEM)).unionByName(words)
    return by_document(every.where(F.col(key).isNotNull()), [key], work, f"{kinds(gold, [key])[0]}, start long, end long, kind string")


def official_counts(gold: DataFrame, systems: DataFrame, subtracks: tuple[str, ...] = SUBTRACKS, texts: DataFrame | None = None, by: tuple[str, ...] = ("system",), fallback: DataFrame | None = None) -> DataFrame:
    """subtrack, by, doc_id, tp, fp, fn of every system's documents that have gold spans.

    by: the columns that tell systems (strings).  fallback: spans that stand in wherever a
    system lacks a gold document; then the systems are gathered first, so they should be few.
    """
    unknown = set(subtracks) - set(SUBTRACKS)
    if unknown:
        raise ValueError(f"subtracks are {', '.join(SUBTRACKS)}")
    named = systems.withColumn("_run", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in by))))
    fixed = sorted(r["_run"] for r in named.select("_run").distinct().collect()) if fallback is not None else None
    spans = {"start": "long", "end": "long", "category": "string", "type": "string"}
    have = lambda df, c, t: F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c)
    rows = lambda df, side: df.select("doc_id", F.lit(side).alias("_side"), have(df, "_run", "string"), *(have(df, c, t) for c, t in spans.items()), *([have(df, "text", "string")] if side == _TEXT else [F.lit(None).cast("string").alias("text")]))
    every = rows(gold.drop("_run"), _GOLD).unionByName(rows(named, _SYSTEM))
    if fallback is not None:
        every = every.unionByName(rows(fallback.drop("_run"), _FALLBACK))
    if "merged" in subtracks:
        every = every.unionByName(rows(texts.select("doc_id", "text"), _TEXT))

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        n, side = int(document[-1]) + 1, table.column("_side").to_numpy()
        start, end = numbers(table, "start", "end")
        category, kind = (codes(table.column(c)) for c in ("category", "type"))
        encoded = table.column("_run").combine_chunks().dictionary_encode()
        names = encoded.dictionary.to_pylist() if fixed is None else fixed
        known = {name: i for i, name in enumerate(names)}
        number = np.array([known[x] for x in encoded.dictionary.to_pylist()] + [0])
        runs = max(len(names), 1)
        g, s, f = (np.flatnonzero(side == x) for x in (_GOLD, _SYSTEM, _FALLBACK))
        group = document[s] * runs + number[encoded.indices.take(pa.array(s)).to_numpy()] if len(s) else np.zeros(0, np.int64)
        n_gold, n_back = (np.bincount(document[x], minlength=n) for x in (g, f))
        at = lambda x: np.searchsorted(document[x], np.arange(n))
        if len(f) and names:
            lacks = np.ones(n * runs, bool)
            lacks[group] = False
            lacks = np.flatnonzero(lacks & (n_gold > 0)[np.arange(n * runs) // runs])
            own = lacks // runs
            s = np.concatenate([s, f[_ranges(at(f)[own], n_back[own])]])
            group = np.concatenate([group, np.repeat(lacks, n_back[own])])
        real = n_gold[group // runs] > 0
        s, group = s[real], group[real]
        groups = np.unique(group)
        if not len(groups):
            return
        own = groups // runs
        mine = g[_ranges(at(g)[own], n_gold[own])]
        both = np.concatenate([mine, s])
        group = np.concatenate([np.repeat(groups, n_gold[own]), group])
        of = np.repeat([0, 1], [len(mine), len(s)])
        place = np.searchsorted(groups, group)
        first = pa.array(np.searchsorted(document, own))
        tally = lambda x: np.bincount(np.searchsorted(groups, x), minlength=len(groups))
        for subtrack in subtracks:
            if subtrack == "ner":
                where, _, in_gold, in_sys = _sets(place, of, [category[both], start[both], end[both], kind[both]])
            else:
                where, (a, b), in_gold, in_sys = _sets(place, of, [start[both], end[both]])
            if subtrack == "merged":
                found, _, _, what = _merged(groups[where], a, b, in_gold, in_sys, runs, _texts_of(table, document, side))
                counts = [tally(found[what == i]) for i in range(len(KINDS))]
            else:
                counts = [tally(groups[where[x]]) for x in (in_gold & in_sys, in_sys & ~in_gold, in_gold & ~in_sys)]
            yield pa.table([pa.array([subtrack] * len(groups)), table.column("doc_id").take(first), pa.array(names, pa.string()).take(pa.array(groups % runs)), *counts], names=["subtrack", "doc_id", "_run", "tp", "fp", "fn"])

    out = by_document(every.where("doc_id is not null"), ["doc_id"], work, f"subtrack string, {kinds(gold, ['doc_id'])[0]}, _run string, tp long, fp long, fn long")
    fields = F.from_json("_run", ", ".join(f"`{c}` string" for c in by))
    return out.withColumn("_run", fields).select("subtrack", *(F.col(f"_run.{c}").cast(systems.schema[c].dataType).alias(c) for c in by), "doc_id", "tp", "fp", "fn")
