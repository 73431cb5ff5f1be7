"""Nine ways to match system spans with gold spans.

They disagree on purpose: each is a definition of its own.  Frames have the key columns
(document, or system and document), start, end, and further columns by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.intervals import contained, interval_join, uncovered
from glossa.operators.official import merged_rows
from glossa.operators.sweep import best_of, codes, document_matches, kinds, meeting, numbers, swept

KEYS = ["doc_id"]
#: For spans of which it is known already that none has an equal one: the side tells all apart.
NO_PHASE = ["_side"]


def common(gold: DataFrame, system: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Both sides, restricted to documents that both have; documents of one side alone are ignored."""
    both = gold.select(*keys).distinct().intersect(system.select(*keys).distinct())
    return gold.join(both, keys, "left_semi"), system.join(both, keys, "left_semi")


def strict(gold: DataFrame, system: DataFrame, on: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One row a different span: keys, on, in_gold, in_sys.  Sets, so repeated spans count once."""
    columns = [*keys, *on]
    g = gold.select(*columns, F.lit(1).alias("g"), F.lit(0).alias("s"))
    s = system.select(*columns, F.lit(0).alias("g"), F.lit(1).alias("s"))
    return strict_sides(g.unionByName(s), on, keys)


def strict_sides(rows: DataFrame, on: list[str], keys: list[str] = KEYS) -> DataFrame:
    """strict for both sides in one frame: g and s are 1 for spans of gold and of the system, else 0."""
    return _sets(rows, on, ["g", "s"], keys).select(*keys, *on, (F.col("g") == 1).alias("in_gold"), (F.col("s") == 1).alias("in_sys"))


def strict_runs(rows: DataFrame, on: list[str], runs: dict[str, str], keys: list[str] = KEYS) -> DataFrame:
    """strict for several runs against one gold side (g): run, keys, on, in_gold, in_sys; runs: their names and 0/1 columns."""
    each = F.array(*(F.struct(F.lit(name).alias("run"), (F.col("g") == 1).alias("in_gold"), (F.col(c) == 1).alias("in_sys")) for name, c in runs.items()))
    sets = _sets(rows, on, ["g", *runs.values()], keys).select(*keys, *on, F.explode(each).alias("r"))
    return sets.select("r.run", *keys, *on, "r.in_gold", "r.in_sys").where("in_gold OR in_sys")


def _sets(rows: DataFrame, on: list[str], sides: list[str], keys: list[str]) -> DataFrame:
    """One row a different span, with the sides that have it.

    One aggregation serves intersection and differences, with one shuffle: by the keys, so
    that the spans of a document stay together (they pack better than scattered ones), nothing
    is combined before it, where hardly any span repeats, and counts a document need no other.
    """
    return rows.repartition(*keys).groupBy(*keys, *on).agg(*(F.max(c).alias(c) for c in sides))


def flag_counts() -> list[Column]:
    """tp, fp, fn of rows with in_gold and in_sys."""
    g, s = F.col("in_gold"), F.col("in_sys")
    return [F.count_if(g & s).alias("tp"), F.count_if(s & ~g).alias("fp"), F.count_if(g & ~s).alias("fn")]


def merged(gold: DataFrame, system: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches of spans or of merged spans: key, start, end, kind (tp, fp, fn).

    The intersection holds strict and merged spans alike; a span of one side alone is
    an error unless a span of the intersection contains it.
    """
    return merged_rows(gold, system, texts, key)


def exact_pairs(gold: DataFrame, system: DataFrame, on: list[str], keys: list[str] = KEYS, order: str = "ord") -> DataFrame:
    """One-to-one matches of equal spans, repeated ones in their order: keys, on, gold_ord, sys_ord.

    Both sides go through one shuffle by the keys, which serves numbering and matching.
    """
    columns = [*keys, *on]
    kinds_ = {"gold_ord": gold.schema[order].dataType, "sys_ord": system.schema[order].dataType}
    side = lambda df, own: df.dropna(subset=columns).select(*columns, F.lit(own).alias("_own"), *((F.col(order) if c == own else F.lit(None).cast(t)).alias(c) for c, t in kinds_.items()))
    rows = side(gold, "gold_ord").unionByName(side(system, "sys_ord")).repartition(*keys)
    nth = F.row_number().over(Window.partitionBy(*columns, "_own").orderBy("gold_ord", "sys_ord"))
    pairs = rows.withColumn("_nth", nth).groupBy(*columns, "_nth").agg(F.max("gold_ord").alias("gold_ord"), F.max("sys_ord").alias("sys_ord"), F.count(F.lit(1)).alias("_n"))
    return pairs.where("_n = 2").drop("_nth", "_n")


def paired(gold: DataFrame, system: DataFrame, on: list[str], keys: list[str] = KEYS, order: str = "ord") -> DataFrame:
    """The rows of both sides (common columns) with `side` (gold, sys) and `matched`, as exact_pairs pairs them: one shuffle."""
    columns = [c for c in gold.columns if c in system.columns]
    rows = gold.select(*columns, F.lit("gold").alias("side")).unionByName(system.select(*columns, F.lit("sys").alias("side")))
    nth = F.row_number().over(Window.partitionBy(*keys, *on, "side").orderBy(order))
    equal = F.count(F.lit(1)).over(Window.partitionBy(*keys, *on, "_nth"))
    return rows.withColumn("_nth", nth).withColumn("matched", equal == 2).drop("_nth")


def left_over(gold: DataFrame, system: DataFrame, on: list[str], keys: list[str] = KEYS, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """What exact_pairs leaves of both sides (their common columns)."""
    rest = paired(gold, system, on, keys, order).where("not matched")
    return rest.where("side = 'gold'").drop("side", "matched"), rest.where("side = 'sys'").drop("side", "matched")


def inclusions(gold: DataFrame, system: DataFrame, keys: list[str] = KEYS, by_tag: bool = True) -> DataFrame:
    """System spans that contain gold spans: one row a pair (sys_* and gold_* columns; sys_text if there is one).  A gold span may serve several."""
    inside = contained((F.col("r_start"), F.col("r_end")), (F.col("start"), F.col("end")))
    same = inside & (F.col("tag") == F.col("gold_tag")) if by_tag else inside
    right = gold.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("tag").alias("gold_tag"), F.col("ord").alias("gold_ord"))
    more = [c for c in ("text",) if c in system.columns]
    found = interval_join(system.select(*keys, "start", "end", "tag", "ord", *more), right, keys, same)
    return found.select(*keys, *(F.col(c).alias(f"sys_{c}") for c in more), F.col("ord").alias("sys_ord"), F.col("start").alias("sys_start"), F.col("end").alias("sys_end"), F.col("tag").alias("sys_tag"), "gold_ord", F.col("r_start").alias("gold_start"), F.col("r_end").alias("gold_end"))


def groupings(pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a system span with gold spans inside: their number, and what they leave of it (places from its start)."""
    part = F.struct((F.col("gold_start") - F.col("sys_start")).cast("long").alias("start"), (F.col("gold_end") - F.col("sys_start")).cast("long").alias("end"))
    more = [F.first(c).alias(c) for c in ("sys_text",) if c in pairs.columns]
    held = pairs.groupBy(*keys, "sys_ord", "sys_start", "sys_end", "sys_tag").agg(F.count(F.lit(1)).alias("n_gold"), F.collect_list(part).alias("parts"), *more)
    return held.withColumn("uncovered", uncovered(F.col("sys_end") - F.col("sys_start"), F.col("parts"))).drop("parts")


def two_phase(gold: DataFrame, system: DataFrame, texts: DataFrame, significant, by_tag: bool | None = True, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Exact matches, then inclusions of what is left, in one pass over each document.

    Returns keys with tp, fp, fn a document, and the groupings with `extra` (text beside
    the gold spans that `significant`, a function of a column, accepts: one more false
    positive).  tp and fn count gold spans, fp system spans.  by_tag None: both ways at
    once, told by a column ignore_tags.
    """
    on = ["start", "end", "text", "tag"]
    if by_tag is None:
        docs = document_matches(gold, system, keys, on, modes=[(on, True), (on[:-1], False)]).withColumn("ignore_tags", F.col("mode") == 1)
        keys = [*keys, "ignore_tags"]
    else:
        docs = document_matches(gold, system, keys, on if by_tag else on[:-1], by_tag)
    held = docs.select(*keys, F.explode("held").alias("h"))
    extra = _extra(F.col("h"), significant).alias("extra")
    return phase_counts(docs, keys, significant), held.select(*keys, *(F.col(f"h.{c}") for c in ("sys_ord", "sys_start", "sys_end", "sys_tag", "n_gold", "uncovered")), extra)


def _extra(held: Column, significant) -> Column:
    """Does a system span hold text beside its gold spans that matters?  Its own text is enough to tell."""
    piece = lambda x: F.substring(held["sys_text"], x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))
    return F.coalesce(F.exists(held["uncovered"], lambda x: significant(piece(x))), F.lit(False))


def phase_counts(docs: DataFrame, keys: list[str], significant) -> DataFrame:
    """keys, tp, fp, fn of document_matches' rows."""
    n_held, n_extra = F.size("held"), F.size(F.filter("held", lambda h: _extra(h, significant)))
    return docs.select(*keys, (F.col("n_both") + F.col("n_inside")).alias("tp"), (F.col("n_sys") - F.col("n_both") - n_held + n_extra).alias("fp"), (F.col("n_gold") - F.col("n_both") - F.col("n_inside")).alias("fn"))


def lost_spans(gold: DataFrame, system: DataFrame, on: list[str], by_tag: bool = True, inclusion: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Gold spans without an equal one (in `on`) and, if inclusion, within no system span left: their columns, percent and sys_ord as best_missed has them."""
    docs = document_matches(gold, system, keys, on, by_tag, inclusion)
    return docs.select(*keys, F.explode("lost").alias("l")).select(*keys, "l.*")


def lost_overlaps(gold: DataFrame, system: DataFrame, on: list[str], by_tag: bool = True, inclusion: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """All system spans that share places with lost_spans: keys, ord, sys_ord, percent."""
    docs = document_matches(gold, system, keys, on, by_tag, inclusion, overlaps=True)
    return docs.select(*keys, F.explode("lost").alias("l")).select(*keys, F.col("l.ord").alias("ord"), F.explode("l.overlaps").alias("o")).select(*keys, "ord", "o.*")


def analyzer(gold: DataFrame, system: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Matches by existence of an equal start, end and type (null equals null): keys, tag, start, end, kind.

    Not one to one: repeated system spans each count as tp.
    """
    on = [*keys, "start", "end", "tag"]
    return analyzer_sides(gold.select(*on, F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(system.select(*on, F.lit(0).alias("g"), F.lit(1).alias("s"))), keys)


def analyzer_sides(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """analyzer for both sides in one frame: g and s are 1 for spans of gold and of the system, else 0."""
    on = [*keys, "start", "end", "tag"]
    # one shuffle by the keys, as in strict; groups take null for equal to null
    n = rows.repartition(*keys).groupBy(*on).agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    met = (F.col("g") > 0) & (F.col("s") > 0)
    for k in keys:  # but a null key has no partner
        met = met & F.col(k).isNotNull()
    kinds = F.array(F.struct(F.lit("tp").alias("kind"), F.when(met, F.col("s")).otherwise(0).alias("n")), F.struct(F.lit("fp").alias("kind"), F.when(~met, F.col("s")).otherwise(0).alias("n")), F.struct(F.lit("fn").alias("kind"), F.when(~met, F.col("g")).otherwise(0).alias("n")))
    out = n.select(*on, F.explode(kinds).alias("k")).where("k.n > 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("k.n").cast("int"))))
    return out.select(*keys, "tag", "start", "end", "k.kind")


def best_overlap(gold: DataFrame, system: DataFrame, keys: list[str] = KEYS, tolerance: int = 0) -> DataFrame:
    """For each gold span the system span to blame: an equal one (TP), else the one with most shared places, else the
    first within the tolerance; ties go to the first in order.  Gold spans with neither have no row.

    Columns: keys, ord, gold_tag, pred_tag, kind (TP or CONFUSION).
    """

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("_side").to_numpy()
        g, s = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order, start, end = numbers(table, "ord", "start", "end")
        tag, picked = codes(table.column("tag")), []
        for i, j in meeting((document[g], start[g], end[g]), (document[s], start[s], end[s]), tolerance):
            i, j = g[i], s[j]
            shared = np.minimum(end[i], end[j]) - np.maximum(start[i], start[j])
            close = np.min([np.abs(x[i] - y[j]) for x in (start, end) for y in (start, end)], axis=0) <= tolerance
            i, j, shared = (x[(shared > 0) | close] for x in (i, j, shared))
            exact = (start[i] == start[j]) & (end[i] == end[j]) & (tag[i] == tag[j])
            first = best_of(i, ~exact, -np.maximum(shared, 0), order[j])
            picked.append((i[first], j[first], exact[first], shared[first]))
        if not picked:
            return
        i, j, exact, shared = (np.concatenate(x) for x in zip(*picked, strict=True))
        first = best_of(i, ~exact, -np.maximum(shared, 0), order[j])
        i, j, exact = i[first], j[first], exact[first]
        kind = pa.array(np.where(exact, "TP", "CONFUSION").tolist(), pa.string())
        mine, other = pa.array(i), pa.array(j)
        yield pa.table([*(table.column(k).take(mine) for k in keys), table.column("ord").take(mine), table.column("tag").take(mine), table.column("tag").take(other), kind], names=[*keys, "ord", "gold_tag", "pred_tag", "kind"])

    tag = gold.schema["tag"].dataType.simpleString()
    pick = lambda df: df.select(*keys, "ord", "start", "end", "tag").dropna(subset=keys)
    return swept(pick(gold), pick(system), keys, work, ", ".join([*kinds(gold, [*keys, "ord"]), f"gold_tag {tag}", f"pred_tag {tag}", "kind string"]))


def missed_overlaps(missed: DataFrame, system: DataFrame, keys: list[str] = KEYS, by_tag: bool = True) -> DataFrame:
    """All system spans that share places with missed gold spans: keys, ord, sys_ord, percent (of the gold span)."""
    nothing = system.select(*keys, "ord", "start", "end", "tag")
    return lost_overlaps(missed.select(*keys, "ord", "start", "end", "tag"), nothing, NO_PHASE, by_tag, False, keys)


def best_missed(missed: DataFrame, system: DataFrame, keys: list[str] = KEYS, by_tag: bool = True) -> DataFrame:
    """For each missed gold span the largest share that one system span covers, first of equals; 0 and null without."""
    nothing = system.select(*keys, "ord", "start", "end", "tag")
    return lost_spans(missed.select(*keys, "ord", "start", "end", "tag"), nothing, NO_PHASE, by_tag, False, keys).select(*keys, "ord", "percent", "sys_ord")
