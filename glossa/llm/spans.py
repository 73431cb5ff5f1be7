"""Where patterns match, in code points, with SQL functions alone.

Spark returns the texts of matches but not their places.  Each match is therefore taken
together with the gap before it (\\G keeps the next search at the end of the last match,
so a text is walked once), and the places are running sums of code points.

Patterns must be written so that no run of characters is tried from each of its own
characters again: possessive quantifiers, and a look-behind or \\G before a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: a lambda's argument is, a plain expression is at each place where it stands."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hits(text: Column, pattern: str | Column, gate: Column) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; empty where the gate is false.

    pattern: without capturing groups.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def every(group: int) -> Column:
        return F.regexp_extract_all(text, F.concat(F.lit(r"(?s)\G(.*?)("), pattern, F.lit(")")), F.lit(group))

    def add(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        return F.struct((start + F.length(step["found"])).cast("int").alias("at"), F.concat(done["out"], F.array(start.cast("int"))).alias("out"))

    steps = F.zip_with(every(1), every(2), lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def placed(s: Column) -> Column:
        starts = F.aggregate(s, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]
        return F.zip_with(starts, s, lambda at, x: F.struct(at.alias("start"), (at + F.length(x["found"])).cast("int").alias("end"), x["found"].alias("found")))

    return F.when(gate, once(steps, placed)).otherwise(none)


def tagged(kind: int, found: Column) -> Column:
    """array<struct<start, kind, end>>, which sorts as the results list spans."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def apart(spans: Column, others: Column) -> Column:
    """The spans that touch none of the others."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each sorted span replaced by its mark; of overlapping spans the first stays whole."""

    def step(done: Column, x: Column) -> Column:
        new = F.struct(x["end"].alias("at"), F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), mark(x)).alias("out"))
        rest = F.struct(F.greatest(done["at"], x["end"]).alias("at"), done["out"].alias("out"))
        return F.when(x["start"] >= done["at"], new).otherwise(rest)

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))
