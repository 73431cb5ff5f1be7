"""Lines of files of any size, read in splits, with places that hold for whole files.

A line's number in its file depends on all lines before it, which other tasks read.  So
files are read twice: the first pass counts within each split and gives one row a split;
running sums over these rows give what each split starts with; the second pass adds that
to its own counts.  No line is shuffled, and no task sees more than its split.

Splits are named by file, start and length.  If files are cut differently in the second
pass (since they changed, or a setting did), the result is an error, never a wrong number.
Files that cannot be cut (compressed ones) are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["path", "split_start", "split_length"]
_COUNTS = ("line", "end", "valid", "group")


def file_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, split_start, split_length, line (parted by line feeds; a carriage return before one stays)."""
    rows = spark.read.text(path, lineSep="\n", pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.col("_metadata.file_block_length").alias("split_length"), F.col("value").alias("line"))


def bare(line: Column) -> Column:
    """The line without a carriage return at its end."""
    return F.regexp_replace(line, "\r$", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Stretches of one split, with running counts within the split, and whether a new split begins.

    The counts, a column each: lines; ends; valid lines since the last end; groups (valid
    lines between two ends) begun after the first end.
    """
    key, held = None, np.zeros(4, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        start, path = batch.column("split_start"), batch.column("path")
        cut = pc.or_(pc.not_equal(start[1:], start[:-1]), pc.not_equal(path[1:], path[:-1])).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = batch.slice(a, b - a)
            own = (path[a].as_py(), start[a].as_py())
            new = own != key
            if new:
                key, held = own, np.zeros(4, np.int64)
            end, valid = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_end", "_valid"))
            ends, found = held[1] + np.cumsum(end), np.cumsum(valid)
            last = np.maximum.accumulate(np.where(end > 0, np.arange(len(end)), -1))
            since = np.where(last >= 0, found - (found - valid)[last], held[2] + found)
            groups = held[3] + np.cumsum((valid > 0) & (since == 1) & (ends > 0))
            counts = np.stack([held[0] + np.arange(1, len(end) + 1), ends, since, groups], axis=1)
            held = counts[-1]
            yield part, counts, new


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: its counts, and the valid lines before its first end."""
    key, last, head = None, None, 0

    def row() -> pa.RecordBatch:
        arrays = [[key[0]], [key[1]], [key[2]], *([int(x)] for x in last), [head]]
        return pa.RecordBatch.from_arrays([pa.array(arrays[0]), *(pa.array(a, pa.int64()) for a in arrays[1:])], [*SPLIT, *(f"n_{c}" for c in _COUNTS), "n_head"])

    for part, counts, new in _runs(batches):
        if new:
            if key:
                yield row()
            key, head = tuple(part.column(c)[0].as_py() for c in SPLIT), 0
        head += int(part.column("_valid").to_numpy(zero_copy_only=False)[counts[:, 1] == 0].sum())
        last = counts[-1]
    if key:
        yield row()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, counts, _ in _runs(batches):
        arrays = [*part.columns, *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(4))]
        yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, *(f"i_{c}" for c in _COUNTS)])


def numbered(lines: DataFrame, end: Column | None = None, valid: Column | None = None) -> DataFrame:
    """Adds to lines, as whole files have them: line_no (from 0), part, group_no, pos.

    end: lines that begin a new part; valid: lines that count.  part is the number of ends
    up to the line.  group_no numbers, from 1, the parts that have valid lines; pos numbers
    the valid lines of a part, from 0.  The last two say something for valid lines only.
    lines: from file_lines, with rows of a split in their order (so no shuffle before).
    """
    flag = lambda c, default: F.coalesce(c, F.lit(False)) if c is not None else F.lit(default)
    rows = lines.withColumn("_end", flag(end, False)).withColumn("_valid", flag(valid, True))
    counts = ", ".join(f"n_{c} long" for c in _COUNTS)
    splits = rows.select(*SPLIT, "_end", "_valid").mapInArrow(_summed, f"path string, split_start long, split_length long, {counts}, n_head long")
    # one row a split
    order = Window.partitionBy("path").orderBy("split_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    splits = splits.withColumn("_g", F.sum((F.col("n_end") > 0).cast("int")).over(order))
    # valid lines of the part that is open at a split's end, since the last split with an end
    added = F.when(F.col("n_end") > 0, F.col("n_valid")).otherwise(F.col("n_head"))
    splits = splits.withColumn("_open", F.sum(added).over(Window.partitionBy("path", "_g").orderBy("split_start")))
    splits = splits.withColumn("b_open", F.coalesce(F.lag("_open").over(order), F.lit(0)))
    splits = splits.withColumn("_head", ((F.col("n_head") > 0) & (F.col("b_open") == 0)).cast("long"))
    splits = splits.withColumn("_groups", F.col("n_group") + F.col("_head"))
    base = splits.select(*SPLIT, total("n_line").alias("b_line"), total("n_end").alias("b_end"), "b_open", total("_groups").alias("b_group"), "_head")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    own = rows.mapInArrow(_numbered, f"{kinds}, " + ", ".join(f"i_{c} long" for c in _COUNTS))
    joined = own.join(base, SPLIT, "left")
    known = F.when(F.col("b_line").isNull(), F.raise_error(F.concat(F.lit("files were cut differently in the second pass: "), F.col("path"))).cast("long")).otherwise(F.col("b_line"))
    first = F.col("i_end") == 0
    return joined.select(
        *lines.columns,
        (known + F.col("i_line") - 1).alias("line_no"),
        (F.col("b_end") + F.col("i_end")).alias("part"),
        (F.col("b_group") + F.when(first, (F.col("b_open") == 0).cast("long")).otherwise(F.col("_head") + F.col("i_group"))).alias("group_no"),
        (F.when(first, F.col("b_open")).otherwise(F.lit(0)) + F.col("i_valid") - 1).alias("pos"),
    )
