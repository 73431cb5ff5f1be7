"""64-bit keys dealt by their leading bits, many to a row.

A key and what belongs to it go through a shuffle as parts of packed arrays: one row for
each batch and bucket instead of one for each key.  A bucket is a range of keys, so all
that share a key meet in one task; the number of buckets follows the input's partitions,
so a bucket's size does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.wordhash import mix

#: Bits of a bitmap that is sent to every task: 16 MB at most.
MAX_BITMAP_BITS = 1 << 27


def bucket_bits(df: DataFrame, per_partition: int = 4) -> int:
    """Leading bits that tell buckets apart, for a frame's number of partitions."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_partition * df.rdd.getNumPartitions())
    return max(1, min(24, int(np.ceil(np.log2(n)))))


def packed(bits: int, keys: np.ndarray, *columns: np.ndarray, spread: np.ndarray | None = None) -> pa.RecordBatch | None:
    """A row for each bucket that has keys: bucket, and the keys and columns as bytes.

    spread: keys with the same number other than 0 there go to a bucket of their own, so a
    hot key's rows can be dealt over many.
    """
    if not len(keys):
        return None
    where = keys if spread is None else np.where(spread > 0, mix(keys ^ mix(spread)), keys)
    order = np.argsort(where)
    bucket = (where[order] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(keys))
    arrays = [pa.array(bucket[cuts], pa.int64())]
    for x in (keys, *columns):
        x = np.ascontiguousarray(x[order])
        arrays.append(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "k", *(f"c{i}" for i in range(len(columns)))])


def schema(columns: int) -> str:
    return "bucket long, k binary" + "".join(f", c{i} binary" for i in range(columns))


def gathered(types: tuple, work: Callable[..., Iterator[pa.RecordBatch]]):
    """A function for mapInArrow after a repartition by bucket: work gets each bucket's number, keys and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for bucket in sorted(held):
            parts = held.pop(bucket)
            columns = [np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate((np.uint64, *types))]
            yield from work(bucket, *columns)

    return run


def dealt(df: DataFrame, bits: int) -> DataFrame:
    return df.repartition(1 << bits, F.col("bucket"))


def bitmap_of(keys: DataFrame, column: str, least: int = 1 << 16, load: int = 64) -> tuple[int, np.ndarray]:
    """A bitmap over the leading bits of 64-bit keys, `load` bits a key up to MAX_BITMAP_BITS.

    Built in pieces: each task marks its keys in its range of the bitmap, and the driver
    gets the ranges.  A set bit says that a key may be there, a clear one that it is not.
    """
    n = keys.count()
    size = least
    while size < min(n * load, MAX_BITMAP_BITS):
        size *= 2
    bits = size.bit_length() - 1
    piece = min(bits - 3, 10)  # 2^piece ranges

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)
            for r in np.unique(at >> np.uint64(bits - piece)).tolist():
                own = at[at >> np.uint64(bits - piece) == np.uint64(r)] & np.uint64((1 << (bits - piece)) - 1)
                ranges.setdefault(r, np.zeros(1 << (bits - piece), bool))[own] = True
        for r, flags in ranges.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["r", "flags"])

    out = np.zeros(size // 8, np.uint8)
    width = out.size >> piece
    key = F.col(column).cast("long")
    by_range = keys.select(key.alias("k")).repartition(1 << min(piece, 6), F.shiftrightunsigned("k", 64 - piece))
    for row in by_range.mapInArrow(mark, "r long, flags binary").collect():  # 16 MB at most
        out[row.r * width : (row.r + 1) * width] |= np.frombuffer(row.flags, np.uint8)
    return bits, out


def maybe_in(bitmap: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    bits, flags = bitmap
    at = keys >> np.uint64(64 - bits)
    return flags[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
