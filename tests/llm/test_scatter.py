"""Bitmaps and buckets of 64-bit keys, also without any."""

import numpy as np
import pyarrow as pa

from glossa.llm import scatter


def test_a_bitmap_has_every_key(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 12345, 12345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bitmap = scatter.bitmap_of(df, "k")
    own = np.array(keys, np.int64).view(np.uint64)
    assert scatter.maybe_in(bitmap, own).all()
    others = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    assert scatter.maybe_in(bitmap, others).mean() < 0.01


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k long")
    bitmap = scatter.bitmap_of(df, "k")
    assert not scatter.maybe_in(bitmap, np.array([0, 1, 2**64 - 1], np.uint64)).any() and not len(scatter.maybe_in(bitmap, np.zeros(0, np.uint64)))
    assert scatter.packed(4, np.zeros(0, np.uint64)) is None and scatter.bucket_bits(df) >= 1
    run = scatter.gathered((np.int64,), lambda *a: iter([a]))
    assert list(run(iter([]))) == []
    assert df.select("k").mapInArrow(lambda batches: (x for b in batches if (x := scatter.packed(4, b.column(0).to_numpy().view(np.uint64)))), scatter.schema(0)).count() == 0


def test_buckets_keep_keys_together():
    keys = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    keys = np.concatenate([keys, keys[:50]])
    batch = scatter.packed(3, keys, np.arange(len(keys)))
    seen = {}
    for bucket, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
        for key, i in zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist(), strict=True):
            assert keys[i] == key and seen.setdefault(key, bucket) == bucket == key >> 61
    assert isinstance(batch, pa.RecordBatch) and len(seen) == 300
