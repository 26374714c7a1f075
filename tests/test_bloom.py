import numpy as np
import pytest
from pyspark.sql import functions as F

from hrefsieve.operators import bloom


@pytest.mark.parametrize("n", [0, 1, 3_000, 40_000])
def test_keys_pass_and_others_hardly(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("https://h.com/"), "id").alias("url"))
    kept = bloom.key_filter(keys, n)
    assert keys.where(kept.might_hold(F.col("url"))).count() == n
    others = spark.range(50_000).select(F.concat(F.lit("https://o.com/"), "id").alias("url"))
    assert others.where(kept.might_hold(F.col("url"))).count() < 0.005 * 50_000


def test_a_filter_without_room_still_passes_its_keys(spark):
    keys = spark.range(100_000).select("id", (F.col("id") % 7).alias("k"))
    kept = bloom.key_filter(keys, 100_000, most=16)
    assert kept.bits == 16 and keys.where(kept.might_hold(F.col("id"), F.col("k"))).count() == 100_000


def test_full_filters_pass_one_foreign_key_in_a_thousand():
    rng = np.random.default_rng(1)
    bits = bloom.bits_for(60_000)
    n = (1 << bits) // bloom.KEY_BITS
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    first, step = (rng.integers(0, 1 << 48, n, dtype=np.uint64) for _ in range(2))
    for i in range(bloom.SLOTS):
        slot = ((first + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)
        np.bitwise_or.at(bitmap, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    assert bloom.all_set(bitmap, first, step, bits).all()
    foreign = bloom.all_set(bitmap, *(rng.integers(0, 1 << 48, 200_000, dtype=np.uint64) for _ in range(2)), bits)
    assert foreign.mean() < 0.0025
