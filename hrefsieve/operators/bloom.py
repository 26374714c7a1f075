"""Bloom filters of keys: built by map-side bitmap aggregates, tested on Arrow batches.

A filter never turns away a key it was built from. Others pass at a small rate, so
whatever passes still meets the exact join; the filter only keeps the rest away from what
is costly: a parser, a shuffle of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = 32_768  # bits per bitmap_construct_agg value
#: slots of a key, and bits for each key; a full filter passes one foreign key in a thousand
SLOTS, KEY_BITS = 6, 16
#: size of a filter: 8 KiB to 128 MiB. Beyond 67 million keys more foreign ones pass
MIN_BITS, MAX_BITS = 16, 30
#: hashes are cut to so many bits, so that adding up slots can't overflow in SQL
_PART = (1 << 48) - 1


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """Size of a filter, as a power of two, for a number of keys."""
    return min(most, max(MIN_BITS, (KEY_BITS * max(keys, 1) - 1).bit_length()))


def bitmap_of(slots: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of 2**bits bits with every ``slot`` (long) of a frame set.

    Tasks set bits of their own rows first, 4 KiB for each range of slots that they meet;
    only those pieces are merged and collected, 2**bits bits at most whatever the rows.
    """
    parts = slots.groupBy((F.col("slot") / BUCKET).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bitmap"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():
        at = row["bucket"] * (BUCKET // 8)
        part = np.frombuffer(bytes(row["bitmap"]), np.uint8)[: len(out) - at]
        out[at:at + len(part)] = part
    return out


def all_set(bitmap: np.ndarray, first: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """Which keys have all their slots set? Slots after the first are looked up for the rest only."""
    left = np.arange(len(first))
    mask = np.uint64((1 << bits) - 1)
    for i in range(SLOTS):
        slot = ((first[left] + np.uint64(i) * step[left]) & mask).astype(np.int64)
        left = left[(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
    out = np.zeros(len(first), bool)
    out[left] = True
    return out


def _hashes(*columns: Column) -> tuple[Column, Column]:
    part = F.lit(_PART)
    return F.xxhash64(*columns).bitwiseAND(part), F.xxhash64(*columns, F.lit(1)).bitwiseAND(part).bitwiseOR(F.lit(1).cast("long"))


@dataclass
class KeyFilter:
    """A filter of keys, broadcast: 128 MiB at most."""

    shared: Broadcast
    bits: int

    def might_hold(self, *columns: Column) -> Column:
        """False only for keys that the filter was not built from. Only two hashes of a key leave the JVM."""
        shared, bits = self.shared, self.bits

        @F.arrow_udf(T.BooleanType())
        def test(first: pa.Array, step: pa.Array) -> pa.Array:
            a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (first, step))
            return pa.array(all_set(shared.value, a, b, bits))

        return test(*_hashes(*columns))


def key_filter(keys: DataFrame, n: int, most: int = MAX_BITS) -> KeyFilter:
    """A filter of the rows of a frame, of which there are about ``n``. Its columns are the key, in order."""
    bits = bits_for(n, most)
    first, step = _hashes(*[F.col(f"`{c}`") for c in keys.columns])
    hashed = keys.select(first.alias("first"), step.alias("step"))
    slot = F.explode(F.array(*[(F.col("first") + F.col("step") * i).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for i in range(SLOTS)]))
    return KeyFilter(keys.sparkSession.sparkContext.broadcast(bitmap_of(hashed.select(slot.alias("slot")), bits)), bits)
