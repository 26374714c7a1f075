"""Which patterns occur in which texts: a containment join without a cross join.

Three strategies give the same rows:

``native``     all patterns as one literal array, tested by a built-in filter; for a
               handful of patterns, nothing leaves the JVM.
``automaton``  a measured, bounded pattern list is broadcast and every text is read
               once through an Aho-Corasick automaton. Texts never shuffle.
``windows``    pattern lists of any size. Every pattern is anchored on its rarest gram; a
               Bloom filter of bounded size holds anchors, where they lie in a pattern,
               how long it is, and whole patterns, each under several slots. It picks
               substrings of each text, and an equi-join with the pattern table decides.
               Texts never shuffle, only those substrings do. A list that would overfill
               the filter is searched in several passes, each for a share of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefsieve.operators.bloom import KEY_BITS, MIN_BITS, SLOTS, all_set, bitmap_of
from hrefsieve.session import cut, join_small

try:
    import ahocorasick
except ImportError:  # the window strategy needs no library
    ahocorasick = None

NATIVE_PATTERNS = 32
AUTOMATON_CHARS = 8_000_000  # at most some 400 MB per Python worker
GRAM = 6
#: largest filter of a pass, 64 MiB: room for 8 million patterns
MAX_BITS = 29
#: keys of a pattern: its anchor, with the place in the pattern, with place and length, the whole
KEYS = 4
#: grams are counted in so many slots, a megabyte or two, whatever the list
COUNT_BITS = 18
#: texts looked at to see which grams are common, and characters of each. They only choose anchors
SAMPLE_TEXTS, SAMPLE_CHARS = 256, 1 << 15
PIECE = 1 << 17  # bytes of text hashed at a time; the arrays for it stay in the cache
CELLS = 1 << 18  # places tested at a time

# Arithmetic modulo 2**64: an odd base has an inverse, so every window of a text gets
# its hash from one running sum.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


#: from texts, the columns to keep and the text's column: those columns and an array ``found``
Pass = Callable[[DataFrame, list[str], str], DataFrame]


class Matcher:
    """A prepared pattern list. Each of its ``passes`` reads every text once and gives an array
    of what may be patterns in it. ``settled`` turns rows (..., found) of all passes into
    rows (..., pattern)."""

    def __init__(self, passes: list[Pass], settle: Callable[[DataFrame], DataFrame] | None = None):
        self.passes, self._settle = passes, settle

    @property
    def exact(self) -> bool:
        """Are the arrays of a pass the patterns themselves?"""
        return self._settle is None

    def settled(self, rows: DataFrame) -> DataFrame:
        return self._settle(rows) if self._settle else rows.withColumnRenamed("found", "pattern")

    def __call__(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, pattern) for every pattern contained in a text."""
        found = [one(texts, [key], text).select(key, F.explode("found").alias("found")) for one in self.passes]
        return self.settled(reduce(DataFrame.unionByName, found))


def _searching(search: Callable[[pa.Array], pa.Array], item: T.DataType, text_type: str) -> Pass:
    """A pass by a function on batches of texts. As an operator of its own it runs once for each
    text, where a column function would run again to see which arrays are empty."""

    def one(texts: DataFrame, kept: list[str], text: str) -> DataFrame:
        rows = texts.select(*kept, F.col(text).cast(text_type).alias("_text"))
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("found", T.ArrayType(item))])
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], search(batch.column(len(names) - 1))], names=names)

        return rows.mapInArrow(run, schema)

    return one


def _collected(patterns: DataFrame) -> list[str]:
    return sorted(r[0] for r in patterns.select("pattern").distinct().collect())


def _native(patterns: list[str]) -> Matcher:
    listed = F.array(*[F.lit(p) for p in patterns]).cast("array<string>")
    return Matcher([lambda texts, kept, text: texts.select(*kept, F.filter(listed, lambda p: F.contains(F.col(text), p)).alias("found"))])


def _automaton(spark: SparkSession, patterns: list[str]) -> Matcher:
    if not patterns:
        return _native(patterns)
    shared = spark.sparkContext.broadcast({"patterns": patterns})

    def search(column: pa.Array) -> pa.Array:
        state = shared.value
        if "automaton" not in state:  # built once per Python worker
            built = ahocorasick.Automaton()
            for p in state["patterns"]:
                built.add_word(p, p)
            built.make_automaton()
            state["automaton"] = built
        walk = state["automaton"].iter
        found = [list({p for _, p in walk(t)}) if t else [] for t in column.to_pylist()]
        return pa.array(found, pa.list_(pa.string()))

    return Matcher([_searching(search, T.StringType(), "string")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of each byte, and those that move a window to the origin."""
    powers, inverse = np.full(n + 1, _BASE), np.full(n + 1, _BASE_INVERSE)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def _running_sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def _hashes(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``at``."""
    return _mixed((sums[at + length] - sums[at]) * inverse[at] + np.asarray(length, np.uint64))


def _key(kind: int, h: np.ndarray, offset: np.ndarray | int = 0, length: np.ndarray | int = 0) -> np.ndarray:
    """The keys of a pattern: kind 0 anchors, 1 with their offset, 2 and the length too, 3 whole patterns."""
    place = (np.asarray(offset, np.uint64) << np.uint64(32)) + np.asarray(length, np.uint64) + np.uint64(kind + 1) * _BASE
    return _mixed(h ^ _mixed(place))


def _step(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)) | np.uint64(1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and where each value starts, plus the end."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    values = column.buffers()[2]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), offsets


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Places, rows and hashes of all grams of a column, and the running sums. Shorter values are one gram."""
    data, offsets = _bytes_of(column)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    powers, inverse = _powers(len(data))
    sums = _running_sums(data, powers)
    lengths = np.diff(offsets)
    count = np.where(lengths >= GRAM, lengths - GRAM + 1, np.minimum(lengths, 1))
    rows = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[rows] + within
    return within, rows, _hashes(sums, inverse, at, np.minimum(lengths[rows], GRAM)), (sums, inverse, offsets, lengths)


def _count_slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _distinct_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots in which each value's distinct grams are counted, value after value, and how many each has."""
    _, rows, h, _ = _grams(column)
    found = np.unique((rows << COUNT_BITS) + _count_slot(h))
    return found & ((1 << COUNT_BITS) - 1), np.bincount(found >> COUNT_BITS, minlength=len(column))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _gram_slots(column: pa.Array) -> pa.Array:
    """The slots in which each value's distinct grams are counted."""
    slots, counts = _distinct_slots(column)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(slots.astype(np.int32)))


def _gram_counts(patterns: DataFrame, sample: DataFrame | None, text: str) -> np.ndarray:
    """How common the grams of each slot are: in some texts, if there are any, then among the patterns.

    At most ``2**COUNT_BITS`` counts are collected. The sample is the first texts at hand, a
    few megabytes of their beginnings; it decides where to look for a pattern, not what is
    found. They are counted on the driver: Spark can't run a Python function on a column made
    by a lambda, such as the links of a page.
    """
    slots = patterns.select(F.explode(_gram_slots.asNondeterministic()("raw")).alias("slot"))
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in slots.groupBy("slot").count().collect():
        counts[r["slot"]] = min(r["count"], (1 << 20) - 1)
    if sample is not None:
        start = F.substring(F.col(text).cast("binary"), 1, SAMPLE_CHARS)
        for r in sample.select(start.alias("start")).head(SAMPLE_TEXTS):
            found, _ = _distinct_slots(pa.array([r["start"]], pa.binary()))
            counts[found] += 1 << 20
    return counts


ANCHORED = "struct<offset: int, keys: array<bigint>>"


def _anchored(counts: Broadcast) -> Callable[[Column], Column]:
    """A function that gives the place of a pattern's rarest gram, the first of several, and the pattern's keys."""

    @F.arrow_udf(ANCHORED)
    def anchored(column: pa.Array) -> pa.Array:
        within, rows, h, (sums, inverse, offsets, lengths) = _grams(column)
        rank = (counts.value[_count_slot(h)] << 28) + np.minimum(within, (1 << 28) - 1)
        order = np.lexsort((rank, rows))
        first = order[np.searchsorted(rows[order], np.arange(len(lengths)))]  # patterns are not empty
        gram, offset = h[first], within[first]
        whole = _hashes(sums, inverse, offsets[:-1], lengths)
        keys = np.stack([_key(0, gram), _key(1, gram, offset), _key(2, gram, offset, lengths), _key(3, whole)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * KEYS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(offset, pa.int32()), lists], names=["offset", "keys"])

    return anchored.asNondeterministic()


def _slots_of(bits: int) -> Callable[[Column], Column]:
    """A function that gives the slots of keys in a filter."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def slots(column: pa.Array) -> pa.Array:
        keys = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        each = (keys[:, None] + np.arange(SLOTS, dtype=np.uint64) * _step(keys)[:, None]) & np.uint64((1 << bits) - 1)
        ends = np.arange(len(column) + 1) * KEYS * SLOTS
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each.ravel().view(np.int64)))

    return slots.asNondeterministic()


class _Filter:
    """What a pass looks for: the filter, and which offsets and lengths occur."""

    def __init__(self, bitmap: np.ndarray, bits: int, places: list[tuple[int, int]]):
        self.bitmap, self.bits = bitmap, bits
        self.longest = max(length for _, length in places)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {min(length, GRAM) for _, length in places}:
            mine = [(o, n) for o, n in places if min(n, GRAM) == width]
            self.by_width[width] = np.array(sorted({o for o, _ in mine})), np.array(sorted({n for _, n in mine}))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return all_set(self.bitmap, keys, _step(keys), self.bits)

    def _with(self, kind: int, values: np.ndarray, h: np.ndarray, offset: np.ndarray | None, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values, an offset or a length, for which a key is there and the text has room."""
        rows, found = [], []
        step = max(1, CELLS // len(values))
        for low in range(0, len(h), step):
            r, v = (x.ravel() for x in np.meshgrid(np.arange(low, min(low + step, len(h))), np.arange(len(values)), indexing="ij"))
            r, v = r[values[v] <= room[r]], values[v[values[v] <= room[r]]]
            good = self.holds(_key(kind, h[r], v if offset is None else offset[r], 0 if offset is None else v))
            rows.append(r[good])
            found.append(v[good])
        return np.concatenate(rows), np.concatenate(found)

    def substrings(self, data: np.ndarray, ends: np.ndarray, factors: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the substrings that may be patterns. ``ends`` are the text ends."""
        inverse = factors[1]
        sums = _running_sums(data, factors[0])
        sizes = np.diff(ends, prepend=0)
        after = np.repeat(ends, sizes) - np.arange(len(data))  # bytes left in the text
        before = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        starts, lengths = [], []
        for width, (offsets, sizes_of) in self.by_width.items():
            at = np.flatnonzero(after >= width)
            h = _hashes(sums, inverse, at, width)
            keep = self.holds(_key(0, h))
            at, h = at[keep], h[keep]
            if not len(at):
                continue
            row, offset = self._with(1, offsets, h, None, before[at])
            if not len(row):
                continue
            start, gram = at[row] - offset, h[row]
            row, length = self._with(2, sizes_of, gram, offset, after[start])
            start = start[row]
            if len(start):
                good = self.holds(_key(3, _hashes(sums, inverse, start, length)))
                starts.append(start[good])
                lengths.append(length[good])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *lengths])


def _pieces(offsets: np.ndarray, overlap: int):
    """Cut a batch of texts into stretches of bounded size: (first byte, text ends, first row).

    Short texts go together. A long text is cut with an overlap as long as any pattern.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        low = int(offsets[row])
        last = int(np.searchsorted(offsets, low + PIECE, "right")) - 1
        if last > row:
            yield low, offsets[row + 1:last + 1], row
            row = last
        else:
            high = int(offsets[row + 1])
            for start in range(low, high, PIECE):
                yield start, np.array([min(high, start + PIECE + overlap)]), row
            row += 1


def _candidates(column: pa.Array, wanted: _Filter) -> list[list[bytes]]:
    """Per text of a batch, its distinct substrings that pass the filter."""
    data, offsets = _bytes_of(column)
    found = [set() for _ in range(len(column))]
    factors = _powers(min(len(data), PIECE + wanted.longest))
    for low, ends, first_row in _pieces(offsets, wanted.longest):
        stretch = data[low:int(ends[-1])]
        if not len(stretch):
            continue
        inner = ends - low
        starts, lengths = wanted.substrings(stretch, inner, factors)
        rows = first_row + np.searchsorted(inner, starts, "right")
        for row, start, length in zip(rows.tolist(), starts.tolist(), lengths.tolist(), strict=True):
            found[row].add(stretch[start:start + length].tobytes())
    return [list(f) for f in found]


def _windows(patterns: DataFrame, most: int, sample: DataFrame | None, text: str) -> Matcher:
    spark = patterns.sparkSession
    listed = cut(patterns.select("pattern").distinct().select("pattern", F.col("pattern").cast("binary").alias("raw")), "patterns")
    n = listed.count()
    if n == 0:
        return _native([])
    counts = spark.sparkContext.broadcast(_gram_counts(listed, sample, text))
    shares = -(-n * KEYS * KEY_BITS >> most)
    table = listed.withColumn("a", _anchored(counts)("raw")).select("pattern", "raw", "a.offset", "a.keys", F.pmod(F.xxhash64("raw"), F.lit(shares)).cast("int").alias("share"))
    table = cut(table, "anchored")
    passes = []
    for share in range(shares):
        mine = table.where(F.col("share") == share)
        # distinct places: the longest pattern's length squared at most, mostly some thousands
        row = mine.agg(F.count("*").alias("n"), F.collect_set(F.struct("offset", F.octet_length("raw").alias("length"))).alias("places")).first()
        if not row["n"]:
            continue
        bits = min(most, max(MIN_BITS if most >= MIN_BITS else most, (KEYS * KEY_BITS * row["n"] - 1).bit_length()))
        bitmap = bitmap_of(mine.select(F.explode(_slots_of(bits)("keys")).alias("slot")), bits)
        passes.append(_searcher(spark.sparkContext.broadcast(_Filter(bitmap, bits, [(p["offset"], p["length"]) for p in row["places"]]))))

    def settle(rows: DataFrame) -> DataFrame:
        """Substrings that are patterns. One found in most texts is looked up once and joined without meeting in one task."""
        rows = cut(rows, "candidates")
        real = table.select("raw", "pattern").join(rows.select(F.col("found").alias("raw")).distinct(), "raw", "left_semi")
        return join_small(rows.withColumnRenamed("found", "raw"), real, "raw").drop("raw")

    return Matcher(passes, settle)


def _searcher(shared: Broadcast) -> Pass:
    return _searching(lambda column: pa.array(_candidates(column, shared.value), pa.list_(pa.binary())), T.BinaryType(), "binary")


def matcher(patterns: DataFrame, strategy: str = "auto", bits: int | None = None, sample: DataFrame | None = None, text: str = "html") -> Matcher:
    """Prepare a pattern list once, for one or many sets of texts.

    ``patterns`` has one column ``pattern`` of non-empty strings. For the window strategy,
    ``bits`` bounds a pass's filter (2**bits bits), and ``sample`` is a frame whose first
    texts (column ``text``) show which grams are common.
    """
    if strategy not in ("auto", "native", "automaton", "windows"):
        raise ValueError(f"unknown match strategy: {strategy}")
    if strategy != "windows":
        size = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars")).first()
        if strategy != "auto" and size["chars"] > AUTOMATON_CHARS:
            raise ValueError(f"the pattern list is too large for strategy {strategy}; use windows")
        if strategy == "auto" and size["chars"] > AUTOMATON_CHARS:
            strategy = "windows"
        elif strategy == "auto":
            few = size["n"] <= NATIVE_PATTERNS
            strategy = "native" if few else "windows" if ahocorasick is None else "automaton"
    if strategy == "windows":
        return _windows(patterns, bits or MAX_BITS, sample, text)
    listed = _collected(patterns)
    return _native(listed) if strategy == "native" else _automaton(patterns.sparkSession, listed)


def find_patterns(
    texts: DataFrame,
    patterns: DataFrame,
    strategy: str = "auto",
    key: str = "url",
    text: str = "blob",
    bits: int | None = None,
) -> DataFrame:
    """(key, pattern) for every pattern contained in a text, case-sensitive.

    A pattern counts once per row of ``texts``.
    """
    return matcher(patterns, strategy, bits, texts, text)(texts, key, text)
