"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature holds ``INDEXED`` MinHash symbols of 16 bits, split into ``CHUNKS``.
If two signatures differ in fewer than ``CHUNKS * (ERRORS + 1)`` symbols, some chunk has at
most ``ERRORS`` differences (pigeonhole); so each chunk gives one key for every choice of
``ERRORS`` left-out symbols, and every pair within the distance shares a key. All of them
are confirmed on the full sets. A pair of similarity 0.8 exceeds the distance with a
probability near 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrefsieve.llm.components import components
from hrefsieve.llm.tables import cut, free_name, runs, slices, small

INDEXED, CHUNKS, ERRORS = 64, 15, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: keys of at least so many members are compared on their sets at once, in blocks of at
#: most about so many rows and shingles
HEAVY, BLOCK, BLOCK_SHINGLES = 64, 2048, 1 << 20
#: rounds of comparing a key's members with one of them, before all that is left
MASKS = (0, -1)
MEMO = 200_000


_BOUNDS = np.linspace(0, INDEXED, CHUNKS + 1).round().astype(int).tolist()
#: the symbols of each key: every chunk with every choice of left-out ones (at most 256 keys)
PROBES = [
    [i for i in range(lo, hi) if i not in out]
    for lo, hi in zip(_BOUNDS, _BOUNDS[1:], strict=False)
    for out in combinations(range(lo, hi), ERRORS)
]


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``width`` words, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the wanted alphabet and
    white space. A text with fewer words is one shingle; without words it has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        joined = np.array([len(h)], np.uint64)
        for x in h:
            joined = _mix(joined + x)
        return joined
    mixed = h[: len(h) - width + 1]
    for i in range(1, width):
        mixed = _mix(mixed) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(mixed))


_RANDOM = np.random.default_rng(20)
_FACTORS = (_RANDOM.integers(1, 1 << 32, INDEXED, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_OFFSETS = _RANDOM.integers(0, 1 << 32, INDEXED, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest hash under each hash function."""
    least = np.full(INDEXED, 0xFFFFFFFF, np.uint32)
    low = shingles.astype(np.uint32)
    for i in range(0, len(low), 512):
        y = low[None, i : i + 512] * _FACTORS + _OFFSETS
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        np.minimum(least, y.min(axis=1), out=least)
    return least.astype(np.uint16)


def _sketch(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            sizes, firsts, seconds, sigs = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width, memo)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                firsts.append(int.from_bytes(digest[:8], "little", signed=True))
                seconds.append(int.from_bytes(digest[8:], "little", signed=True))
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "c1", "c2", "sig"],
            )

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, INDEXED)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each signature; the lowest byte of a key tells which of ``PROBES`` it is."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            symbols, rep = _signatures(batch.column("sig")).astype(np.uint64), batch.column("rep")
            for probe, kept in enumerate(PROBES):
                h = np.full(len(symbols), probe + 1, np.uint64)
                for i in kept:
                    h = _mix((h << np.uint64(16)) + (h >> np.uint64(48)) + symbols[:, i])
                h = (h & ~np.uint64(0xFF)) | np.uint64(probe)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), rep], names=["key", "rep"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables are within the distance?"""
    return (a != b).sum(axis=1) <= DISTANCE


def _near(percent: int) -> Callable:
    """Pairs whose set sizes and signatures allow the wanted similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                n, m = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
                good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                good &= _close(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirm(width: int, percent: int) -> Callable:
    """Pairs whose full sets have the wanted similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sets = _Hashes(), {}

        def of(key: int, text: bytes) -> np.ndarray:
            found = sets.get(key)
            if found is None or found[0] != text:
                if len(sets) >= 64:
                    sets.clear()
                found = sets[key] = text, shingle_set(text, width, memo)
            return found[1]

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                good = []
                for a, b, ta, tb in zip(*(batch.column(x) for x in ("a", "b", "text_a", "text_b")), strict=True):
                    x, y = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _first_probe(differ: np.ndarray) -> np.ndarray:
    """The first key that two signatures share, from where their indexed symbols differ."""
    first = np.full(len(differ), len(PROBES))
    for k in reversed(range(len(PROBES))):
        first[~differ[:, PROBES[k]].any(axis=1)] = k
    return first


def _candidates(r: int, others: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, probe: int, percent: int) -> np.ndarray:
    """Which other rows of a key may be linked with row r? A pair is left to the first key that it shares."""
    others = others[(comp[others] != comp[r]) & (100 * np.minimum(n[others], n[r]) >= percent * np.maximum(n[others], n[r]))]
    if len(others):
        others = others[_close(sig[others], sig[r][None, :])]
    if len(others):
        others = others[_first_probe(sig[others] != sig[r][None, :]) == probe]
    return others


def _light_keys(percent: int) -> Callable:
    """Close pairs of different components among the members of a key with few members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key"]):
            rep, comp, n = (t.column(c).to_numpy() for c in ("rep", "comp", "n"))
            sig, probe = _signatures(t.column("sig").combine_chunks()), t.column("key")[0].as_py() & 0xFF
            for r in range(len(rep) - 1):
                others = _candidates(r, np.arange(r + 1, len(rep)), comp, n, sig, probe, percent)
                if len(others):
                    yield pa.RecordBatch.from_arrays([pa.array(f(rep[others], rep[r])) for f in (np.minimum, np.maximum)], names=["a", "b"])

    return run


def _heavy_keys(percent: int) -> Callable:
    """Links between components among the members of a key, confirmed on the sets.

    Shingles are numbered within a piece; marking those of one row and adding up the
    marks gives its overlap with all rows of the piece at once. Rows of the largest
    component need no turn of their own: every other row takes one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            rep, comp = (t.column(c).to_numpy().copy() for c in ("rep", "comp"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(n)])
            names, counts = np.unique(comp, return_counts=True)
            found: list[tuple[int, int]] = []
            mark = np.zeros(int(numbers.max()) + 1, np.int32)
            for r in np.flatnonzero(comp != names[np.argmax(counts)]):
                mine = numbers[starts[r] : starts[r + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[numbers], starts[:-1])
                mark[mine] = 0
                for k in np.flatnonzero(100 * both >= percent * (n + n[r] - both)):
                    if comp[k] != comp[r]:
                        comp[comp == comp[k]] = comp[r]
                        found.append((int(min(rep[k], rep[r])), int(max(rep[k], rep[r]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


class _Links:
    """Classes, their signatures and texts, the pairs tested, and the components that links make."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, first: DataFrame):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.tested: DataFrame | None = None
        self.labels = components(first)

    def confirm(self, pairs: DataFrame) -> None:
        """Joins components by those of some pairs (a < b) that are links. Pairs seen before are left out."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = small(cut(pairs, "pairs"))
        if pairs.isEmpty():
            return
        side = lambda x: self.classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        near = small(cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(self.percent), "a long, b long").distinct(), "near"))
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        if near.isEmpty():
            return
        ids = small(cut(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "ids"))
        texts = cut(self.docs.join(ids, "doc_id", "left_semi"), "texts")
        side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        links = near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm(self.width, self.percent), "a long, b long")
        self.add(cut(links, "links"))

    def add(self, links: DataFrame) -> None:
        """Joins components by confirmed links."""
        joined = components(self.label(self.label(links, "a", "ca"), "b", "cb"), "ca", "cb")
        joined = small(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")))
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        ends = ends.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        labels = self.labels.unionByName(ends).join(joined, "component", "left")
        self.labels = small(cut(labels.select("node", F.coalesce("joined", "component").alias("component")), "labels"))

    def label(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """Rows with the component of a node."""
        found = small(self.labels).select(F.col("node").alias(node), F.col("component").alias(name))
        return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that links of Jaccard similarity ``percent``/100 connect.

    1. One scan makes the set hash, size and signature of each text. Equal sets become
       one class, found by a map-side aggregate whatever the number of copies.
    2. Members of a key are compared with one of them, then with another one, so a large
       group of near copies costs a pair per member and round, not per pair.
    3. What still is in several components within a key is compared in full: keys of many
       members on their sets, in blocks of bounded size that give only new links; keys of
       few members by their close pairs. So no link between components is missed that
       the signature distance covers.

    Rows without a word are linked with nothing, nor are rows without doc_id. Rows that
    share a doc_id count as one document: what one is linked with, the others are too.
    Other columns are not read; an empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (is the
    row its component's smallest), one row for each row of ``docs``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketches = cut(docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, c1 long, c2 long, sig binary"), "sketches")
    linked = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = cut(linked.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    several = linked.groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo < hi").select("doc_id")
    same = linked.join(several, "doc_id").join(classes.select("c1", "c2", "rep"), ["c1", "c2"])
    same = same.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    state = _Links(docs.where("doc_id is not null"), classes, width, percent, cut(same, "links"))

    keys = cut(classes.select("rep", "sig").mapInArrow(_keys, "key long, rep long"), "keys")
    shared = cut(keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"), "shared")
    keys = cut(keys.join(small(shared), "key", "left_semi"), "keys")
    for turn, mask in enumerate(MASKS):
        mixed = F.col("rep").bitwiseXOR(F.lit(mask).cast("long"))
        members = keys
        if turn:
            members = cut(state.label(keys, "rep", "comp"), "members")
            mixed_keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            members = cut(members.join(small(cut(mixed_keys, "mixed")), "key", "left_semi"), "members")
        heads = cut(members.groupBy("key").agg(F.min(mixed).bitwiseXOR(F.lit(mask).cast("long")).alias("head")), "heads")
        pairs = members.join(small(heads), "key").where("rep != head")
        pairs = pairs.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
        if turn:
            pairs = state.label(state.label(pairs, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b")
        state.confirm(pairs)
    state.add(cut(_heavy(state, keys), "links"))
    state.confirm(_light(state, keys))

    found = state.label(classes.select("c1", "c2", "rep"), "rep", "component_id").select("c1", "c2", "component_id")
    rows = sketches.select("doc_id", "n_shingles", "c1", "c2").join(cut(found, "found"), ["c1", "c2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Of several rows under one doc_id one stays, whatever their texts: the one with the
    smallest text. Rows without doc_id stay. Texts don't shuffle while the ids that go
    are small, but for rows that share their id.
    """
    found = near_duplicates(docs, width, percent).where("doc_id is not null")
    fates = found.groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    fates = cut(fates.where("gone or n > 1"), "fates")
    gone, again = fates.where("gone").select("doc_id"), fates.where("n > 1").select("doc_id")
    left = docs.join(small(gone), "doc_id", "left_anti")
    once = left.join(small(again), "doc_id", "left_anti")
    if again.isEmpty():
        return once.select(*[F.col(f"`{c}`") for c in docs.columns])
    place = free_name(docs, "place")
    by = Window.partitionBy("doc_id").orderBy("text", *[F.col(f"`{c}`") for c, kind in docs.dtypes if "<" not in kind])
    first = left.join(small(again), "doc_id", "left_semi").withColumn(place, F.row_number().over(by)).where(F.col(place) == 1)
    return once.unionByName(first.drop(place)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            sets = [shingle_set(text.as_py(), width, memo).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _mixed(state: _Links, keys: DataFrame, of: str) -> DataFrame:
    """Members of the keys of a kind that several components share, with the key's size."""
    members = cut(state.label(keys, "rep", "comp"), "members")
    sizes = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    sizes = small(cut(sizes.where("lo < hi").where(of).select("key", "size"), "sizes"))
    return cut(members.join(sizes, "key"), "mixed")


def _classes(state: _Links) -> DataFrame:
    return state.classes.select("rep", F.col("n_shingles").alias("n"), "sig")


def _light(state: _Links, keys: DataFrame) -> DataFrame:
    """Close pairs of different components that share a key of few members."""
    rows = small(_mixed(state, keys, f"size < {HEAVY}")).join(_classes(state), "rep")
    return rows.drop("size").repartition("key").sortWithinPartitions("key").mapInArrow(_light_keys(state.percent), "a long, b long").distinct()


def _heavy(state: _Links, keys: DataFrame) -> DataFrame:
    """Links between components that share a key of many members: every block with every block."""
    members = small(_mixed(state, keys, f"size >= {HEAVY}"))
    nodes = small(cut(members.select(F.col("rep").alias("doc_id")).distinct(), "nodes"))
    sets = cut(state.docs.join(nodes, "doc_id", "left_semi").mapInArrow(_with_sets(state.width), "rep long, shingles binary"), "sets")
    sized = members.join(_classes(state).select("rep", "n"), "rep").groupBy("key").agg(F.sum("n").alias("shingles"))
    members = members.join(small(cut(sized, "sized")), "key")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    cells = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    rows = small(cut(cells, "cells")).join(sets, "rep")
    by = ["key", "i", "j"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(_heavy_keys(state.percent), "a long, b long").distinct()
