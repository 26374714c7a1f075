"""N-gram Jaccard join by partitioning the universe of tokens, with one-deletion neighbourhoods.

Two sets of sizes s and l reach a similarity only if they differ in at most H of their
tokens, H from s + l. The hash range is cut into H + 1 cells, so two such sets agree
somewhere (pigeonhole). H depends on the sizes, hence *windows*: the sizes fall into bands
so that partners are of one band or of two neighbours, and each pair of neighbours has its
own cells.

Cells come in pairs, and each pair either gives two exact keys, the subset of each cell,
or one segment with its one-deletion neighbourhood: the merged subset, and that without
any one of its tokens. Both spend the same share of the H differences, so any choice finds
every pair. The choice goes by cost: exact keys are few, but where many unlike sets share
them the neighbourhood, with fewer candidates, is cheaper. Where the number of cells leaves
one to spare, the window's costliest cell is skipped.

Candidates are turned away by parity sketches, whose distance never exceeds that of the
sets, and what is left is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.components import components
from hrefsieve.llm.near_dedup import _Hashes, _mix, shingle_set
from hrefsieve.llm.tables import cut, runs, slices, small
from hrefsieve.operators.bloom import key_filter

WIDTH, PERCENT = 3, 90
#: a key holds its window (10 bits), its cell (12 bits) and a hash (42 bits)
WINDOW_AT, CELL_AT, WINDOWS, CELLS = 54, 42, 1 << 10, 1 << 12
#: roles of a key's member: its set is of the window's lower band, it is a whole subset.
#: Two members are candidates if both hold of one of them at least
LOWER, WHOLE = 1, 2
#: bits of a parity sketch for each difference that sets of this size may have
SKETCH_BITS = 32
#: how many key rows cost as much as one candidate pair
PAIR_COST = 0.05
#: keys are compared in blocks of about so many members
BLOCK = 2048


def bands(percent: int) -> np.ndarray:
    """The smallest size of each band: a set's partners are no larger than the next band."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows)


def most_differences(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Tokens in one set only that two sets of ``total`` tokens may have."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def cells_of(window: int, percent: int) -> int:
    """How many cells a window has: one, or an even number above its differences."""
    high = int(bands(percent)[window + 1]) - 1
    allowed = most_differences(high + high * 100 // percent, percent)
    return 1 if allowed == 0 else allowed + 1 + (allowed + 1) % 2


def spare(window: int, percent: int) -> bool:
    """Has a window one cell more than it needs?"""
    high = int(bands(percent)[window + 1]) - 1
    return cells_of(window, percent) > most_differences(high + high * 100 // percent, percent) + 1


@lru_cache(maxsize=256)
def _limits(count: int) -> np.ndarray:
    return np.array([(i << 64) // count for i in range(1, count)], np.uint64)


def _bounds(tokens: np.ndarray, count: int) -> np.ndarray:
    """Where each cell begins in sorted tokens, and the end."""
    inner = np.searchsorted(tokens, _limits(count))
    return np.concatenate([[0], inner, [len(tokens)]])


def _running(tokens: np.ndarray) -> np.ndarray:
    """Running sums, modulo 2**64, of remixed tokens: a subset's hash is a difference of two."""
    return np.concatenate([[np.uint64(0)], np.cumsum(_mix(tokens ^ np.uint64(0x5BF03635)), dtype=np.uint64)])


def _key(sums: np.ndarray, window: int, cells: np.ndarray, salt: int) -> np.ndarray:
    place = np.uint64(window << 24) + cells.astype(np.uint64) + np.uint64(salt << 56)
    h = _mix(sums + _mix(place))
    front = np.uint64((window % WINDOWS) << WINDOW_AT) | ((cells % CELLS).astype(np.uint64) << np.uint64(CELL_AT))
    return (front | (h >> np.uint64(64 - CELL_AT))).view(np.int64)


def exact_keys(tokens: np.ndarray, sums: np.ndarray, window: int, percent: int) -> np.ndarray:
    """A key for the subset in each cell of a window. A window of equal sets only has none: those are one class."""
    count = cells_of(window, percent)
    if count == 1:
        return np.empty(0, np.int64)
    at = _bounds(tokens, count)
    return _key(sums[at[1:]] - sums[at[:-1]], window, np.arange(count), 1)


def deletion_keys(tokens: np.ndarray, sums: np.ndarray, window: int, percent: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the merged subset of each chosen pair of cells, and of that without each one token.

    ``chosen`` marks pairs of cells by their number modulo half of ``CELLS``.
    """
    count = cells_of(window, percent)
    at = _bounds(tokens, count)[::2]
    pairs = np.flatnonzero(chosen[np.arange(count // 2) % len(chosen)])
    whole = sums[at[pairs + 1]] - sums[at[pairs]]
    lengths = at[pairs + 1] - at[pairs]
    of = np.repeat(np.arange(len(pairs)), lengths)
    token = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(at[pairs], lengths)
    less = whole[of] - (sums[token + 1] - sums[token])
    return _key(whole, window, 2 * pairs, 2), _key(less, window, 2 * pairs[of], 2)


def sketch(tokens: np.ndarray, percent: int) -> bytes:
    """Parities of how many tokens fall on each bit. Sets that differ in d tokens differ in at most d bits."""
    bits = 64
    while bits < SKETCH_BITS * (most_differences(2 * len(tokens), percent) + 1):
        bits *= 2
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest one."""
    words = min(len(s) for s in sketches) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0) for s in sketches])


def _sets(width: int, percent: int) -> Callable:
    """Size, digest, sketch and exact keys of each text, as the lower and as the upper band of a window."""
    lows = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, none = _Hashes(), np.empty(0, np.int64)
        for batch in slices(batches):
            sizes, firsts, seconds, sketches, keys = [], [], [], [], ([], [])
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width, memo)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                firsts.append(int.from_bytes(digest[:8], "little", signed=True))
                seconds.append(int.from_bytes(digest[8:], "little", signed=True))
                sketches.append(sketch(s, percent))
                band = int(np.searchsorted(lows, len(s), "right")) - 1
                sums = _running(s)
                keys[0].append(exact_keys(s, sums, band, percent) if band >= 0 else none)
                keys[1].append(exact_keys(s, sums, band - 1, percent) if band > 0 else none)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in side])]), pa.int32()), pa.array(np.concatenate([none, *side]))) for side in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sketches, pa.binary()), *lists],
                names=["doc_id", "n", "c1", "c2", "sketch", "lower", "upper"],
            )

    return run


def _with_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            sets = [shingle_set(text.as_py(), width, memo).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _neighbourhoods(width: int, percent: int, chosen: dict[int, np.ndarray]) -> Callable:
    """Deletion keys of each text in the windows that have some."""
    lows = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in slices(batches):
            for rep, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                s = shingle_set(text.as_py(), width, memo)
                band = int(np.searchsorted(lows, len(s), "right")) - 1
                sums = _running(s)
                for window, lower in ((band, LOWER), (band - 1, 0)):
                    if window % WINDOWS not in chosen or window < 0 or cells_of(window, percent) == 1:
                        continue
                    whole, less = deletion_keys(s, sums, window, percent, chosen[window % WINDOWS])
                    keys = np.concatenate([whole, less])
                    roles = np.repeat([lower | WHOLE, lower], [len(whole), len(less)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), rep.as_py())), pa.array(roles)], names=["key", "rep", "role"])

    return run


def _possible(n: np.ndarray, m: int | np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Do sizes and sketch distance allow the similarity?"""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= most_differences(n + m, percent))


def _near(percent: int) -> Callable:
    """Pairs whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                apart = [int(np.bitwise_count(np.bitwise_xor(*_folded([a, b]))).sum()) for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(_possible(n, m, np.array(apart, np.int64), percent)))

    return run


def _verified(percent: int) -> Callable:
    """Pairs whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, good = whole.slice(start, 256), []
                for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _left(percent: int) -> Callable:
    """Members of a block that have a possible partner of another component in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            comp, role, n = (t.column(c).to_numpy() for c in ("comp", "role", "n"))
            words = _folded(t.column("sketch").to_pylist())
            flagged = np.zeros(len(comp), bool)
            names, counts = np.unique(comp, return_counts=True)
            for r in np.flatnonzero(comp != names[np.argmax(counts)]):
                others = np.flatnonzero((comp != comp[r]) & ((role | role[r]) == LOWER | WHOLE))
                if len(others):
                    apart = np.bitwise_count(words[others] ^ words[r]).sum(axis=1, dtype=np.int64)
                    others = others[_possible(n[others], n[r], apart, percent)]
                    flagged[others] = True
                    flagged[r] |= len(others) > 0
            if flagged.any():
                for part in t.select(["key", "i", "j", "rep", "comp"]).filter(pa.array(flagged)).combine_chunks().to_batches():
                    yield part

    return run


def _linked(percent: int) -> Callable:
    """Links between components among the members of a block, on the full sets.

    Tokens are numbered within the block; marking those of one member and adding up the
    marks gives its overlap with all others at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            rep, comp = (t.column(c).to_numpy().copy() for c in ("rep", "comp"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
            starts = np.concatenate([[0], np.cumsum(n)])
            mark, found = np.zeros(int(numbers.max()) + 1, np.int32), []
            for r in range(len(rep)):
                mine = numbers[starts[r] : starts[r + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[numbers], starts[:-1])
                mark[mine] = 0
                for k in np.flatnonzero((comp != comp[r]) & (100 * both >= percent * (n + n[r] - both))):
                    if comp[k] != comp[r]:
                        comp[comp == comp[k]] = comp[r]
                        found.append((int(min(rep[k], rep[r])), int(max(rep[k], rep[r]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _window(key: Column) -> Column:
    return F.shiftrightunsigned(key, WINDOW_AT).cast("int")


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, CELL_AT).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that join different members, written, with the number of members."""
    grouped = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_or("role").alias("role"), F.count("*").alias("n"))
    return cut(grouped.where(f"lo < hi and role = {LOWER | WHOLE}").select("key", "n"), "shared")


def _members(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of shared keys, written. A list of keys too large to broadcast first meets a Bloom filter, so that most rows never shuffle."""
    listed = shared.select("key")
    if small(listed) is listed:
        keys = keys.where(key_filter(listed, listed.count()).might_hold(F.col("key")))
    return cut(keys.join(small(listed), "key", "left_semi"), "members")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of a written list of ``id``. If it is too large to broadcast, only those that a Bloom filter lets pass shuffle."""
    if small(ids) is ids:
        docs = docs.where(key_filter(ids, ids.count()).might_hold(F.col("doc_id")))
    return docs.join(small(ids), F.col("doc_id") == F.col("id"), "left_semi")


class _Groups:
    """Components of classes as links come in."""

    def __init__(self, links: DataFrame):
        self.labels = small(components(links))

    def label(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """Rows with the component of a node."""
        found = self.labels.select(F.col("node").alias(node), F.col("component").alias(name))
        return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    def add(self, links: DataFrame) -> None:
        joined = components(self.label(self.label(links, "a", "ca"), "b", "cb"), "ca", "cb")
        joined = small(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")))
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        ends = ends.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        labels = self.labels.unionByName(ends).join(joined, "component", "left")
        self.labels = small(cut(labels.select("node", F.coalesce("joined", "component").alias("component")), "labels"))


class _Join:
    """The classes of equal sets, where their texts are, and the tests on candidates."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rep, shingles) of some ids, written."""
        texts = _texts(self.docs, cut(ids.distinct(), "ids"))
        return cut(texts.mapInArrow(_with_sets(self.width), "rep long, shingles binary"), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a < b) whose sizes, sketches and then sets have the similarity. Written."""
        side = lambda x: self.classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        pairs = small(cut(pairs, "pairs"))
        near = small(cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(self.percent), "a long, b long"), "near"))
        sets = self.sets(near.select(F.col("a").alias("id")).union(near.select("b")))
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}"))
        return cut(near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(self.percent), "a long, b long"), "links")

    def remaining(self, members: DataFrame) -> DataFrame:
        """All further links between components within a key, block by block. Written."""
        sizes = members.groupBy("key").agg(F.count("*").alias("size"))
        members = members.join(small(cut(sizes.where("size > 1"), "sizes")), "key")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        spread = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        spread = cut(spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "comp", "role"), "blocks")
        by = ["key", "i", "j"]
        rows = small(spread).join(self.classes.select("rep", "n", "sketch"), "rep")
        rows = rows.repartition(*by).sortWithinPartitions(*by)
        left = cut(rows.mapInArrow(_left(self.percent), "key long, i int, j int, rep long, comp long"), "left")
        rows = small(left).join(self.sets(left.select(F.col("rep").alias("id"))), "rep").repartition(*by).sortWithinPartitions(*by)
        return cut(rows.mapInArrow(_linked(self.percent), "a long, b long").distinct(), "links")


def allocation(shared: DataFrame, sizes: DataFrame, percent: int, pair_cost: float = PAIR_COST) -> tuple[dict[int, np.ndarray], set[tuple[int, int]]]:
    """Which pairs of cells of a window take deletion keys, and which cell of a window is skipped.

    ``shared`` has the members of each exact key, ``sizes`` the classes of each size. A
    pair of cells takes deletions if testing the candidates of its exact keys costs more
    than the rows of the neighbourhood; one row for each such pair and window comes to the
    driver, ``WINDOWS * CELLS / 2`` at most.
    """
    lows = bands(percent)
    in_band = {b: 0 for b in range(-1, len(lows))}
    for r in sizes.groupBy("band").agg(F.sum("classes").alias("classes")).collect():
        in_band[r["band"]] = r["classes"]
    rows: dict[int, float] = {}
    for window in range(len(lows) - 1):
        classes = in_band[window] + in_band[window + 1]
        if classes and cells_of(window, percent) > 1:
            tokens = 2 * int(lows[window + 1]) / cells_of(window, percent)
            rows[window % WINDOWS] = rows.get(window % WINDOWS, 0) + classes * max(1.0, tokens - 1)
    if not rows:
        return {}, set()
    costs = shared.groupBy(_window(F.col("key")).alias("window"), _cell(F.col("key")).alias("cell")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    costs = cut(costs, "costs")
    bound = F.try_element_at(F.create_map(*[F.lit(x) for w, r in sorted(rows.items()) for x in (w, float(r))]), F.col("window"))
    pairs = costs.groupBy("window", F.floor(F.col("cell") / 2).cast("int").alias("pair")).agg(F.sum("pairs").alias("pairs"))
    chosen: dict[int, np.ndarray] = {}
    for r in pairs.where(F.col("pairs") * pair_cost > bound).collect():
        chosen.setdefault(r["window"], np.zeros(CELLS // 2, bool))[r["pair"]] = True
    spares = [w for w in range(len(lows) - 1) if spare(w, percent) and cells_of(w, percent) <= CELLS and len(lows) <= WINDOWS]
    worst = costs.where(F.col("window").isin(spares)).groupBy("window").agg(F.max_by("cell", F.struct("pairs", "cell")).alias("cell")).collect()
    skipped = {(r["window"], r["cell"]) for r in worst if not chosen.get(r["window"], np.zeros(CELLS // 2, bool))[r["cell"] // 2]}
    return chosen, skipped


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, pair_cost: float = PAIR_COST) -> DataFrame:
    """Groups of documents that links of Jaccard similarity ``percent``/100 of their shingles connect.

    1. One scan makes set digest, size, sketch and exact keys of each text. Equal sets are
       one class, found by a map-side aggregate whatever the number of copies.
    2. Members of shared keys tell what each pair of cells costs (``allocation``); where
       deletions are cheaper, the texts of those windows are read for their keys.
    3. Members of a key meet the key's smallest one, then what is left of several
       components meets the largest: one pair for each class and round.
    4. Members of keys that still hold several components are compared in full, in blocks
       on sketches that stay in a task; those with a possible partner are compared on
       their sets. So no link between different sets is missed.

    Tokens are 64-bit hashes of shingles. Rows without a word are linked with nothing, nor
    are rows without doc_id. Rows that share a doc_id count as one document: what one is
    linked with, the others are too. Other columns are not read; an empty table gives no
    rows.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), one row for each
    row of ``docs``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n long, c1 long, c2 long, sketch binary, lower array<long>, upper array<long>"
    sets = cut(docs.mapInArrow(_sets(width, percent), schema).withColumn("at", F.monotonically_increasing_id()), "sets")
    linked = sets.where("n > 0 and doc_id is not null")
    head = F.min(F.struct("doc_id", "at"))
    copies = linked.groupBy("c1", "c2").agg(head.alias("head"), F.count("*").alias("copies")).where("copies > 1")
    copies = small(cut(copies.select("c1", "c2", F.col("head.doc_id").alias("head"), F.col("head.at").alias("head_at")), "copies"))
    marked = linked.join(copies, ["c1", "c2"], "left")
    classes = marked.where("head is null or at = head_at").select(F.col("doc_id").alias("rep"), "n", "sketch", "lower", "upper")
    classes = cut(classes, "classes")
    several = linked.groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo < hi").select("doc_id")
    again = marked.select("doc_id", "head").where("head is not null and doc_id != head").join(several, "doc_id", "left_semi")
    groups = _Groups(cut(again.select(F.col("head").alias("a"), F.col("doc_id").alias("b")), "same"))
    state = _Join(docs.where("doc_id is not null"), classes, width, percent)

    side = lambda c, role: classes.select(F.explode(c).alias("key"), "rep", F.lit(role | WHOLE).alias("role"))
    keys = side("lower", LOWER).unionByName(side("upper", 0))
    shared = _shared(keys)
    lows = bands(percent).tolist()
    band = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= F.col("n"))) - 1
    sizes = classes.groupBy("n").agg(F.count("*").alias("classes")).withColumn("band", band)
    chosen, skipped = allocation(shared, sizes, percent, pair_cost)
    members = [_members(keys, _kept(shared, chosen, skipped))]
    if chosen:
        windows = [w for w in range(len(lows) - 1) if w % WINDOWS in chosen]
        there = F.array_contains(F.array(*[F.lit(w) for w in sorted({*windows, *(w + 1 for w in windows)})]), band)
        texts = _texts(state.docs, cut(classes.where(there).select(F.col("rep").alias("id")), "reps"))
        more = cut(texts.mapInArrow(_neighbourhoods(width, percent, chosen), "key long, rep long, role int"), "neighbourhoods")
        members.append(_members(more, _shared(more)))
    keys = members[0] if len(members) == 1 else members[0].unionByName(members[1])

    for least in (True, False):
        named = groups.label(keys, "rep", "comp")
        mixed = cut(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
        open_keys = keys.join(small(mixed), "key", "left_semi")
        both = F.when(F.col("role") == (LOWER | WHOLE), F.col("rep"))
        heads = cut(open_keys.groupBy("key").agg((F.min(both) if least else F.max(both)).alias("head")).where("head is not null"), "heads")
        met = open_keys.join(small(heads), "key").where("rep != head").groupBy("rep", "head").agg(F.count("*").alias("n"))
        met = groups.label(groups.label(met, "rep", "ca"), "head", "cb").where("ca != cb")
        best = met.groupBy("rep").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
        pairs = best.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
        groups.add(state.confirmed(pairs))
    named = cut(groups.label(keys, "rep", "comp"), "named")
    mixed = cut(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
    groups.add(state.remaining(cut(named.join(small(mixed), "key", "left_semi"), "left")))

    row = sets.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(copies.drop("head_at"), ["c1", "c2"], "left")
    row = row.withColumn("node", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")))
    labels = groups.labels.select("node", F.col("component").alias("component_id"))
    return row.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "node", "doc_id").alias("component_id"))


def _kept(shared: DataFrame, chosen: dict[int, np.ndarray], skipped: set[tuple[int, int]]) -> DataFrame:
    """Shared exact keys without those of cells that are skipped or take deletions."""
    gone = {(w, c) for w, marks in chosen.items() for p in np.flatnonzero(marks).tolist() for c in (2 * p, 2 * p + 1)} | skipped
    if not gone:
        return shared
    listed = shared.sparkSession.createDataFrame(sorted(gone), "window int, cell int")
    named = shared.withColumn("window", _window(F.col("key"))).withColumn("cell", _cell(F.col("key")))
    return cut(named.join(F.broadcast(listed), ["window", "cell"], "left_anti").select("key", "n"), "kept")
