"""Line dedup: blocks that two documents have in common go from the later one.

Documents meet through hashes of short windows of lines, each later document with the
first holders of its windows, and are aligned on them with a patience diff. Aligned blocks
go from the later document. Alignment keeps one order and one use of a block; blocks that
cross it or repeat within a document are common all the same and go as well, which is told
apart in the result. All pairs of documents aligned whole (``common_blocks``) are what
this is tested against.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut, fits, free_name, runs, slices, words_of

#: words that a block needs to be deleted
BLOCK_WORDS = 5


#: modulus and factor of the keys of windows, a polynomial in the hashes of their lines
PRIME = (1 << 127) - 1
FACTOR = 0x5A8279996ED9EBA18F1BBCDCCA62C1D6
_POWERS = [1]


def windows(lines: list[bytes], least: int = BLOCK_WORDS) -> list[tuple[int, int, int]]:
    """(key, start, stop) of the shortest runs of at least ``least`` words from and up to each line.

    Equal runs have equal keys. Time and rows are linear in lines, whatever blank lines
    lie between words.
    """
    sums, hashes = [0], [0]
    for x in lines:
        sums.append(sums[-1] + len(x.split()))
        hashes.append((hashes[-1] * FACTOR + xxhash.xxh3_128_intdigest(x)) % PRIME)
    while len(_POWERS) < len(hashes):
        _POWERS.append(_POWERS[-1] * FACTOR % PRIME)
    places, start, stop = set(), 0, 0
    for i in range(len(lines)):
        while stop < len(lines) and sums[stop] - sums[i] < least:
            stop += 1
        if sums[stop] - sums[i] >= least:
            places.add((i, stop))
        while sums[i + 1] - sums[start + 1] >= least:
            start += 1
        if sums[i + 1] - sums[start] >= least:
            places.add((start, i + 1))
    return [((hashes[j] - hashes[i] * _POWERS[j - i]) % PRIME, i, j) for i, j in places]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text, one row for each."""
    for batch in slices(batches):
        at, keys, starts, stops = [], [], [], []
        for k, text in enumerate(batch.column("text")):
            found = windows(text.as_py().split(b"\n"))
            at += [k] * len(found)
            keys += [key.to_bytes(16, "big") for key, _, _ in found]
            starts += [i for _, i, _ in found]
            stops += [j for _, _, j in found]
        rows = batch.select(["doc_id", "version"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["doc_id", "version", "key", "start", "stop"])


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs (sorted by the first) whose second numbers increase."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, by patience diff.

    Equal ends are aligned, then items that are unique on both sides and keep their
    order; each gap between two of them is treated the same way.
    """
    aligned: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            aligned.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            aligned.append((hi, high))
        if lo == hi or low == high:
            continue
        left, right = Counter(a[lo:hi]), Counter(b[low:high])
        place = {x: j for j, x in enumerate(b[low:high], low) if right[x] == 1}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(a[lo:hi], lo) if left[x] == 1 and x in place])
        if not anchors:
            continue
        aligned.extend(anchors)
        at, at_b = lo, low
        for i, j in [*anchors, (hi, high)]:
            todo.append((at, i, at_b, j))
            at, at_b = i + 1, j + 1
    return sorted(aligned)


def common_blocks(earlier: list, later: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of the later document in aligned runs of at least ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least:
                out.extend(run)
            run = []
        run.append(j)
        last = (i, j)
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each later document, which of its lines go, and which of those by alignment.

    A document's windows come with the place of each in its first holder. With every such
    holder the windows are aligned in the order of both documents.
    """
    for t in runs(batches, ["doc_id", "version"]):
        keys = t.column("key").to_pylist()
        start, stop, holder, version, at = (t.column(c).to_numpy() for c in ("start", "stop", "e", "ev", "at"))
        masks = np.zeros((2, int(stop.max())), bool)
        for i, j in zip(start, stop, strict=True):
            masks[0, i:j] = True
        change = np.flatnonzero((holder[1:] != holder[:-1]) | (version[1:] != version[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(keys)], strict=True):
            there = dict(zip(keys[lo:hi], at[lo:hi].tolist(), strict=True))
            for _, k in patience(sorted(there, key=there.__getitem__), keys[lo:hi]):
                masks[1, start[lo + k] : stop[lo + k]] = True
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id").combine_chunks()[:1], t.column("version").combine_chunks()[:1], *[pa.array([m.tolist()], pa.list_(pa.bool_())) for m in masks]],
            names=["doc_id", "version", "mask", "aligned"],
        )


def common_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, mask, aligned) of the documents that lose lines.

    A line goes if it lies in a block, that is consecutive lines of ``BLOCK_WORDS`` words
    or more together, that an earlier document holds too. Documents meet at windows, the
    shortest such runs from and up to each line: every line of a common block lies in a
    window within the block. A window's later holders meet its first holder, so pairs are
    linear in windows however many documents hold one. Each later document is aligned with
    those holders, in one task that holds its own windows. ``mask`` has all lines that go:
    those of aligned blocks (``aligned``), and those of blocks that the alignment crosses
    or that repeat, which alone would align. So whatever any alignment of any two documents
    (``common_blocks``) deletes is deleted. The first holder of a window keeps it.
    """
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text"))
    windows = cut(keyed.mapInArrow(_windows, "doc_id long, version long, key binary, start int, stop int"), "windows")
    holder = F.struct("doc_id", "version")
    firsts = windows.groupBy("key").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.max(holder).alias("last"))
    firsts = firsts.where("first.doc_id < last.doc_id or first.version < last.version")
    firsts = cut(firsts.select("key", F.col("first.doc_id").alias("e"), F.col("first.version").alias("ev"), F.col("first.start").alias("at")), "firsts")
    later = windows.join(firsts, "key").where("doc_id != e or version != ev")
    by = ["doc_id", "version"]
    rows = later.repartition(*by).sortWithinPartitions(*by, "e", "ev", "start")
    return cut(rows.mapInArrow(_aligned, "doc_id long, version long, mask array<boolean>, aligned array<boolean>"), "masks")


def without_common_lines(docs: DataFrame, removed: str | None = None, by_alignment: str | None = None) -> DataFrame:
    """The rows of ``docs``, their text without the lines that earlier documents hold.

    Earlier means a smaller doc_id (of rows with one doc_id, a smaller hash of the text;
    equal rows don't lose lines to each other). Rows without doc_id or text and texts
    without common lines stay as they are. A document may lose all its lines and then
    has an empty text; its row stays. ``removed`` names a new column with the number of
    words deleted, ``by_alignment`` one with those in aligned blocks. Texts don't shuffle while the list of deletions fits in a broadcast.
    """
    masks = common_lines(docs)
    doc, version, mask, aligned = (free_name(docs, f"_dedup_{x}") for x in ("doc", "version", "mask", "aligned"))
    masks = masks.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("mask").alias(mask), F.col("aligned").alias(aligned))
    masks = F.broadcast(masks) if fits(masks) else masks
    joined = docs.join(masks, (docs["doc_id"] == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(version)), "left")
    lines = F.split("text", "\n", -1)
    marked = lambda which: lambda _, i: F.coalesce(F.get(F.col(which), i), F.lit(False))
    kept = F.filter(lines, lambda x, i: ~marked(mask)(x, i))
    text = F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    for name, which in ((removed, mask), (by_alignment, aligned)):
        if name:
            gone = F.size(words_of(F.array_join(F.filter(lines, marked(which)), "\n"))).cast("long")
            columns.append(F.when(F.col(mask).isNull(), F.lit(0).cast("long")).otherwise(gone).alias(name))
    return joined.select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines before, words deleted, those of them in aligned blocks, and the text that is left, of every row."""
    before = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    rows = without_common_lines(docs.select("doc_id", "text", before.alias("n_lines")), "n_removed_words", "n_aligned_words")
    return rows.select("doc_id", "n_lines", "n_removed_words", "n_aligned_words", "text")
