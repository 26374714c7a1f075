"""Reading the tables, words of texts, and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.session import checkpoint_dir, cut, fits, scratch_path

__all__ = ["checkpoint_dir", "cut", "fits", "scratch_path", "table", "words_of", "GAP", "slices", "free_name", "small", "runs"]

#: what separates words: space, tab, line feed, vertical tab, form feed, carriage return
GAP = " \t\n\x0b\f\r"
GAP_PATTERN = "[\\x20\\x09-\\x0D]+"
#: texts are handed to Python code at most so many bytes at a time (and one text at least)
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text: its runs of anything but ``GAP``. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_PATTERN), "")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts are short together, so that Python copies stay small."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by some columns, as one table for each of their values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        start = 0
        for at in np.flatnonzero(change):
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


#: files of at most so many bytes are broadcast; unpacked they stay well below an executor's memory
SMALL_FILES = 8 << 20


def small(written: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are small; otherwise as it is.

    The size is that of the files, which Spark knows without a job.
    """
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(written) if size <= SMALL_FILES else written


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
