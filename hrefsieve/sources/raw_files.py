"""Landed bodies as files: one file for each fetched URL, and a table that tells what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.session import join_small

#: files that a task reads at most, in splits of Spark's: small files fill one by their number, 32 by default
SPLITS_PER_TASK = 16
#: and bytes, about
TASK_BYTES = 64 << 20
#: the table beside the files: file name, requested URL, and the answer without its body
SIDECAR_SCHEMA = "file string, url string, status int, headers map<string,string>"


def fewer_splits(files: DataFrame) -> DataFrame:
    """Small files, many to a task. Spark packs a few dozen into a split, however small they are.

    Splits are put together where they are, no body moves; splits of large files stay as they are.
    """
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = files.rdd.getNumPartitions()
    tasks = max(-(-splits // SPLITS_PER_TASK), -(-size // TASK_BYTES), 2 * files.sparkSession.sparkContext.defaultParallelism)
    return files.coalesce(tasks) if tasks < splits else files


def read_raw_files(spark: SparkSession, folder: str, sidecar: DataFrame, pattern: str = "*") -> DataFrame:
    """Raw documents (url, status, headers, body) from the files below a folder.

    Files are read whole, as bytes, and known by their name (the last part of the path).
    A file that the table doesn't name is left out, as is a row without a file; Spark reads
    no empty files, which hold no document anyway. While the table is small bodies don't shuffle; for more files than that, land bodies in a table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    bodies = fewer_splits(files).select(F.substring_index("path", "/", -1).alias("file"), F.col("content").alias("body"))
    return join_small(bodies, sidecar.select("file", "url", "status", "headers"), "file").select("url", "status", "headers", "body")
