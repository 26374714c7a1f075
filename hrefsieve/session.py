"""Checkpoint folder, size checks and row numbering shared by the stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20
BROADCAST_BYTES = 64 * MIB
HOT_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``, for all cut lineage.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hrefsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    """Is there such a folder, in whatever store it is?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete the folders that this process made so far. Call it once all outputs are written."""
    while _MADE:
        delete_folder(spark, _MADE.pop())


#: share of the driver's heap from which on garbage is collected between the steps of a job
HEAP_SHARE = 0.6


def release_unused(spark: SparkSession) -> None:
    """Let Spark drop the shuffles, broadcasts and plans that nothing refers to any more.

    It does so when the driver collects its garbage, which is put off while the heap can
    grow: a chain of many small jobs takes the driver to its limit, whatever the input.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to shared storage and go on from there.

    Lineage ends, a lost executor costs no recomputation, and later plans know the
    true size of the frame.
    """
    path = scratch_path(df.sparkSession, name)
    release_unused(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write a frame and return aggregates over it that are gathered by the write itself.

    ``n``, the number of rows, is always among them. They stand above everything else in
    the plan, in the tasks that write, so a repeated stage below counts nothing twice.
    """
    seen = Observation()
    df.observe(seen, F.count("*").alias("n"), *[c.alias(name) for name, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def cut_counted(df: DataFrame, name: str = "stage", **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates over the frame that cost no further job."""
    path = scratch_path(df.sparkSession, name)
    release_unused(df.sparkSession)
    counts = write_counted(df, path, **metrics)
    return df.sparkSession.read.schema(df.schema).parquet(path), counts


def text_bytes(df: DataFrame) -> Column:
    """Aggregate: size of the frame written as text."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64
    return F.coalesce(F.sum(width), F.lit(0))


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Is the frame, written as text, no larger than ``max_bytes``?"""
    return df.agg(text_bytes(df)).first()[0] <= max_bytes


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a side that is usually small, without shuffling the big one.

    The small side is written once, measured, and broadcast only if it fits. Otherwise
    both sides shuffle on the key, and only keys that fill many rows are spread.
    """
    small, size = cut_counted(small, "small", bytes=text_bytes(small))
    return big.join(F.broadcast(small), on, how) if size["bytes"] <= BROADCAST_BYTES else join_lookup(big, small, on, how)


def join_lookup(rows: DataFrame, lookup: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a lookup of one row per key, when a key may fill many of the rows.

    Keys with over ``HOT_ROWS`` rows are found first; at most one in ``HOT_ROWS`` rows
    can be such a key, so their list is broadcast. Only their lookup rows are repeated,
    one for each task the key is spread over.
    """
    counts = rows.groupBy(on).count().where(F.col("count") > HOT_ROWS)
    hot = F.broadcast(counts.select(on, F.ceil(F.col("count") / HOT_ROWS).cast("long").alias("_copies")))
    spread = rows.join(hot, on, "left").withColumn(
        "_copy", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_copies", F.lit(1).cast("long")))
    )
    repeated = lookup.join(hot, on, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1).cast("long")) - 1))
    )
    return spread.drop("_copies").join(repeated.drop("_copies"), [on, "_copy"], how).drop("_copy")


def with_row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, ... in the given order, each range of rows in its own task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return (
        placed.withColumn("_part", part.cast("int"))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_at")
    )


def first_rows(df: DataFrame, order: list[Column], n: int, small: int = 100_000) -> DataFrame:
    """The first ``n`` rows in an order. Large ``n`` never gathers them in one task."""
    if n <= small:
        return df.orderBy(*order).limit(n)
    return with_row_index(df, order, "_index").where(F.col("_index") < n).drop("_index")
