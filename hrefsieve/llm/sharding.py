"""Contiguous shards of equal bytes from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut

SHARDS = 8


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text and one for its end. A null text has none but the end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows in order of ``doc_id``, cut into ``shards`` runs of equal bytes.

    Texts are read once, for their size and checksum; only those numbers are sorted.
    Range partitions keep their own running sums, and what lies before a partition comes
    from one total per partition, so no task sees more than its range. A row goes to the
    shard that holds its middle byte, so a shard misses its target by a row at most.

    Nulls first, ties by checksum, then by place in the input (equal rows are alike, so
    it doesn't matter which comes first; a third of all rows may share an id). A null
    text is empty. With fewer rows than shards some stay empty. An empty table gives no
    rows. Other columns are not read.

    Returns doc_id, size, text_crc32, shard, slot (from 0 in each shard).
    """
    text = F.col("text")
    sized = cut(docs.select(
        "doc_id",
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    ), "sizes")
    order = ["doc_id", "text_crc32", "at"]
    ranged = cut(
        sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()
    starts, before, index = [], 0, 0
    for t in totals:  # one entry per partition
        starts.append((t["part"], before, index))
        before, index = before + t["bytes"], index + t["n"]
    total = max(before, 1)
    offsets = docs.sparkSession.createDataFrame(starts, "part int, bytes_before long, rows_before long")
    running = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(running))
        .join(F.broadcast(offsets), "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"least(({shards}L * middle) div {2 * total}L, {shards - 1}L)").cast("int"))
        .withColumn("index", F.col("rows_before") + F.col("nth") - 1)
    )
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("index").alias("first")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, first.get(s, 0))]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("index") - start).cast("long").alias("slot"))
