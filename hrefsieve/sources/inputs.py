"""Input lists: one searched string per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.functions.text import strip
from hrefsieve.session import with_row_index

INPUT_SCHEMA = "input_id bigint, queried_url string"


def clean_inputs(lines: DataFrame, id_column: str = "input_id", text_column: str = "value") -> DataFrame:
    """Trim lines and drop blank ones; order and duplicates stay."""
    cleaned = lines.select(F.col(id_column).cast("bigint").alias("input_id"), strip(F.col(text_column)).alias("queried_url"))
    return cleaned.where(F.length("queried_url") > 0)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Read a list as plain lines. ``input_id`` numbers the lines in file order."""
    read = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered = with_row_index(read, [F.col("file"), F.col("block"), F.col("line")], "input_id")
    return clean_inputs(numbered)


def no_inputs(spark: SparkSession) -> DataFrame:
    """The empty list of a crawl-only run."""
    return spark.createDataFrame([], INPUT_SCHEMA)
