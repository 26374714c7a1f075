"""Landed documents: what a fetcher stored, one row per requested URL.

Raw documents have ``url, status, headers, body``; pages may also come decoded as
``url, html``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.functions.arrow import inflated
from hrefsieve.functions.text import decode_utf8, header


#: tables of at most so many bytes are dealt out to the cores
SPREAD_BYTES = 64 << 20


def spread_files(df: DataFrame) -> DataFrame:
    """Give every core a share of a small table that has too few splits for that.

    The text of a larger table never shuffles, however many cores there are; how finely
    it is split is up to ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum``.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def read_landed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read a landed Parquet table, only the columns needed."""
    df = spark.read.parquet(path)
    return spread_files(df.select(*columns) if columns else df)


def is_gzip(url: Column, headers: Column, any_gzip_type: bool = False) -> Column:
    """Is the body announced as gzip by the URL or its content type?"""
    kind = F.lower(header(headers, "content-type"))
    by_type = F.contains(kind, F.lit("gzip")) if any_gzip_type else kind.rlike("application/(x-)?gzip")
    return F.lower(url).endswith(".gz") | F.coalesce(by_type, F.lit(False))


def usable_documents(docs: DataFrame, keep_broken: bool = False) -> DataFrame:
    """Documents with status 200 and a body, gunzipped: (url, body).

    Documents are read in one pass. Only bodies announced as gzip visit Python, and each of them once.
    """
    landed = docs.where((F.col("status") == 200) & (F.octet_length("body") > 0))
    flagged = F.coalesce(is_gzip(F.col("url"), F.col("headers"), any_gzip_type=keep_broken), F.lit(False))
    told = landed.select("url", "body", flagged.alias("_gzip"))
    opened = told.select("url", inflated(F.col("body"), F.col("_gzip"), keep_broken).alias("body"))
    return opened.where(F.octet_length("body") > 0)


def text_documents(docs: DataFrame, drop_invalid: bool = True, keep_broken: bool = False) -> DataFrame:
    """Usable documents as text: (url, text)."""
    return usable_documents(docs, keep_broken).select("url", decode_utf8(F.col("body"), drop_invalid).alias("text"))


def landed_pages(docs: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Usable pages: (url, html, size_bytes). The size is that of the gunzipped body."""
    return usable_documents(docs).select(
        "url", decode_utf8(F.col("body"), drop_invalid).alias("html"), F.octet_length("body").cast("long").alias("size_bytes")
    )


def decoded_pages(pages: DataFrame) -> DataFrame:
    """The same shape from a table of (url, html), whose text may hold invalid bytes."""
    usable = pages.where(F.octet_length("html") > 0)
    text = decode_utf8(F.col("html").cast("binary")).alias("html")
    return usable.select("url", text, F.octet_length("html").cast("long").alias("size_bytes"))


def one_page(pages: DataFrame, url: str) -> DataFrame:
    """The landed page of one URL, whatever robots rules or domains say."""
    return pages.where(F.col("url") == F.lit(url))
