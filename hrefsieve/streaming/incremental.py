"""Incremental scan: new landed pages are matched as they arrive, changed ones replace what was found.

A match table is a folder of tables, none of which grows with the stream's state:

``batches``    one row (url, landed, found) for each page a batch has read, with all
               patterns found on it, none included. A batch that runs twice replaces its rows.
``base``       the rows of a compaction: the newest landing of each URL.
``compacted``  the last batch that went into each base, written after it.
``rescans``    what pages that had landed before hold of strings added to the inputs.
``searched``   the patterns that all pages of the table were searched for.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hrefsieve.operators.links import blob_of, with_links
from hrefsieve.operators.matching import Matcher, matcher
from hrefsieve.operators.report import report
from hrefsieve.params import AuditParams
from hrefsieve.plans.jobs import searched
from hrefsieve.session import cut, delete_folder, folder_exists, join_lookup

ROWS = "url string, landed timestamp, found array<string>"


def stream_pages(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_batch: int = 1_000) -> DataFrame:
    """Landed page files of a folder as a stream; each file is read once.

    ``landed`` says when a page landed: a column of that name, else the time of its file.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return _with_landing(stream)


def landed_so_far(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    """The same pages as a table, for a search of all that have landed by now."""
    return _with_landing(spark.read.schema(schema).option("pathGlobFilter", files).parquet(folder))


def _with_landing(pages: DataFrame) -> DataFrame:
    landed: Column = F.col("landed") if "landed" in pages.columns else F.col("_metadata.file_modification_time")
    return pages.select("url", "html", landed.cast("timestamp").alias("landed"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that may not be there yet."""
    return spark.read.schema(schema).parquet(path) if folder_exists(spark, path) else None


def _settings(p: AuditParams) -> str:
    return f"{p.link_mode} {p.scan_body}"


def _new_patterns(spark: SparkSession, table: str, patterns: DataFrame, p: AuditParams) -> DataFrame | None:
    """The patterns that the pages of a table have not been searched for; None if there is no table yet."""
    known = _read(spark, f"{table}/searched", "pattern string, settings string")
    if known is None:
        return None
    other = known.where(F.col("settings") != _settings(p)).select("settings").first()
    if other:
        raise ValueError(f"the pages of {table} were searched with other settings ({other[0]}); scan them into a new table")
    return patterns.join(known, "pattern", "left_anti")


def _note(patterns: DataFrame, table: str, p: AuditParams) -> None:
    patterns.select("pattern", F.lit(_settings(p)).alias("settings")).write.mode("append").parquet(f"{table}/searched")


def _merged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """One row (url, landed, found) for each page of ``rows``, with its patterns among ``hits`` (url, landed, pattern)."""
    pages = rows.select("url", "landed").distinct()
    found = hits.groupBy("url", "landed").agg(F.sort_array(F.collect_set("pattern")).alias("found"))
    found = found.select(F.col("url").alias("_url"), F.col("landed").alias("_landed"), "found")
    same = (F.col("url") == F.col("_url")) & F.col("landed").eqNullSafe(F.col("_landed"))
    return pages.join(found, same, "left").select("url", "landed", F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def _exploded(rows: DataFrame, name: str = "pattern") -> DataFrame:
    return rows.select("url", "landed", F.explode("found").alias(name))


def scan_pages(pages: DataFrame, match: Matcher, p: AuditParams) -> DataFrame:
    """(url, landed, found) of pages (url, html, landed). Each pass of the matcher reads them once."""
    linked = with_links(pages.where(F.octet_length("html") > 0), p.link_mode)
    texts = linked.select("url", "landed", blob_of(F.col("hrefs"), F.col("html"), p.scan_body, p.link_mode == "regex").alias("blob"))
    each = [one(texts, ["url", "landed"], "blob") for one in match.passes]
    if match.exact:
        return each[0]
    rows = cut(reduce(DataFrame.unionByName, each), "scan")
    return _merged(rows, match.settled(_exploded(rows, "found")))


def scan_stream(pages: DataFrame, inputs: DataFrame, table: str, checkpoint: str, p: AuditParams, landed: DataFrame | None = None) -> StreamingQuery:
    """Start a scan that takes all pages landed by now and stops.

    All strings that the table has ever been searched for are searched, so that it can
    answer for any of them. Strings that are new to a table need ``landed``
    (``landed_so_far``): the pages there are searched for those strings alone, once,
    before the stream goes on. What is searched otherwise (links, body) can't change.
    """
    spark = inputs.sparkSession
    _, patterns = searched(inputs, p)
    new = _new_patterns(spark, table, patterns, p)
    if new is None:
        _note(patterns, table, p)
    elif not (new := cut(new, "new")).isEmpty():
        if landed is None:
            raise ValueError(f"the pages of {table} were not searched for all of these inputs; give the pages landed so far")
        again = scan_pages(landed, matcher(new, p.match_strategy, sample=landed.select("html")), p)
        again.where(F.size("found") > 0).write.parquet(f"{table}/rescans/id={uuid.uuid4().hex}")
        _note(new, table, p)

    # an empty batch, so that the table can be read before any page has landed
    spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{table}/batches/batch=-1")
    every = spark.read.schema("pattern string").parquet(f"{table}/searched").distinct()
    match = matcher(every, p.match_strategy)  # once, not per batch

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        scan_pages(batch, match, p).write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(add_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _compacted(spark: SparkSession, table: str) -> int | None:
    """The last batch in the newest base."""
    marks = _read(spark, f"{table}/compacted", "upto long")
    return marks.agg(F.max("upto")).first()[0] if marks is not None else None


def _rows(spark: SparkSession, table: str) -> DataFrame:
    """All rows that count: the newest base, later batches, and rescans."""
    upto = _compacted(spark, table)
    rows = spark.read.schema(f"{ROWS}, batch long").parquet(f"{table}/batches")
    if upto is not None:
        base = spark.read.schema(ROWS).parquet(f"{table}/base/upto={upto}")
        rows = rows.where(F.col("batch") > upto).drop("batch").unionByName(base)
    again = _read(spark, f"{table}/rescans", ROWS)
    rows = rows.select("url", "landed", "found")
    return rows if again is None else rows.unionByName(again.select("url", "landed", "found"))


def newest_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows (url, landed, found) of each URL's newest landing.

    Rows of one landing add up: copies of a page in one file, and what a rescan has found.
    """
    rows = _rows(spark, table).withColumn("landed", F.coalesce("landed", F.timestamp_seconds(F.lit(0))))
    newest = rows.groupBy("url").agg(F.max("landed").alias("newest"))
    return join_lookup(rows, newest, "url").where(F.col("landed") == F.col("newest")).select("url", "landed", "found")


def compact(spark: SparkSession, table: str) -> int:
    """Merge all batches and rescans into one base of the newest landings; returns the last batch in it.

    Run it between scans. Readers go over to the base once it is marked as whole; the
    rows it replaces are deleted after that, so a run that fails halfway loses nothing.
    """
    before = _compacted(spark, table)
    batches = spark.read.schema(f"{ROWS}, batch long").parquet(f"{table}/batches")
    upto = batches.select("batch").distinct().agg(F.max("batch")).first()[0]
    upto = max(-1 if upto is None else upto, -1 if before is None else before)
    newest = cut(newest_rows(spark, table), "newest")
    base = cut(_merged(newest, _exploded(newest)), "base")  # the old base may be read here and replaced below
    base.write.mode("overwrite").parquet(f"{table}/base/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{table}/compacted")
    for name in [r["batch"] for r in batches.where(F.col("batch") <= upto).select("batch").distinct().collect()]:
        delete_folder(spark, f"{table}/batches/batch={name}")
    if before is not None and before != upto:
        delete_folder(spark, f"{table}/base/upto={before}")
    delete_folder(spark, f"{table}/rescans")
    spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{table}/batches/batch=-1")
    return upto


def stream_report(spark: SparkSession, table: str, inputs: DataFrame, p: AuditParams) -> DataFrame:
    """The report over the newest landings of everything scanned so far."""
    variants, patterns = searched(inputs, p)
    new = _new_patterns(spark, table, patterns, p)
    if new is None or not new.isEmpty():
        raise ValueError(f"the pages of {table} were not searched for all of these inputs; scan them first")
    hits = _exploded(newest_rows(spark, table)).select("url", "pattern")
    return report(inputs, variants, hits, p.max_match_pages)
