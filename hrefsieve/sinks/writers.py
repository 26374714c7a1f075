"""Output folders and datasets of a run.

Each dataset is a folder of parts written in parallel. Sorted datasets are range
partitioned, so their parts in name order are in order as a whole.
"""

from __future__ import annotations

import posixpath
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefsieve.operators.report import wide


def run_stamp(utc: bool = False, now: datetime | None = None) -> str:
    """Stamp of a run: local ``20240131_235959`` or UTC ``20240131T235959``."""
    if utc:
        return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S")
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def run_folder(output: str, stamp: str) -> str:
    """Folder of a run, next to where ``output`` points."""
    return posixpath.join(posixpath.dirname(output) or ".", f"output_{stamp}")


def stamped_path(name: str, folder: str, stamp: str) -> str:
    """``<folder>/<name>_<stamp><ext>``."""
    stem, ext = posixpath.splitext(posixpath.basename(name))
    return posixpath.join(folder, f"{stem}_{stamp}{ext}")


def write_report(report: DataFrame, path: str, n: int = 100, quote_all: bool = False) -> None:
    """CSV with one row per input in input order, pages in ``n`` columns."""
    rows = wide(report, n).orderBy("input_id").drop("input_id")
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', emptyValue="", nullValue="")


def write_report_long(report: DataFrame, path: str) -> None:
    """Parquet with ``pages`` as an array, for further queries."""
    report.write.mode("overwrite").parquet(path)


def write_single_page(report: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV of a single-page check."""
    write_report(report, path, 1, quote_all)


def sorted_urls(df: DataFrame) -> DataFrame:
    """Distinct URLs in ascending order."""
    return df.select("url").distinct().orderBy("url")


def write_urls(df: DataFrame, path: str) -> None:
    """Text file of distinct URLs in order, one per line."""
    sorted_urls(df).write.mode("overwrite").text(path)


def write_inventory(inventory: DataFrame, path: str, quote_all: bool = True) -> None:
    """CSV of scanned pages with their sizes."""
    rows = inventory.select("url", F.col("size_bytes"))
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"')
