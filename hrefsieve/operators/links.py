"""Anchor links of pages and the text blob they are searched in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.functions.arrow import dom_links
from hrefsieve.functions.urls import link_target

# Fixed value: the anchor pattern of the regex mode.
ANCHOR = r"""(?i)<a\s+[^>]*href=["']?([^"' >]+)["']?[^>]*>"""


def regex_links(url: Column, html: Column) -> Column:
    """Absolute, defragmented links of anchor tags matched in the text."""
    raw = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    return F.array_compact(F.transform(raw, lambda h: link_target(url, h)))


def with_links(pages: DataFrame, link_mode: str = "dom", keep_empty: bool = False) -> DataFrame:
    """Add ``hrefs``, the links of each page in document order."""
    url, html = F.col("url"), F.col("html")
    found = regex_links(url, html) if link_mode == "regex" else dom_links(url, html, keep_empty)
    return pages.withColumn("hrefs", found)


def page_links(pages: DataFrame, link_mode: str = "dom") -> DataFrame:
    """One row per link: (url, pos, href)."""
    return with_links(pages, link_mode).select("url", F.posexplode("hrefs").alias("pos", "href"))


def blob_of(hrefs: Column, html: Column, scan_body: bool = True, empty_line: bool = False) -> Column:
    """The searched text: links by line, then the page if ``scan_body``.

    ``empty_line`` keeps the line of an empty link list.
    """
    links = F.array_join(hrefs, "\n")
    listed = links if empty_line else F.when(F.size(hrefs) > 0, links)
    return F.concat_ws("\n", listed, html) if scan_body else F.coalesce(listed, F.lit(""))


def page_blobs(pages: DataFrame, link_mode: str = "dom", scan_body: bool = True, keep_empty: bool = False) -> DataFrame:
    """(url, blob) of each page."""
    linked = with_links(pages.select("url", "html"), link_mode, keep_empty)
    empty_line = keep_empty or link_mode == "regex"
    return linked.select("url", blob_of(F.col("hrefs"), F.col("html"), scan_body, empty_line).alias("blob"))
