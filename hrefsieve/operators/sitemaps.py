"""Sitemap documents and the closure over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.functions.arrow import sitemap_locs
from hrefsieve.functions.text import JS_SPACE_CLASS, looks_like_xml, strip
from hrefsieve.functions.urls import defragment, is_sitemap_like
from hrefsieve.operators.domains import DomainList, as_domain_list, in_scope
from hrefsieve.session import BROADCAST_BYTES, first_rows, scratch_path, text_bytes, write_counted
from hrefsieve.sources.landed import text_documents

SITEMAP, PAGE = "sitemap", "page"
# Fixed value: the location pattern of the regex mode.
LOC = r"(?i)<loc>([^<]+)</loc>"


def _kind(is_index: Column, loc: Column) -> Column:
    return F.when(is_index | is_sitemap_like(loc), SITEMAP).otherwise(PAGE)


def document_locs(texts: DataFrame, loc_mode: str = "xml") -> DataFrame:
    """Locations in sitemap texts (url, text): (parent, kind, loc).

    Documents that do not start like XML, or in ``xml`` mode are not well-formed,
    name none.
    """
    if loc_mode == "regex":
        found = F.explode(F.regexp_extract_all("text", F.lit(LOC), F.lit(1)))
        start = F.regexp_like("text", F.lit(rf"\A{JS_SPACE_CLASS}*<"))
        raw = texts.where(start).select(F.col("url").alias("parent"), found.alias("raw"))
        raw = raw.select("parent", strip(F.col("raw"), JS_SPACE_CLASS).alias("loc"))
        return raw.where(F.length("loc") > 0).select("parent", _kind(F.lit(False), F.col("loc")).alias("kind"), "loc")
    read = texts.where(looks_like_xml(F.col("text"))).select(F.col("url").alias("parent"), sitemap_locs("text").alias("d"))
    each = read.select("parent", "d.is_index", F.explode("d.locs").alias("loc"))
    return each.select("parent", _kind(F.col("is_index"), F.col("loc")).alias("kind"), "loc")


@dataclass
class Closure:
    """What a walk over sitemaps found. All frames are read from written tables."""

    sitemaps: DataFrame  # (url, depth): every sitemap looked up, landed or not
    locs: DataFrame  # (parent, kind, loc, depth)
    depth: int
    n_sitemaps: int


# Whatever names a location has this in its text.
NAMES_LOCATIONS = r"(?i)[<:]loc[\s>/]"


def sitemap_edges(docs: DataFrame, loc_mode: str = "xml") -> DataFrame:
    """All locations that landed documents name, from one pass over them: (parent, kind, loc)."""
    keep_broken = loc_mode == "regex"
    texts = text_documents(docs, not keep_broken, keep_broken)
    return document_locs(texts.where(F.regexp_like("text", F.lit(NAMES_LOCATIONS))), loc_mode)


#: parts of the edge table, by hash of the parent; a level reads only those its sitemaps fall in
EDGE_BUCKETS = 64
EDGE_SCHEMA = "parent string, kind string, loc string, bucket int"


def _bucket(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(EDGE_BUCKETS)).cast("int")


def written_edges(edges: DataFrame) -> DataFrame:
    """Edges (parent, kind, loc) as a table partitioned by a hash of the parent.

    Parts are dealt out by size, so a parent with a large share of all edges doesn't
    gather in one task.
    """
    path = scratch_path(edges.sparkSession, "edges")
    edges.select("parent", "kind", "loc", _bucket("parent").alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return edges.sparkSession.read.schema(EDGE_SCHEMA).parquet(path)


def edges_of(edges: DataFrame, parents: DataFrame, buckets: list[int], fits: bool) -> DataFrame:
    """The edges (parent, kind, loc) of some parents (url) that fall in the given parts."""
    near = edges.where(F.col("bucket").isin(buckets))
    wanted = parents.select(F.col("url").alias("parent"))
    return near.join(F.broadcast(wanted) if fits else wanted, "parent", "left_semi").select("parent", "kind", "loc")


def sitemap_closure(
    seeds: DataFrame,
    docs: DataFrame,
    domains: Sequence[str] | DomainList,
    max_sitemaps: int | None = None,
    max_pages: int | None = None,
    loc_mode: str = "xml",
) -> Closure:
    """Follow sitemaps from ``seeds`` (url) through landed documents, level by level.

    Documents are read once, whatever the depth: what they name is written as an edge
    table, and levels read only the parts of it that their sitemaps fall in.
    """
    return walk(seeds, written_edges(sitemap_edges(docs, loc_mode)), domains, max_sitemaps, max_pages)


def walk(
    seeds: DataFrame, edges: DataFrame, domains: Sequence[str] | DomainList, max_sitemaps: int | None = None, max_pages: int | None = None
) -> Closure:
    """The closure of ``seeds`` (url) over a written edge table.

    Each level is written below the checkpoint folder before the next starts, so no plan
    grows with depth and a lost executor repeats one level at most. The writes count what
    the walk has to know. The URLs of a level are broadcast while they fit. Missing
    documents count towards ``max_sitemaps``; of a level that exceeds it the smallest
    URLs are kept. The walk stops after the level that reaches ``max_pages``. Without
    budgets it ends where nothing new is named.
    """
    spark = seeds.sparkSession
    base = scratch_path(spark, "closure")
    seen = None
    frontier = seeds.select("url").distinct()
    left, depth, pages, total = max_sitemaps, 0, 0, 0

    while left is None or left > 0:
        level = f"{base}/seen/depth={depth}"
        taken = frontier if left is None else first_rows(frontier, [F.col("url")], left)
        size = write_counted(taken, level, bytes=text_bytes(taken), buckets=F.collect_set(_bucket("url")))
        if size["n"] == 0:
            break
        total += size["n"]
        left = None if left is None else left - size["n"]
        found = spark.read.schema("url string").parquet(level)
        named = write_counted(
            edges_of(edges, found, size["buckets"], size["bytes"] <= BROADCAST_BYTES), f"{base}/locs/depth={depth}",
            pages=F.count_if(F.col("kind") == PAGE), nested=F.count_if(F.col("kind") == SITEMAP),
        )
        seen = spark.read.schema("url string, depth int").parquet(f"{base}/seen")
        locs = spark.read.schema("parent string, kind string, loc string, depth int").parquet(f"{base}/locs")
        here = spark.read.schema("parent string, kind string, loc string").parquet(f"{base}/locs/depth={depth}")
        pages += named["pages"]
        depth += 1
        if named["nested"] == 0:
            break
        if max_pages is not None and pages >= max_pages and discovered_pages(locs, domains).count() >= max_pages:
            break
        frontier = here.where(F.col("kind") == SITEMAP).select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")

    if seen is None:
        empty = spark.createDataFrame([], "parent string, kind string, loc string, depth int")
        return Closure(empty.select(F.col("loc").alias("url"), "depth"), empty, 0, 0)
    return Closure(seen, locs, depth, total)


NEXT_LEVEL = """
SELECT DISTINCT e.loc AS url
FROM {edges} e JOIN {level} l ON e.parent = l.url
WHERE e.kind = 'sitemap' AND NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.url = e.loc)
"""


def closure_sql(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, depth) of the closure of ``seeds`` (url) over edges (parent, kind, loc), one SQL statement a level.

    A recursive statement can't leave out what it has seen, so sitemaps that several
    others share would multiply along every path. Here each level is written, and the
    next statement reads the whole walk so far: a sitemap is followed once, whatever
    names it, and neither rows nor depth have a limit.
    """
    spark = seeds.sparkSession
    base = scratch_path(spark, "levels")
    level, depth = seeds.select("url").distinct(), 0
    while write_counted(level, f"{base}/depth={depth}")["n"]:
        seen = spark.read.schema("url string, depth int").parquet(base)
        last = spark.read.schema("url string").parquet(f"{base}/depth={depth}")
        level, depth = spark.sql(NEXT_LEVEL, edges=edges, level=last, seen=seen), depth + 1
    return spark.read.schema("url string, depth int").parquet(base)


def discovered_pages(locs: DataFrame, domains: Sequence[str] | DomainList) -> DataFrame:
    """Distinct pages in scope, without fragments, at their smallest depth: (url, depth)."""
    scoped = in_scope(locs.where(F.col("kind") == PAGE), as_domain_list(locs.sparkSession, domains), "loc")
    return (
        scoped.select(defragment(F.col("loc")).alias("url"), "depth")
        .where(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.min("depth").alias("depth"))
    )


def page_budget(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` pages by depth, then URL: (url)."""
    if max_pages is None:
        return pages.select("url")
    return first_rows(pages, [F.col("depth"), F.col("url")], max_pages).select("url")
