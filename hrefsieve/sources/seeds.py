"""Where discovery starts: base URLs, robots.txt documents, first sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.functions.text import lines, strip
from hrefsieve.sources.landed import text_documents


def domain_table(spark: SparkSession, domains: Sequence[str]) -> DataFrame:
    """The configured domains with their place in the list."""
    return spark.createDataFrame(list(enumerate(domains)), "pos int, domain string")


def base_urls(domains: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """One base URL per domain and scheme."""
    each = F.posexplode(F.array(*[F.lit(s) for s in schemes]))
    named = domains.select("*", each.alias("scheme_no", "scheme"))
    return named.withColumn("base", F.concat("scheme", F.lit("://"), "domain"))


def robots_urls(bases: DataFrame) -> DataFrame:
    """Where each base keeps its robots.txt."""
    return bases.withColumn("url", F.concat("base", F.lit("/robots.txt")))


def robots_sitemaps(robots_text: DataFrame) -> DataFrame:
    """Sitemap URLs declared in robots.txt texts of (url, text): (robots_url, url)."""
    line = F.explode(lines(F.col("text")))
    declared = robots_text.select(F.col("url").alias("robots_url"), line.alias("line")).where(
        F.col("line").rlike("(?i)^sitemap:")
    )
    found = strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)\z", 1))
    return declared.select("robots_url", found.alias("url")).where(F.length("url") > 0).distinct()


def candidate_sitemaps(domains: DataFrame, docs: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """First sitemaps of all domains: those robots.txt declares and /sitemap.xml. (url)"""
    bases = base_urls(domains, schemes)
    wanted = robots_urls(bases).select("url").distinct()
    robots = text_documents(docs.where(F.col("url").endswith("/robots.txt")).join(wanted, "url", "left_semi"))
    fallback = bases.select(F.concat("base", F.lit("/sitemap.xml")).alias("url"))
    return robots_sitemaps(robots).select("url").union(fallback).distinct()
