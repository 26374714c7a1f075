"""From matches to the report: one row per input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefsieve.operators.pages_per_pattern import page_sets
from hrefsieve.session import join_lookup


def _no_pages() -> Column:
    return F.array().cast("array<string>")


def pages_per_input(variants: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(queried_url, pages): union over the variants of each searched string, first ``n``.

    The cut per variant comes first; the smallest ``n`` of the union are among them.
    """
    per_variant = page_sets(hits.withColumnRenamed("pattern", "variant"), n, "variant")
    merged = F.sort_array(F.array_distinct(F.flatten(F.collect_list("pages"))))
    return (
        join_lookup(variants, per_variant, "variant")
        .groupBy("queried_url")
        .agg(F.slice(merged, 1, n).alias("pages"))
    )


def report(inputs: DataFrame, variants: DataFrame, hits: DataFrame, n: int = 100) -> DataFrame:
    """(input_id, queried_url, found, match_count, pages) for every input, repeats included."""
    return report_of(inputs, pages_per_input(variants, hits, n))


def report_of(inputs: DataFrame, matched: DataFrame) -> DataFrame:
    """The report from the pages (queried_url, pages) of the strings that were found."""
    pages = F.coalesce("pages", _no_pages())
    return join_lookup(inputs, matched, "queried_url", "left").select(
        "input_id",
        "queried_url",
        (F.size(pages) > 0).alias("found"),
        F.size(pages).alias("match_count"),
        pages.alias("pages"),
    )


def wide(report: DataFrame, n: int = 100) -> DataFrame:
    """Spread ``pages`` over the columns ``match_page_1`` to ``match_page_n``, '' where none."""
    columns = [F.coalesce(F.get("pages", F.lit(i)), F.lit("")).alias(f"match_page_{i + 1}") for i in range(n)]
    return report.select("input_id", "queried_url", "found", "match_count", *columns)


def matched_inputs(report: DataFrame) -> DataFrame:
    """Distinct searched strings that were found."""
    return report.where("found").select("queried_url").distinct()


def matched_preview(report: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of them."""
    return matched_inputs(report).orderBy("queried_url").limit(n)


def summary(report: DataFrame) -> DataFrame:
    """One row of counts over a report."""
    return report.agg(
        F.count("*").alias("inputs"),
        F.count_distinct("queried_url").alias("distinct_inputs"),
        F.count_distinct(F.when(F.col("found"), F.col("queried_url"))).alias("inputs_matched"),
        F.coalesce(F.sum("match_count"), F.lit(0)).cast("long").alias("pages_listed"),
    )
