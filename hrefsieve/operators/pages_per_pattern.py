"""The first N pages of each pattern, safe for patterns found on most pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_pages(hits: DataFrame, n: int, pattern: str = "pattern", key: str = "url") -> DataFrame:
    """Distinct (pattern, key) pairs, the ``n`` smallest keys of each pattern.

    The rank filter comes first and is applied within each task before anything
    shuffles, so a pattern found everywhere sends ``n`` keys per task and no more. Pairs
    found more than once rank alike and become one among the few that are left.
    """
    rank = F.dense_rank().over(Window.partitionBy(pattern).orderBy(key))
    pairs = hits.select(pattern, key).withColumn("_rank", rank).where(F.col("_rank") <= n)
    return pairs.select(pattern, key).distinct()


def page_sets(hits: DataFrame, n: int, pattern: str = "pattern", key: str = "url") -> DataFrame:
    """One row per pattern with ``pages``, its at most ``n`` smallest keys in order."""
    capped = first_pages(hits, n, pattern, key)
    return capped.groupBy(pattern).agg(F.sort_array(F.collect_list(key)).alias("pages"))
