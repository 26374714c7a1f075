"""Which configured domain a page belongs to, and which pages are in scope."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.functions.urls import authority, host_suffixes, is_binary
from hrefsieve.session import BROADCAST_BYTES, cut_counted, join_small, text_bytes


@dataclass(frozen=True)
class DomainList:
    """A written table of configured domains, one row each, and what a lookup has to know about it."""

    table: DataFrame  # (domain, pos, labels)
    labels: list[int]  # how many labels domains have
    small: bool

    def keep(self, rows: DataFrame, url: str = "url") -> DataFrame:
        """Rows whose ``url`` is of a configured domain or below one, with ``domain``, the first such of the list.

        A host meets domains by its own last labels: one lookup for each number of labels
        that domains have, mostly two or three, whatever the number of domains. Rows
        don't shuffle; only a list too large to broadcast is looked up by distinct hosts.
        """
        if not self.small:
            hosted = rows.withColumn("_host", authority(F.col(url)))
            found = domain_of_hosts(hosted.where(F.col("_host").isNotNull()).select(F.col("_host").alias("host")).distinct(), self.table)
            return join_small(hosted, found.withColumnRenamed("host", "_host"), "_host").drop("_host")
        found = rows.withColumn("_host", authority(F.col(url)))
        for n in self.labels:
            some = self.table.where(F.col("labels") == n).select(F.col("domain").alias("_d"), F.struct("pos", "domain").alias(f"_hit{n}"))
            found = found.join(F.broadcast(some), F.substring_index("_host", ".", -n) == F.col("_d"), "left").drop("_d")
        none = F.lit(None).cast("struct<pos: bigint, domain: string>")
        first = F.least(none, none, *[f"_hit{n}" for n in self.labels]).getField("domain")
        return found.withColumn("domain", first).where("domain is not null").drop("_host", *[f"_hit{n}" for n in self.labels])


def domain_list(domains: DataFrame) -> DomainList:
    """Prepare a table (pos, domain) of any size. Of repeated domains the first place counts."""
    once = domains.groupBy("domain").agg(F.min(F.col("pos").cast("long")).alias("pos"))
    table, seen = cut_counted(
        once.withColumn("labels", F.size(F.split("domain", "[.]"))), "domains", bytes=text_bytes(once), labels=F.collect_set("labels")
    )
    return DomainList(table, sorted(seen["labels"]), seen["bytes"] <= BROADCAST_BYTES)


def as_domain_list(spark: SparkSession, domains: DomainList | DataFrame | Sequence[str]) -> DomainList:
    """A prepared list from whatever names the domains."""
    if isinstance(domains, DomainList):
        return domains
    if not isinstance(domains, DataFrame):
        domains = spark.createDataFrame(list(enumerate(domains)), "pos int, domain string")
    return domain_list(domains)


def in_scope(rows: DataFrame, domains: DomainList, url: str = "url") -> DataFrame:
    """Rows whose ``url`` is in one of the domains and not a binary file, with ``domain``."""
    return domains.keep(rows.where(~is_binary(F.col(url))), url)


def domain_of_hosts(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """(host, domain) from distinct hosts and a table (pos, domain) of any size.

    Each host is looked up by its own suffixes, so the match is a plain equi-join. A
    suffix such as ``com`` is common to most hosts; if domains are many it is spread.
    """
    suffixed = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return (
        join_small(suffixed, domains, "domain")
        .groupBy("host")
        .agg(F.min_by("domain", "pos").alias("domain"))
    )


def with_domain(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Keep pages of the configured domains and add the ``domain`` of each.

    The lookup runs once per distinct host. The pages themselves do not shuffle
    while the host table is small.
    """
    hosted = pages.withColumn("host", authority(F.col("url"))).where(F.length("host") > 0)
    found = domain_of_hosts(hosted.select("host").distinct(), domains)
    return join_small(hosted, found, "host")
