"""End-to-end jobs: discovery, full audit, crawl-only inventory, single-page check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.operators.bloom import key_filter
from hrefsieve.operators.domains import DomainList, domain_list, in_scope
from hrefsieve.operators.links import blob_of, page_blobs, with_links
from hrefsieve.operators.matching import Matcher, matcher
from hrefsieve.operators.pages_per_pattern import first_pages
from hrefsieve.operators.report import pages_per_input, report, report_of
from hrefsieve.operators.robots import domain_verdicts, with_verdict
from hrefsieve.operators.sitemaps import discovered_pages, page_budget, sitemap_closure
from hrefsieve.operators.variants import input_variants, pattern_set
from hrefsieve.params import AuditParams
from hrefsieve.session import cut, cut_counted, text_bytes
from hrefsieve.sinks.writers import (
    stamped_path, write_inventory, write_report, write_report_long, write_single_page, write_urls,
)
from hrefsieve.sources.landed import one_page
from hrefsieve.sources.seeds import base_urls, candidate_sitemaps, domain_table, robots_urls
from hrefsieve import params as names


@dataclass
class Discovery:
    initial: DataFrame  # (url): sitemaps the walk starts from
    sitemaps: DataFrame  # (url, depth): sitemaps looked up
    pages: DataFrame  # (url): pages found, within the page budget
    counts: dict[str, int]  # rows of each, as the writes counted them


@dataclass
class Audit:
    discovery: Discovery
    inventory: DataFrame  # (url, size_bytes): pages scanned
    matched: DataFrame | None  # (queried_url, pages): strings that were found
    report: DataFrame | None  # (input_id, queried_url, found, match_count, pages)
    counts: dict[str, int]  # of the discovery, pages scanned, inputs matched


def configured(spark: SparkSession, p: AuditParams, domains: DataFrame | None = None) -> DomainList:
    """The domains of a run: those of a table (pos, domain) of any size, else those of the settings."""
    return domain_list(domain_table(spark, p.domains) if domains is None else domains)


def discover(docs: DataFrame, p: AuditParams, domains: DataFrame | None = None) -> Discovery:
    """Pages and sitemaps reachable from the robots.txt and /sitemap.xml of the domains."""
    return _discover(docs, p, configured(docs.sparkSession, p, domains))


def _discover(docs: DataFrame, p: AuditParams, domains: DomainList) -> Discovery:
    initial, start = cut_counted(candidate_sitemaps(domains.table, docs, p.schemes), "initial")
    walk = sitemap_closure(initial, docs, domains, p.max_sitemaps, p.max_pages, p.loc_mode)
    pages, found = cut_counted(page_budget(discovered_pages(walk.locs, domains), p.max_pages), "pages")
    counts = {"candidate_sitemaps": start["n"], "sitemaps_processed": walk.n_sitemaps, "pages_collected": found["n"]}
    return Discovery(initial, walk.sitemaps, pages, counts)


def robots_of_domains(docs: DataFrame, p: AuditParams, domains: DataFrame | None = None) -> DataFrame:
    """Landed robots.txt of each domain, that of the first scheme: (domain, status, body).

    A document that did not land has status 0. Of several landings the one with the
    lowest status counts, so each domain has one row.
    """
    listed = domain_table(docs.sparkSession, p.domains) if domains is None else domains
    bases = robots_urls(base_urls(listed.select("domain"), p.schemes[:1]))
    landed = docs.where(F.col("url").endswith("/robots.txt")).groupBy("url").agg(F.min(F.struct("status", "body")).alias("doc"))
    return bases.join(landed, "url", "left").select("domain", F.coalesce("doc.status", F.lit(0)).alias("status"), "doc.body")


def admitted(pages: DataFrame, docs: DataFrame | None, p: AuditParams, domains: DomainList) -> DataFrame:
    """Rows whose ``url`` is in scope and allowed by the robots rules of its domain.

    Scope and rules arrive by small joins.
    """
    scoped = in_scope(pages, domains)
    if not p.respect_robots or docs is None:
        return scoped.select(*pages.columns)
    verdicts = domain_verdicts(robots_of_domains(docs, p, domains.table), p.agent_token, p.longest_robots_match)
    return with_verdict(scoped, verdicts).where("allowed").select(*pages.columns)


def scan(pages: DataFrame, match: Matcher, p: AuditParams, keep_empty: bool = False) -> DataFrame:
    """(url, pattern): which patterns of a prepared matcher occur on which pages."""
    return match(page_blobs(pages, p.link_mode, p.scan_body, keep_empty), "url", "blob")


def scan_results(pages: DataFrame, match: Matcher | None, p: AuditParams, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of every page, and in ``found`` an array of what its text holds, written.

    One pass over the pages; only pattern lists too large for one pass of the matcher need
    more, and give a row of a page for each. What is found has yet to be ``settled``.
    """
    if match is None:
        return cut(pages.select(*kept), "scan")
    texts = with_links(pages.select(*{*kept, "url", "html"}), p.link_mode)
    texts = texts.withColumn("blob", blob_of(F.col("hrefs"), F.col("html"), p.scan_body, p.link_mode == "regex"))
    results = [cut(one(texts, kept, "blob"), "scan") for one in match.passes]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def searched(inputs: DataFrame, p: AuditParams) -> tuple[DataFrame, DataFrame]:
    """Variants of the inputs, written once as several stages read them, and their patterns."""
    variants = cut(input_variants(inputs, p.encode_mode, p.min_variant_length), "variants")
    return variants, pattern_set(variants).withColumnRenamed("variant", "pattern")


def wanted_pages(pages: DataFrame, wanted: DataFrame, size: dict, p: AuditParams) -> tuple[DataFrame, bool]:
    """The pages whose URL is on a written list, before anything reads their text, and whether that is exact.

    A list within ``broadcast_bytes`` selects exactly. A Bloom filter stands for a larger
    one: it keeps all wanted pages and one other in a thousand, which the small results
    of the scan are rid of later. Pages never shuffle.
    """
    if size["bytes"] <= p.broadcast_bytes:
        return pages.join(F.broadcast(wanted), "url", "left_semi"), True
    return pages.where(key_filter(wanted.select("url"), size["n"]).might_hold(F.col("url"))), False


def audit(inputs: DataFrame | None, pages: DataFrame, docs: DataFrame, p: AuditParams, domains: DataFrame | None = None) -> Audit:
    """Discover, admit, scan and report. Without inputs only the inventory is made.

    ``pages`` are landed pages (url, html, size_bytes). Only discovered and admitted
    ones count, which is settled on the list of URLs. That list selects pages before
    their text is parsed. The pages are read in one pass, whose written result (url,
    size, what was found) gives both the inventory and the matches; no HTML ever shuffles.
    ``domains`` may name the domains as a table (pos, domain) instead of the settings.
    """
    listed = configured(docs.sparkSession, p, domains)
    found = _discover(docs, p, listed)
    wanted = admitted(found.pages, docs, p, listed)
    wanted, size = cut_counted(wanted, "admitted", bytes=text_bytes(wanted))
    some, exact = wanted_pages(pages, wanted, size, p)
    only = (lambda rows: rows) if exact else (lambda rows: rows.join(wanted, "url", "left_semi"))
    match = None
    if inputs is not None:
        variants, patterns = searched(inputs, p)
        match = matcher(patterns, p.match_strategy, sample=pages.select("html"))
    scanned = scan_results(some, match, p, ["url", "size_bytes"])
    # one row per URL, however often it landed
    inventory = only(scanned.select("url", "size_bytes")).groupBy("url").agg(F.max("size_bytes").alias("size_bytes"))
    inventory, kept = cut_counted(inventory, "inventory")
    counts = found.counts | {"pages_scanned": kept["n"]}
    if match is None:
        return Audit(found, inventory, None, None, counts)
    hits = match.settled(only(scanned.select("url", F.explode("found").alias("found"))))
    hits = cut(first_pages(hits, p.max_match_pages), "matches")
    matched, n = cut_counted(pages_per_input(variants, hits, p.max_match_pages), "matched")
    return Audit(found, inventory, matched, report_of(inputs, matched), counts | {"inputs_matched": n["n"]})


def audit_pages(inputs: DataFrame, pages: DataFrame, p: AuditParams) -> DataFrame:
    """Report over all given pages, without discovery or admission."""
    variants, patterns = searched(inputs, p)
    hits = scan(pages, matcher(patterns, p.match_strategy, sample=pages.select("html")), p)
    return report(inputs, variants, hits, p.max_match_pages)


def crawl_inventory(pages: DataFrame, docs: DataFrame, p: AuditParams, domains: DataFrame | None = None) -> DataFrame:
    """(url, size_bytes) of every page a crawl without inputs would scan."""
    return audit(None, pages, docs, p, domains).inventory


def check_page(inputs: DataFrame, pages: DataFrame, url: str, p: AuditParams) -> DataFrame:
    """Report over the one page ``url``; no robots, domain or discovery checks."""
    variants, patterns = searched(inputs, p)
    hits = scan(one_page(pages, url), matcher(patterns, p.match_strategy), p, keep_empty=True)
    return report(inputs, variants, hits, 1)


def run_summary(result: Audit) -> DataFrame:
    """One row of counts over a whole run, and the first ten strings found.

    The counts come from the writes of the run; only the strings are read, from the
    written list of those that were found.
    """
    counts = [F.lit(n).cast("long").alias(name) for name, n in result.counts.items()]
    if result.matched is None:
        return result.inventory.sparkSession.range(1).select(*counts)
    first = result.matched.select("queried_url").orderBy("queried_url").limit(10)
    return first.agg(F.sort_array(F.collect_list("queried_url")).alias("matched_preview")).select(*counts, "matched_preview")


def budget_flags(result: Audit, p: AuditParams) -> dict[str, bool]:
    """Which budgets the run used up, so that there may be more than it shows."""
    full = lambda name, most: most is not None and result.counts[name] >= most
    return {
        "sitemap_budget_reached": full("sitemaps_processed", p.max_sitemaps),
        "page_budget_reached": full("pages_collected", p.max_pages),
    }


def write_summary(result: Audit, path: str, p: AuditParams) -> None:
    """Counts of a run, a preview of the matches, and whether a budget ended it, as one JSON row."""
    flags = budget_flags(result, p)
    run_summary(result).select("*", *[F.lit(v).alias(k) for k, v in flags.items()]).coalesce(1).write.mode("overwrite").json(path)


def write_audit(
    result: Audit, folder: str, stamp: str, p: AuditParams, report_name: str = names.REPORT_NAME, quote_all: bool = False
) -> None:
    """Write all outputs of a run below ``folder``. The summary reads none of them again."""
    write_urls(result.discovery.initial, stamped_path(names.INITIAL_SITEMAPS_NAME, folder, stamp))
    write_urls(result.discovery.sitemaps, stamped_path(names.ALL_SITEMAPS_NAME, folder, stamp))
    write_urls(result.discovery.pages, stamped_path(names.PAGES_NAME, folder, stamp))
    write_inventory(result.inventory, stamped_path(names.INVENTORY_NAME, folder, stamp))
    if result.report is not None:
        long_path = stamped_path("report.parquet", folder, stamp)
        write_report_long(result.report, long_path)
        written = result.report.sparkSession.read.parquet(long_path)
        write_report(written, stamped_path(report_name, folder, stamp), p.max_match_pages, quote_all)
    write_summary(result, stamped_path(names.SUMMARY_NAME, folder, stamp), p)


def write_check(result: DataFrame, folder: str, stamp: str, quote_all: bool = False) -> None:
    """Write a single-page check below ``folder``."""
    write_single_page(result, stamped_path(names.SINGLE_PAGE_NAME, folder, stamp), quote_all)
