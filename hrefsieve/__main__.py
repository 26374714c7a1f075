"""Command line: ``spark-submit ... -m hrefsieve`` or ``python -m hrefsieve``.

Takes the options of the crawler it replaces, plus where the landed documents are.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from hrefsieve.params import CLI_MAX_PAGES, CLI_MAX_SITEMAPS, INPUT_NAME, REPORT_NAME, AuditParams
from hrefsieve.plans.jobs import audit, check_page, write_audit, write_check
from hrefsieve.session import remove_scratch
from hrefsieve.sinks.writers import run_folder, run_stamp
from hrefsieve.sources.inputs import read_inputs
from hrefsieve.sources.landed import landed_pages, one_page, read_landed

RAW = ["url", "status", "headers", "body"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hrefsieve", description="Find on which pages of your sites each string of a list occurs.")
    p.add_argument("--pages", required=True, help="Parquet table of landed pages (url, status, headers, body)")
    p.add_argument("--docs", help="Parquet table of landed robots.txt and sitemap documents; default: the pages table")
    p.add_argument("--input", default=INPUT_NAME, help="list of searched strings, one per line")
    p.add_argument("--output", default=REPORT_NAME, help="report path; outputs go to a stamped folder next to it")
    p.add_argument("--test-url", help="check this one page only")
    p.add_argument("--no-body", action="store_true", help="search links only, not the HTML")
    p.add_argument("--ignore-inputs", action="store_true", help="only list the pages a crawl would scan")
    p.add_argument("--max-pages", type=int, default=CLI_MAX_PAGES, help="pages to scan at most (default %(default)s); 0 for all")
    p.add_argument("--max-sitemaps", type=int, default=CLI_MAX_SITEMAPS, help="sitemaps to look up at most (default %(default)s); 0 for all")
    p.add_argument("--schemes", nargs="*", default=list(AuditParams.schemes), choices=["https", "http"])
    p.add_argument("--link-mode", default=AuditParams.link_mode, choices=["dom", "regex"])
    p.add_argument("--loc-mode", default=AuditParams.loc_mode, choices=["xml", "regex"])
    p.add_argument("--encode-mode", default=AuditParams.encode_mode, choices=["quote", "uri"])
    p.add_argument("--no-robots", action="store_true", help="scan pages that robots.txt disallows too")
    p.add_argument("--longest-robots-match", action="store_true", help="the longest matching robots rule wins, not the first")
    p.add_argument("--match-strategy", default=AuditParams.match_strategy, choices=["auto", "native", "automaton", "windows"])
    p.add_argument("--min-variant-length", type=int, default=AuditParams.min_variant_length, help="shorter forms of a string are not searched")
    p.add_argument("--quote-all", action="store_true", help="quote every field of the reports")
    p.add_argument("--utc-stamp", action="store_true", help="name the output folder by UTC time, 20240131T235959")
    p.add_argument("--domains", nargs="*", default=list(AuditParams.domains))
    p.add_argument("--domain-list", help="text file of domains, one per line, instead of --domains; as many as you like")
    p.add_argument("--concurrency", type=int, help="accepted and unused: pages are fetched elsewhere")
    return p


def run(spark: SparkSession, argv: list[str] | None = None, stamp: str | None = None) -> str:
    """Run one job; returns the folder of its outputs."""
    args = parser().parse_args(argv)
    p = AuditParams(
        domains=tuple(args.domains), schemes=tuple(args.schemes), max_pages=args.max_pages or None, max_sitemaps=args.max_sitemaps or None,
        scan_body=not args.no_body, respect_robots=not args.no_robots, longest_robots_match=args.longest_robots_match,
        link_mode=args.link_mode, loc_mode=args.loc_mode, encode_mode=args.encode_mode,
        match_strategy=args.match_strategy, min_variant_length=args.min_variant_length,
    )
    stamp = stamp or run_stamp(args.utc_stamp)
    folder = run_folder(args.output, stamp)
    pages = read_landed(spark, args.pages, RAW)
    if args.test_url:
        landed = landed_pages(one_page(pages, args.test_url))
        write_check(check_page(read_inputs(spark, args.input), landed, args.test_url, p), folder, stamp, args.quote_all)
        return folder
    docs = read_landed(spark, args.docs, RAW) if args.docs else pages
    inputs = None if args.ignore_inputs else read_inputs(spark, args.input)
    domains = read_inputs(spark, args.domain_list).toDF("pos", "domain") if args.domain_list else None
    write_audit(audit(inputs, landed_pages(pages), docs, p, domains), folder, stamp, p, args.output, args.quote_all)
    return folder


def main() -> None:
    spark = SparkSession.builder.appName("hrefsieve").getOrCreate()
    try:
        print(run(spark))
    finally:
        remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
