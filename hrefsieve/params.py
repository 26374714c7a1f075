"""Settings of a link audit and the fixed values it is defined by."""

from __future__ import annotations

from dataclasses import dataclass

# File endings of links that are never pages.
BINARY_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".rar",
    ".7z", ".mp4", ".mp3", ".mov", ".avi", ".mkv", ".woff", ".woff2", ".ttf",
    ".eot", ".otf", ".ico",
)

# Fixed value: the agent whose robots.txt group applies.
USER_AGENT = "URL-Scanner/1.0 (+contact: your@email.com)"

# Names of the files a run writes.
REPORT_NAME = "outputlist.csv"
INVENTORY_NAME = "scanned_pages.csv"
SINGLE_PAGE_NAME = "test_results.csv"
INITIAL_SITEMAPS_NAME = "discovered_sitemaps_initial.txt"
ALL_SITEMAPS_NAME = "discovered_sitemaps_all.txt"
PAGES_NAME = "discovered_pages.txt"
INPUT_NAME = "domains_and_subdomains_to_search_for.csv"
SUMMARY_NAME = "run_summary.json"

# The budgets of a run from the command line.
CLI_MAX_PAGES = 20_000
CLI_MAX_SITEMAPS = 5_000


@dataclass(frozen=True)
class AuditParams:
    """Every knob of an audit, with the defaults of the command line.

    ``link_mode``   ``dom``: parse the HTML; ``regex``: match anchor tags in the text.
    ``loc_mode``    ``xml``: parse sitemap documents; ``regex``: match ``<loc>`` tags.
    ``encode_mode`` ``quote``: leave ``%`` alone, unescape entities first;
                    ``uri``: encode ``%`` and brackets too, no unescaping.
    ``max_pages``, ``max_sitemaps``  budgets of a crawl; ``None`` for all there are.
    ``broadcast_bytes``  size up to which the list of wanted pages is broadcast as it is.
    """

    domains: tuple[str, ...] = ("example.com",)
    schemes: tuple[str, ...] = ("https",)
    max_pages: int | None = None
    max_sitemaps: int | None = None
    max_match_pages: int = 100
    min_variant_length: int = 6
    scan_body: bool = True
    respect_robots: bool = True
    longest_robots_match: bool = False
    link_mode: str = "dom"
    loc_mode: str = "xml"
    encode_mode: str = "quote"
    match_strategy: str = "auto"
    user_agent: str = USER_AGENT
    broadcast_bytes: int = 64 << 20

    @property
    def agent_token(self) -> str:
        return self.user_agent.split("/")[0].lower()
