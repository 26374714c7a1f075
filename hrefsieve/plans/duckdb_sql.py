"""The registered queries as SQL for DuckDB, written apart from the Spark code."""

from __future__ import annotations

from hrefsieve.plans.derived import DOMAINS, HOST_ROBOTS, HOST_STATUS

_P = """p AS MATERIALIZED (
  SELECT page_id, url, html, scheme, host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain,
         regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]+)', 1) AS lang,
         regexp_replace(url, '#.*$', '') AS plain, scheme || '://' || host AS origin
  FROM (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
               regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages))"""

_INPUTS = """inputs AS MATERIALIZED (
  SELECT min(page_id) * 3 AS input_id, host AS queried_url FROM p GROUP BY host
  UNION ALL SELECT min(page_id) * 3 + 1, scheme || '://' || host || '/The' FROM p GROUP BY scheme, host
  UNION ALL SELECT min(page_id) * 3 + 2, url FROM p GROUP BY url
  UNION ALL SELECT -1 - min(page_id), host FROM p GROUP BY host)"""


def _short(col: str) -> str:
    """The forms of a defragmented URL."""
    no_www = f"regexp_replace({col}, '^([a-z]+://)www[.]', '\\1')"
    bare = "'^[a-z]+://', ''"
    return f"[{col}, regexp_replace({col}, {bare}), {no_www}, regexp_replace({no_www}, {bare})]"


def _encoded(value: str, keep: str) -> str:
    """Percent-encoding that keeps the given characters."""
    out = f"url_encode({value})"
    for ch in keep:
        if ch != "%":
            literal = "''" if ch == "'" else ch
            out = f"replace({out}, '%{ord(ch):02X}', '{literal}')"
    return f"replace({out}, '%25', '%')" if "%" in keep else out


_QUOTE_KEEPS = ":/?#[]@!$&'()*+,;=%"
_URI_KEEPS = ";,/?:@&=+$!*'()#"

_VARIANTS = f"""variants AS MATERIALIZED (
  SELECT DISTINCT queried_url, variant FROM (
    SELECT queried_url, unnest(list_concat([queried_url], {_short('cut')})) AS variant
    FROM (SELECT queried_url, regexp_replace(queried_url, '#.*$', '') AS cut FROM inputs))
  WHERE length(variant) >= 6)"""

_ANCHOR = """(?i)<a\\s+[^>]*href=["'']?([^"'' >]+)["'']?[^>]*>"""


def _blobs(source: str = "p", key: str = "url", body: bool = True) -> str:
    links = f"array_to_string(list_transform(regexp_extract_all(html, '{_ANCHOR}', 1), lambda h: origin || h), chr(10))"
    return f"blobs AS MATERIALIZED (SELECT {key} AS url, {links}{' || chr(10) || html' if body else ''} AS blob FROM {source})"


# A variant has no spaces or quotes, so it lies within one run of other characters, and it
# names a host: so six characters from where the host starts meet it by an equi-join.
_HITS = """runs AS MATERIALIZED (
  SELECT DISTINCT url, run FROM (SELECT url, unnest(string_split_regex(blob, '[ \\s"''<>]+')) AS run FROM blobs)
  WHERE regexp_matches(run, '[^.][.][^.]')),
grams AS MATERIALIZED (
  SELECT url, run, pos, substr(run, pos, 6) AS gram FROM (SELECT url, run, unnest(range(1, length(run) + 1)) AS pos FROM runs)),
cores AS MATERIALIZED (
  SELECT variant, length(lead) AS cut, substr(variant, length(lead) + 1, 6) AS gram FROM (
    SELECT DISTINCT variant, regexp_extract(variant, '^([a-z]+://)?(www[.])?', 0) AS lead FROM variants)),
hits AS MATERIALIZED (
  SELECT DISTINCT variant, url FROM grams JOIN cores USING (gram)
  WHERE pos > cut AND starts_with(substr(run, pos - cut), variant))"""


# For one page the runs are not worth their table.
_HITS_ON_ONE = """hits AS MATERIALIZED (
  SELECT v.variant, b.url FROM blobs b JOIN (SELECT DISTINCT variant FROM variants) v ON contains(b.blob, v.variant))"""


def _listed(n: int = 100) -> str:
    """Pages of each searched string that was found, numbered in order, the first ``n``."""
    return f"""listed AS MATERIALIZED (
  SELECT queried_url, url, place FROM (
    SELECT queried_url, url, row_number() OVER (PARTITION BY queried_url ORDER BY url) AS place
    FROM (SELECT DISTINCT queried_url, url FROM variants JOIN hits USING (variant)))
  WHERE place <= {n})"""


_MATCHED = """matched AS MATERIALIZED (
  SELECT queried_url, count(*) AS match_count, string_agg(url, chr(10) ORDER BY place) AS match_pages FROM listed GROUP BY queried_url)"""

_FLAT = """SELECT input_id, queried_url, true AS found, match_count, match_pages FROM inputs JOIN matched USING (queried_url)
UNION ALL
SELECT input_id, queried_url, false, 0, '' FROM inputs WHERE queried_url NOT IN (SELECT queried_url FROM matched)"""


def _wide(n: int) -> str:
    """The same with a column for each page."""
    pages = ", ".join(f"max(CASE WHEN place = {i} THEN url ELSE '' END) AS match_page_{i}" for i in range(1, n + 1))
    none = ", ".join("''" for _ in range(n))
    return f"""SELECT input_id, queried_url, true AS found, count(*) AS match_count, {pages}
FROM inputs JOIN listed USING (queried_url) GROUP BY input_id, queried_url
UNION ALL
SELECT input_id, queried_url, false, 0, {none} FROM inputs WHERE queried_url NOT IN (SELECT queried_url FROM listed)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def _audit(n: int = 100, body: bool = True) -> str:
    return _with(_P, _INPUTS, _VARIANTS, _blobs(body=body), _HITS, _listed(n), _MATCHED)


# The same with one lookup for all inputs.
_FLAT_JOINED = """SELECT i.input_id, i.queried_url, m.queried_url IS NOT NULL AS found, coalesce(m.match_count, 0) AS match_count,
  coalesce(m.match_pages, '') AS match_pages FROM inputs i LEFT JOIN matched m ON m.queried_url = i.queried_url"""


def _report(n: int = 100) -> str:
    return f"""report AS (
  SELECT input_id, i.queried_url, len(coalesce(ps, [])) > 0 AS found, CAST(len(coalesce(ps, [])) AS BIGINT) AS match_count,
         coalesce(ps, []) AS ps
  FROM inputs i LEFT JOIN (
    SELECT queried_url, list_sort(list_distinct(list(url)))[1:{n}] AS ps
    FROM variants JOIN hits USING (variant) GROUP BY queried_url) m ON m.queried_url = i.queried_url)"""


_ODD = """odd AS (SELECT plain || '/é b%[' || page_id || ']&amp;t=1#f' AS queried_url FROM p)"""

_OWN_LINKS = f"""own AS (SELECT url, plain, origin, regexp_extract_all(html, '{_ANCHOR}', 1) AS raw FROM p)"""
_LINK_ROWS = f"""{_with(_P, _OWN_LINKS, '''links AS (
  SELECT url, CAST(unnest(range(len(raw))) AS BIGINT) AS pos, origin || unnest(raw) AS href FROM own)''')}"""

_DIRS = """dirs AS (
  SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM (
    SELECT *, regexp_extract(plain, '^[a-z]+://[^/]*([^?]*)', 1) AS path FROM p))"""
_UP = "regexp_replace(dir, '[^/]+/$', '')"

_HOST_DOCS = f"""hr AS (
  SELECT host AS domain, 'https://' || host || '/robots.txt' AS robots_url, {HOST_STATUS} AS status, {HOST_ROBOTS} AS text
  FROM (SELECT host, min(page_id) AS m, arg_min(lang, page_id) AS lang FROM p GROUP BY host))"""
_ROBOT_BLOCKS = """raws AS (
  SELECT domain, unnest(range(len(ls))) AS line_no, unnest(ls) AS raw
  FROM (SELECT domain, string_split(text, chr(10)) AS ls FROM hr WHERE status = 200)),
keyed AS (
  SELECT domain, line_no, raw,
         CASE WHEN contains(content, ':') THEN lower(trim(regexp_extract(content, '^([^:]*):', 1))) END AS key,
         trim(regexp_extract(content, '^[^:]*:(.*)$', 1)) AS value
  FROM (SELECT *, trim(regexp_replace(raw, '#.*$', '')) AS content FROM raws)),
kinds AS (
  SELECT * FROM (SELECT *, CASE WHEN raw = '' THEN 'blank' WHEN key = 'user-agent' THEN 'agent'
    WHEN key IN ('allow', 'disallow', 'crawl-delay', 'request-rate') THEN 'rule' END AS kind FROM keyed) WHERE kind IS NOT NULL),
opened AS (
  SELECT *, CASE WHEN kind = 'agent' AND coalesce(lag(kind) OVER w, '') <> 'agent' THEN 1 ELSE 0 END AS opens,
         last_value(CASE WHEN kind <> 'rule' THEN kind END IGNORE NULLS) OVER w AS mark
  FROM kinds WINDOW w AS (PARTITION BY domain ORDER BY line_no)),
blocks AS (
  SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY line_no) AS block_id FROM opened),
live AS (SELECT * FROM blocks WHERE mark = 'agent' AND kind <> 'blank'),
rules AS (
  SELECT domain, CAST(block_id AS BIGINT) AS block_id, line_no AS rule_no, key = 'allow' OR value = '' AS allow,
         replace(url_encode(value), '%2F', '/') AS path
  FROM live WHERE key IN ('allow', 'disallow'))"""

# Locations by the rules the documents were made by; "well" marks those XML mode can read.
_LOCS = """chunks AS (SELECT DISTINCT domain, page_id // 20 AS c FROM p),
raw_locs AS (
  SELECT domain, page_id // 20 AS c, url AS loc FROM p
  UNION ALL SELECT domain, c, 'https://' || domain || '/sitemap-' || (c * 4 + i) || '.xml' FROM chunks, range(1, 5) t(i)
  UNION ALL SELECT domain, c, 'https://' || domain || '/a.pdf' FROM chunks
  UNION ALL SELECT domain, c, 'https://elsewhere.test/x' FROM chunks
  UNION ALL SELECT domain, c, 'https://' || domain || '/sitemap.xml' FROM chunks),
marked AS (
  SELECT 'https://' || domain || '/sitemap-' || c || '.xml' AS parent, loc, c % 5 = 2 AS prefixed,
         c % 5 = 2 OR NOT (c % 9 = 8 OR c % 7 = 6) AS well FROM raw_locs
  UNION ALL SELECT DISTINCT 'https://' || domain || '/sitemap.xml', 'https://' || domain || '/sitemap-0.xml', false, true FROM p),
locs AS (
  SELECT parent, CASE WHEN contains(loc, 'sitemap') THEN 'sitemap' ELSE 'page' END AS kind, loc FROM marked WHERE well)"""
_SEEDS = """seeds AS (
  SELECT DISTINCT 'https://' || domain || '/sitemap.xml' AS url FROM p UNION SELECT 'https://example.com/sitemap-1.xml')"""
_WALK = """walk(url, depth) USING KEY (url) AS (
  SELECT url, 0 FROM seeds
  UNION SELECT loc, w.depth + 1 FROM walk w JOIN locs ON parent = w.url AND kind = 'sitemap'
  WHERE NOT EXISTS (FROM recurring.walk r WHERE r.url = loc)),
sitemaps AS MATERIALIZED (SELECT url, CAST(depth AS BIGINT) AS depth FROM walk),
found AS (
  SELECT regexp_replace(loc, '#.*$', '') AS url, min(depth) AS depth FROM locs JOIN sitemaps s ON parent = s.url
  WHERE kind = 'page' AND NOT contains(loc, 'elsewhere.test') AND loc NOT LIKE '%.pdf' GROUP BY 1)"""
_CLOSURE = _with(_P, _LOCS, _SEEDS, _WALK, recursive=True)
_ALLOWED = """scanned AS (
  SELECT p.* FROM p WHERE plain IN (SELECT url FROM found) AND CASE domain
    WHEN 'example.com' THEN lang <> 'de' WHEN 'example.net' THEN lang <> 'es' ELSE false END)"""

_FULL = _with(
    _P, _LOCS, _SEEDS, _WALK, _ALLOWED, _INPUTS, _VARIANTS, _blobs("scanned", "plain"), _HITS, _listed(), _MATCHED, recursive=True
)
# What is left of the raw documents: cut off, failed and empty ones are not.
_RAW = """raws AS (
  SELECT url || CASE WHEN k IN (1, 4) THEN '.gz' ELSE '' END AS url, origin, CASE WHEN k = 5 THEN 'ab' || html ELSE html END AS html,
         octet_length(encode(html)) + CASE WHEN k = 5 THEN 4 ELSE 0 END AS size
  FROM (SELECT *, page_id % 8 AS k FROM p) WHERE k NOT IN (3, 6, 7))"""

ORACLES = {
    "audit_report": _audit() + _FLAT,
    "audit_report_dom": _audit() + _FLAT_JOINED,
    "audit_report_windows": _audit() + _FLAT,
    "audit_report_capped": _audit(5) + _FLAT,
    "audit_wide": _with(_P, _INPUTS, _VARIANTS, _blobs(), _HITS, _listed(10)) + _wide(10),
    "audit_links_only": _audit(body=False) + _FLAT_JOINED,
    "incremental_scan": _audit() + _FLAT,
    "incremental_changes": _audit() + _FLAT,
    "audit_raw_pages": _with(_P, _INPUTS, _VARIANTS, _RAW, _blobs("raws"), _HITS, _listed(), _MATCHED) + _FLAT,
    "raw_page_inventory": _with(_P, _RAW) + "SELECT url, CAST(size AS BIGINT) AS size_bytes FROM raws",
    "input_variants": _with(
        _P, _INPUTS, _ODD,
        "sources AS (SELECT queried_url FROM inputs UNION SELECT queried_url FROM odd)",
        "texts AS (SELECT queried_url, replace(queried_url, '&amp;', '&') AS u FROM sources)",
        f"""forms AS (SELECT queried_url, unnest(list_concat([queried_url, u], {_short("cut")})) AS v
             FROM (SELECT *, regexp_replace(u, '#.*$', '') AS cut FROM texts))""",
    ) + f"""SELECT DISTINCT queried_url, variant FROM (
              SELECT queried_url, v AS variant FROM forms UNION ALL SELECT queried_url, {_encoded('v', _QUOTE_KEEPS)} FROM forms)
            WHERE length(variant) >= 6""",
    "encode_uri_variants": _with(
        _P, _ODD,
        f"""forms AS (SELECT queried_url, unnest(list_concat([queried_url], {_short("cut")})) AS v
             FROM (SELECT *, regexp_replace(queried_url, '#.*$', '') AS cut FROM odd))""",
    ) + f"""SELECT DISTINCT queried_url, variant FROM (
              SELECT queried_url, v AS variant FROM forms UNION ALL SELECT queried_url, {_encoded('v', _URI_KEEPS)} FROM forms)""",
    "pattern_set": _with(_P, _INPUTS, _VARIANTS) + "SELECT DISTINCT variant FROM variants",
    "clean_inputs": "SELECT page_id AS input_id, url AS queried_url FROM pages WHERE page_id % 5 IN (0, 1, 3)",
    "unescaped_inputs": _with(_P) + """SELECT host || '/?a=1&amp;b=' || page_id || '&lt;&eacute;&#10;' AS queried_url,
              host || '/?a=1&b=' || page_id || '<é' || chr(10) AS unescaped FROM p""",
    "page_links": _LINK_ROWS + "SELECT * FROM links",
    "page_links_dom": _LINK_ROWS + "SELECT * FROM links",
    "page_link_counts": _LINK_ROWS + "SELECT href, count(*) AS links, count(DISTINCT url) AS linking_pages FROM links GROUP BY href",
    "edge_links": _with(
        _P, _DIRS,
        f"""extra AS (SELECT url, list_concat(list_transform(regexp_extract_all(html, '{_ANCHOR}', 1), lambda h: origin || h),
              [origin || dir || 'the,', origin || {_UP} || 'up/x?q=1&r=2', origin || path || '?q=2', 'mailto:b@c',
               scheme || '://other.test/p', plain]) AS ls FROM dirs)""",
    ) + "SELECT url, CAST(unnest(range(len(ls))) AS BIGINT) AS pos, unnest(ls) AS href FROM extra",
    "resolved_links": _with(
        _P, _DIRS,
        f"""pairs AS (SELECT url, ['the,', '../up/./x?q=1', '?q=2', '//other.test/p', 'mailto:b@c', 'http://[', '#f'] AS hs,
              [origin || dir || 'the,', origin || {_UP} || 'up/x?q=1', origin || path || '?q=2', scheme || '://other.test/p',
               'mailto:b@c', NULL, plain] AS ts FROM dirs)""",
    ) + "SELECT url, unnest(hs) AS href, unnest(ts) AS target FROM pairs",
    "domain_pages": _with(_P) + """SELECT url FROM p WHERE host = 'example.com' OR host LIKE '%.example.com'
              OR host = 'thther.example.org' OR host LIKE '%.thther.example.org'""",
    "domain_of_page": _with(
        _P,
        """parents AS (
          SELECT regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS d, min(page_id) * 2 AS pos FROM p GROUP BY 1
          UNION ALL SELECT domain, min(page_id) * 2 + 1 FROM p GROUP BY domain)""",
    ) + """SELECT url, host, arg_min(d, pos) AS domain FROM p JOIN parents ON d <> '' AND (host = d OR host LIKE '%.' || d)
           GROUP BY url, host""",
    "binary_filter": _with(_P) + """SELECT origin || '/f' || page_id || ['.PDF?v=1', '.pdf;v=1', '?f=b.pdf', '.jpeg#x', '.html', '.woff2', '/pdf'][page_id % 7 + 1]
              AS link, page_id % 7 IN (0, 1, 3, 5) AS is_binary FROM p""",
    "sitemap_like": _with(_P) + """SELECT origin || '/' || page_id || '/' || ['feed.xml', 'feed.xml?p=1', '?s%69temap=1', 'My-Sitemap/', '?s%69temap=', 'p.XML.gz', 'page'][page_id % 7 + 1]
              AS link, page_id % 7 IN (0, 2, 3, 5) AS is_sitemap FROM p""",
    "robots_rules": _with(_P, _HOST_DOCS, _ROBOT_BLOCKS) + """SELECT r.domain, r.block_id, l.value AS agent, rule_no, allow, path
              FROM rules r JOIN live l ON l.domain = r.domain AND l.block_id = r.block_id AND l.kind = 'agent'""",
    "robots_admission": _with(
        _P, _HOST_DOCS, _ROBOT_BLOCKS,
        """groups AS (
          SELECT domain, block_id, bool_or(kind = 'agent' AND value = '*') AS is_default,
                 bool_or(kind = 'agent' AND contains('url-scanner', lower(value))) AS named
          FROM live GROUP BY domain, block_id HAVING bool_or(kind = 'rule')),
        chosen AS (
          SELECT domain, coalesce(min(block_id) FILTER (named AND NOT is_default), min(block_id) FILTER (is_default)) AS block_id
          FROM groups GROUP BY domain),
        bound AS (SELECT r.* FROM rules r JOIN chosen c ON c.domain = r.domain AND c.block_id = r.block_id),
        targets AS (
          SELECT url, host, replace(url_encode(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1)), '%2F', '/') AS target FROM p),
        first_hit AS (
          SELECT url, arg_min(allow, rule_no) AS allow FROM targets JOIN bound ON domain = host
            AND (path = '*' OR starts_with(target, path)) GROUP BY url)""",
    ) + """SELECT t.url, t.host AS domain, CASE status WHEN 403 THEN false WHEN 404 THEN true ELSE coalesce(allow, true) END AS allowed
           FROM targets t JOIN hr ON hr.domain = t.host LEFT JOIN first_hit f ON f.url = t.url""",
    "robots_sitemaps": _with(_P, _HOST_DOCS) + """SELECT DISTINCT robots_url, url FROM (
              SELECT robots_url, trim(regexp_extract(raw, '^[^:]*:(.*)$', 1)) AS url
              FROM (SELECT robots_url, unnest(string_split(text, chr(10))) AS raw FROM hr WHERE status = 200)
              WHERE lower(raw) LIKE 'sitemap:%') WHERE url <> ''""",
    "candidate_sitemaps": _with(_P, _HOST_DOCS) + """SELECT trim(regexp_extract(raw, '^[^:]*:(.*)$', 1)) AS url
              FROM (SELECT unnest(string_split(text, chr(10))) AS raw FROM hr WHERE status = 200)
              WHERE regexp_matches(raw, '(?i)^sitemap: *[^ ]')
              UNION SELECT s || '://' || domain || '/sitemap.xml' FROM hr, (VALUES ('https'), ('http')) t(s)""",
    "sitemap_locs": _with(_P, _LOCS) + "SELECT parent, kind, loc FROM locs",
    "sitemap_locs_regex": _with(_P, _LOCS) + """SELECT parent, CASE WHEN contains(loc, 'sitemap') THEN 'sitemap' ELSE 'page' END AS kind,
              replace(loc, '&', '&amp;') AS loc FROM marked WHERE NOT prefixed""",
    "edge_locs": _with(_P, _LOCS) + """SELECT parent, count(*) FILTER (kind = 'page') AS pages, count(*) FILTER (kind = 'sitemap') AS sitemaps,
              count(*) FILTER (loc = '') AS blank FROM locs GROUP BY parent""",
    "sitemap_closure": _CLOSURE + "SELECT url, depth FROM sitemaps",
    "sitemap_closure_sql": _CLOSURE + "SELECT url FROM sitemaps",
    "sitemap_budget": _CLOSURE + "SELECT url FROM sitemaps ORDER BY depth, url LIMIT 12",
    "discovered_pages": _CLOSURE + "SELECT url FROM found",
    "page_budget": _CLOSURE + "SELECT url FROM found ORDER BY depth, url LIMIT 45",
    "page_inventory": _with(_P) + "SELECT url, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM p",
    "crawl_inventory": _with(_P, _LOCS, _SEEDS, _WALK, _ALLOWED, recursive=True)
    + "SELECT plain AS url, CAST(max(octet_length(encode(html))) AS BIGINT) AS size_bytes FROM scanned GROUP BY plain",
    "full_audit": _FULL + _FLAT,
    "full_audit_filtered": _FULL + _FLAT,
    "run_summary": _with(
        _P, _LOCS, _SEEDS, _WALK, _ALLOWED, _INPUTS, _VARIANTS, _blobs("scanned", "plain"), _HITS, _report(), recursive=True
    ) + """SELECT (SELECT count(*) FROM seeds) AS candidate_sitemaps, (SELECT count(*) FROM sitemaps) AS sitemaps_processed,
              (SELECT count(*) FROM found) AS pages_collected, (SELECT count(DISTINCT plain) FROM scanned) AS pages_scanned,
              (SELECT count(DISTINCT queried_url) FROM report WHERE found) AS inputs_matched,
              (SELECT array_to_string(list_sort(list_distinct(list(queried_url) FILTER (found)))[1:10], chr(10)) FROM report) AS matched_preview""",
    "single_page_check": _with(
        _P, "one AS (SELECT * FROM p WHERE url = (SELECT min(url) FROM pages))", _INPUTS, _VARIANTS, _blobs("one"), _HITS_ON_ONE, _listed(1), _MATCHED
    ) + _FLAT,
    "report_summary": _with(_P, _INPUTS, _VARIANTS, _blobs(), _HITS, _report()) + """SELECT count(*) AS inputs, count(DISTINCT queried_url) AS distinct_inputs,
              count(DISTINCT CASE WHEN found THEN queried_url END) AS inputs_matched, CAST(sum(match_count) AS BIGINT) AS pages_listed FROM report""",
    "matched_preview": _with(_P, _INPUTS, _VARIANTS, _blobs(), _HITS, _report()) + "SELECT DISTINCT queried_url FROM report WHERE found ORDER BY queried_url LIMIT 10",
    "pattern_page_sets": _with(_P, _INPUTS, _VARIANTS, _blobs(), _HITS) + """SELECT variant AS pattern, CAST(len(ps) AS BIGINT) AS n_pages,
              array_to_string(ps, chr(10)) AS pages FROM (SELECT variant, list_sort(list(url))[1:20] AS ps FROM hits GROUP BY variant)""",
    "passage_containment": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)",
    "bytes_to_text": """SELECT url || CASE WHEN k IN (1, 4) THEN '.gz' ELSE '' END AS url, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest
              FROM (SELECT url, page_id % 8 AS k, CASE WHEN page_id % 8 = 5 THEN 'ab' || html ELSE html END AS t FROM pages)
              WHERE k NOT IN (3, 6, 7)""",
    "header_types": """SELECT CASE WHEN page_id % 8 = 2 THEN 'application/x-gzip' ELSE '' END AS content_type,
              CAST(CASE WHEN page_id % 8 = 6 THEN 500 ELSE 200 END AS BIGINT) AS status, count(*) AS docs FROM pages GROUP BY 1, 2""",
    "sorted_url_list": _with(_P) + "SELECT DISTINCT plain AS url FROM p ORDER BY url",
}

assert set(DOMAINS) == {"example.com", "example.net", "example.org"}
