import gzip
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hrefsieve.operators.sitemaps import discovered_pages, document_locs, page_budget, sitemap_closure
from hrefsieve.plans.jobs import audit, crawl_inventory, discover, robots_of_domains, run_summary
from hrefsieve.params import AuditParams
from hrefsieve.session import checkpoint_dir, first_rows, with_row_index
from hrefsieve.sources.landed import landed_pages, text_documents
from hrefsieve.sources.seeds import base_urls, candidate_sitemaps, domain_table

RAW = "url string, status int, headers map<string,string>, body binary"
NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def urlset(*locs):
    return f"<urlset {NS}>" + "".join(f"<url><loc> {x} </loc></url>" for x in locs) + "</urlset>"


def docs_of(spark, documents):
    rows = []
    for url, doc in documents.items():
        status, body = doc if isinstance(doc, tuple) else (200, doc)
        rows.append((url, status, {}, bytearray(body if isinstance(body, bytes) else body.encode())))
    return spark.createDataFrame(rows, RAW)


SITE = {
    "https://h.com/robots.txt": "User-agent: *\nDisallow: /private\nsitemap: https://h.com/a.xml\nSitemap:\n",
    "https://h.com/sitemap.xml": index("https://h.com/a.xml", "https://h.com/b", "https://h.com/sitemap.xml"),
    "https://h.com/a.xml": urlset("https://h.com/1#x", "https://h.com/1", "https://h.com/f.pdf", "https://other.com/2", "https://h.com/deep.xml.gz"),
    "https://h.com/b": urlset("https://w.h.com/3", "https://h.com/deep.xml.gz", "https://h.com/missing.xml", "https://h.com/bad.xml", "https://h.com/private/x"),
    "https://h.com/deep.xml.gz": gzip.compress(urlset("https://h.com/4?a=1&amp;b=2", "https://h.com/sitemap.xml", "https://h.com/last.xml").encode()),
    "https://h.com/last.xml": urlset("https://h.com/5"),
    "https://h.com/bad.xml": "<urlset><url><loc>https://h.com/6</loc></url>",
    "https://h.com/failed.xml": (500, urlset("https://h.com/7")),
}
REACHED = {"sitemap.xml", "a.xml", "b", "deep.xml.gz", "missing.xml", "bad.xml", "last.xml"}


@pytest.fixture(scope="module")
def site(spark):
    return docs_of(spark, SITE).repartition(3).cache()


def seeds(spark, docs):
    return candidate_sitemaps(domain_table(spark, ["h.com"]), docs, ["https"])


def urls(df, column="url"):
    return sorted(r[column] for r in df.collect())


def test_candidates_and_bases(spark, site):
    assert urls(seeds(spark, site)) == ["https://h.com/a.xml", "https://h.com/sitemap.xml"]
    bases = base_urls(domain_table(spark, ["a", "b"]), ["https", "http"])
    assert urls(bases, "base") == ["http://a", "http://b", "https://a", "https://b"]


def test_closure_with_cycle_diamond_missing_and_malformed(spark, site):
    walk = sitemap_closure(seeds(spark, site), site, ["h.com"])
    assert {u.removeprefix("https://h.com/") for u in urls(walk.sitemaps)} == REACHED
    assert walk.sitemaps.count() == len(REACHED)
    pages = discovered_pages(walk.locs, ["h.com"])
    assert urls(pages) == ["https://h.com/1", "https://h.com/4?a=1&b=2", "https://h.com/5", "https://h.com/private/x", "https://w.h.com/3"]
    assert urls(page_budget(pages, 3)) == ["https://h.com/1", "https://h.com/4?a=1&b=2", "https://h.com/private/x"]


@pytest.mark.parametrize("cap", [0, 1, 2, 3, 5, 6, 7, 100])
def test_sitemap_budget_counts_every_lookup(spark, site, cap):
    walk = sitemap_closure(seeds(spark, site), site, ["h.com"], max_sitemaps=cap)
    by_depth = [["a.xml", "sitemap.xml"], ["b", "deep.xml.gz"], ["bad.xml", "last.xml", "missing.xml"]]
    order = ["https://h.com/" + u for level in by_depth for u in level]
    assert urls(walk.sitemaps) == sorted(order[:cap])


def test_page_budget_stops_the_walk(spark, site):
    walk = sitemap_closure(seeds(spark, site), site, ["h.com"], max_pages=1)
    assert walk.depth == 1
    assert urls(page_budget(discovered_pages(walk.locs, ["h.com"]), 1)) == ["https://h.com/1"]


def test_no_domains_means_nothing(spark, site):
    assert sitemap_closure(seeds(spark, site), site, []).locs.count() > 0
    assert discover(site, AuditParams(domains=())).pages.count() == 0


def test_regex_locs(spark):
    docs = docs_of(spark, {"i": index("https://h/p", "https://h/s.xml"), "bad": "﻿<a><LOC> https://h/6&amp;x </LOC><loc> </loc>", "no": "x<loc>y</loc>"})
    got = sorted(map(tuple, document_locs(text_documents(docs, False, True), "regex").collect()))
    assert got == [("bad", "page", "https://h/6&amp;x"), ("i", "page", "https://h/p"), ("i", "sitemap", "https://h/s.xml")]


def test_xml_locs(spark):
    docs = docs_of(spark, {
        "prefixed": '<s:urlset xmlns:s="u"><s:url><s:loc>https://h/1</s:loc></s:url></s:urlset>',
        "nested": "<feed><x><url><loc>https://h/2</loc><image><loc>https://h/no</loc></image></url></x></feed>",
        "case": "<SitemapIndex><sitemap><loc>https://h/3</loc></sitemap><url><loc>https://h/no</loc></url></SitemapIndex>",
        "blank": " \n<urlset><url><loc></loc></url><url><loc> </loc></url><url/></urlset>",
        "bom": "﻿<urlset><url><loc>https://h/no</loc></url></urlset>",
    })
    got = sorted(map(tuple, document_locs(text_documents(docs)).collect()))
    assert got == [("case", "sitemap", "https://h/3"), ("nested", "page", "https://h/2"), ("prefixed", "page", "https://h/1")]


@pytest.fixture(scope="module")
def pages(spark):
    body = '<a href="/go">x</a> see https://target.example/é&amp;b and target.example'
    names = ["https://h.com/1", "https://w.h.com/3", "https://h.com/4?a=1&b=2", "https://h.com/private/x", "https://h.com/unlisted", "https://h.com/5"]
    return landed_pages(docs_of(spark, {u: (200, "" if u.endswith("/5") else body) for u in names})).cache()


INPUTS = ["target.example", "https://h.com/go", "target.example", "nowhere.example", "abc", "https://target.example/é&amp;b"]


def test_full_audit(spark, site, pages):
    inputs = spark.createDataFrame(list(enumerate(INPUTS)), "input_id bigint, queried_url string")
    p = AuditParams(domains=("h.com",))
    result = audit(inputs, pages, site, p)
    got = {r["input_id"]: (r["queried_url"], r["found"], r["match_count"], r["pages"]) for r in result.report.collect()}
    three = ["https://h.com/1", "https://h.com/4?a=1&b=2", "https://w.h.com/3"]
    assert got[0] == ("target.example", True, 3, three) and got[2] == got[0]
    assert got[1] == ("https://h.com/go", True, 3, three)  # without its scheme it is part of w.h.com/go too
    assert got[3] == ("nowhere.example", False, 0, []) and got[4] == ("abc", False, 0, [])
    assert got[5][1:] == (True, 3, three)
    assert sorted(urls(result.inventory)) == three
    row = run_summary(result).first()
    assert (row["candidate_sitemaps"], row["sitemaps_processed"], row["pages_collected"], row["pages_scanned"]) == (2, 7, 5, 3)
    assert row["inputs_matched"] == 3
    assert row["matched_preview"] == ["https://h.com/go", "https://target.example/é&amp;b", "target.example"]

    again = audit(inputs, pages, site, replace(p, broadcast_bytes=0))
    assert sorted(map(str, again.report.collect())) == sorted(map(str, result.report.collect()))
    assert urls(again.inventory) == three


def test_copies_count_once(spark, site, pages):
    inputs = spark.createDataFrame(list(enumerate(INPUTS)), "input_id bigint, queried_url string")
    p = AuditParams(domains=("h.com",))
    once, thrice = audit(inputs, pages, site, p), audit(inputs, pages.union(pages).union(pages), site.union(site), p)
    assert sorted(map(str, thrice.report.collect())) == sorted(map(str, once.report.collect()))
    assert sorted(map(str, thrice.inventory.collect())) == sorted(map(str, once.inventory.collect()))


def test_robots_can_be_ignored_and_missing_robots_deny(spark, site, pages):
    p = AuditParams(domains=("h.com",), respect_robots=False)
    assert "https://h.com/private/x" in urls(crawl_inventory(pages, site, p))
    bare = site.where(~F.col("url").endswith("robots.txt"))
    assert crawl_inventory(pages, bare, AuditParams(domains=("h.com",))).count() == 0
    assert robots_of_domains(bare, p).first()["status"] == 0


def test_row_index_and_first_rows(spark):
    frame = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("v"), "id").repartition(7)
    got = [(r["row_index"], r["v"], r["id"]) for r in with_row_index(frame, [F.col("v"), F.col("id")]).orderBy("row_index").collect()]
    want = sorted((r["v"], r["id"]) for r in frame.collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    order = [F.col("v"), F.col("id")]
    for n in (0, 1, 777, 9_999):
        assert sorted(r["id"] for r in first_rows(frame, order, n, small=0).collect()) == sorted(w[1] for w in want[:n])


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert checkpoint_dir(Session()) == "hdfs:///shared"


def test_walks_beyond_the_usual_budgets(spark):
    """Thousands of sitemaps in four levels: all are found, and documents are read once."""
    from hrefsieve.operators.sitemaps import discovered_pages, sitemap_closure

    def index(name, children):
        return f"https://big.com/{name}.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://big.com/{c}.xml</loc></sitemap>" for c in children) + "</sitemapindex>"

    rows = [index("sitemap", [f"a{i}" for i in range(10)])]
    rows += [index(f"a{i}", [f"b{i}-{j}" for j in range(10)] + ["sitemap"]) for i in range(10)]
    rows += [index(f"b{i}-{j}", [f"c{i}-{j}-{k}" for k in range(60)]) for i in range(10) for j in range(10)]
    rows += [
        (f"https://big.com/c{i}-{j}-{k}.xml", "<urlset>" + "".join(f"<url><loc>https://big.com/p/{i}/{j}/{k}/{n}</loc></url>" for n in range(4)) + "</urlset>")
        for i in range(10) for j in range(10) for k in range(60)
    ]
    docs = docs_of(spark, dict(rows))
    seeds = spark.createDataFrame([("https://big.com/sitemap.xml",)], "url string")
    walk = sitemap_closure(seeds, docs, ["big.com"])
    assert walk.sitemaps.count() == len(rows) == 6111 and walk.depth == 4
    assert discovered_pages(walk.locs, ["big.com"]).count() == 24_000
