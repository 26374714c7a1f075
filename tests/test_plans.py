"""How jobs run: scans, pruning, exchanges, what is read again."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hrefsieve.operators import sitemaps
from hrefsieve.operators.domains import domain_list
from hrefsieve.operators.sitemaps import closure_sql, discovered_pages, walk, written_edges
from hrefsieve.operators.variants import input_variants
from hrefsieve.params import AuditParams
from hrefsieve.plans import jobs
from hrefsieve.sources.seeds import domain_table
from tests.test_discovery import docs_of, urlset


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    """500 wanted pages among 20,000 landed ones, as a Parquet table."""
    path = str(tmp_path_factory.mktemp("pages") / "p")
    body = F.concat(F.lit("<a href='/go"), F.col("id") % 50, F.lit("'>x</a> target.example"))
    pages = spark.range(20_000).select(F.concat(F.lit("https://h.com/"), "id").alias("url"), body.alias("html"), F.lit(1).cast("long").alias("size_bytes"))
    pages.repartition(6).write.parquet(path)
    docs = docs_of(spark, {
        "https://h.com/robots.txt": "User-agent: *\nAllow: /\n",
        "https://h.com/sitemap.xml": urlset(*[f"https://h.com/{i}" for i in range(0, 20_000, 40)]),
    })
    inputs = spark.createDataFrame([(i, f"https://h.com/go{i}") for i in range(60)], "input_id bigint, queried_url string")
    return path, docs, inputs, AuditParams(domains=("h.com",))


@pytest.mark.parametrize("most", [64 << 20, 0])
@pytest.mark.parametrize("strategy", ["automaton", "windows"])
def test_pages_are_scanned_once(spark, site, monkeypatch, most, strategy):
    path, docs, inputs, p = site
    plans = []
    for name in ("cut", "cut_counted"):
        real = getattr(jobs, name)
        monkeypatch.setattr(jobs, name, lambda df, *a, real=real, **k: plans.append(plan_of(df)) or real(df, *a, **k))
    result = jobs.audit(inputs, spark.read.parquet(path), docs, replace(p, broadcast_bytes=most, match_strategy=strategy))
    assert sum(x.count(f"file:{path}") for x in [*plans, plan_of(result.report), plan_of(result.inventory)]) == 1
    assert result.inventory.count() == 500 and result.report.where("found").count() == 9  # go1 lies within go10


def test_a_large_list_of_pages_is_filtered_before_the_parser(spark, site):
    path, _, _, p = site
    pages = spark.read.parquet(path)
    wanted = pages.where(F.substring_index("url", "/", -1).cast("int") % 40 == 0).select("url")
    some, exact = jobs.wanted_pages(pages, wanted, {"n": 500, "bytes": 1}, replace(p, broadcast_bytes=0))
    assert not exact and some.join(wanted, "url", "left_semi").count() == 500 and some.count() <= 500 + 0.01 * 20_000
    plan = plan_of(jobs.page_blobs(some, "dom"))
    assert plan.index("_dom_links(") < plan.index("test(")  # plans print from the top
    assert "Exchange" not in plan


def test_the_summary_reads_no_output_again(spark, site):
    path, docs, inputs, p = site
    result = jobs.audit(inputs, spark.read.parquet(path), docs, p)
    only = replace(result, discovery=None, inventory=None, report=None)
    row = jobs.run_summary(only).first().asDict()
    assert row == {
        "candidate_sitemaps": 1, "sitemaps_processed": 1, "pages_collected": 500, "pages_scanned": 500, "inputs_matched": 9,
        "matched_preview": [f"https://h.com/go{i}" for i in (0, 1, 10, 2, 20, 3, 30, 4, 40)],
    }
    assert jobs.budget_flags(only, replace(p, max_pages=500)) == {"sitemap_budget_reached": False, "page_budget_reached": True}


def test_variants_take_one_exchange(spark):
    inputs = spark.createDataFrame([(i, f"https://h.com/{i % 9}") for i in range(50)], "input_id bigint, queried_url string")
    for mode in ("quote", "uri"):
        df = input_variants(inputs, mode)
        assert plan_of(df).count("Exchange hashpartitioning") == plan_of(df).count("Exchange") == 1
        assert df.select("queried_url").distinct().count() == 9


def scope(spark, n):
    domains = spark.createDataFrame([(i, f"d{i}.example.org" if i % 2 else f"e{i}.net") for i in range(n)], "pos int, domain string")
    locs = spark.range(40_000).select(F.lit("page").alias("kind"), F.concat(F.lit("https://www.d"), F.col("id"), F.lit(".example.org/p")).alias("loc"), F.lit(0).alias("depth"))
    return discovered_pages(locs, domain_list(domains))


def test_many_domains_make_no_larger_plan(spark):
    few, many = scope(spark, 4), scope(spark, 5_000)
    assert few.count() == 2 and many.count() == 2_500
    nodes = [len(re.findall(r"^[ :|+*()0-9-]*[A-Z]\w+", plan_of(x), re.M)) for x in (few, many)]
    assert nodes[0] == nodes[1] and len(plan_of(many)) < 1.1 * len(plan_of(few)) + 200


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_the_first_of_several_domains(spark, monkeypatch, most):
    monkeypatch.setattr("hrefsieve.operators.domains.BROADCAST_BYTES", most)
    listed = domain_list(domain_table(spark, ["b.com", "a.b.com", "x.a.b.com", "", "b.com", "h:80"]))
    assert listed.small == bool(most)
    urls = {"https://a.b.com/": "b.com", "https://B.com": "b.com", "https://xb.com": None, "https://b.com.": "", "http://x.a.b.com/y": "b.com",
            "http://h:80/": "h:80", "http://h/": None, "http://[": None, "mailto:a@b.com": None if most else None}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["domain"] for r in listed.keep(rows).collect()}
    assert {u: got.get(u) for u in urls if not u.startswith("mailto")} == {u: d for u, d in urls.items() if not u.startswith("mailto")}
    assert domain_list(domain_table(spark, [])).keep(rows).count() == 0


def test_a_level_reads_only_the_parts_of_its_sitemaps(spark):
    edges = written_edges(spark.range(20_000).select(F.concat(F.lit("u"), F.col("id") % 2_000).alias("parent"), F.lit("page").alias("kind"), F.concat(F.lit("p"), "id").alias("loc")))
    level = spark.createDataFrame([("u7",), ("u8",)], "url string")
    buckets = [r[0] for r in level.select(sitemaps._bucket("url")).collect()]
    near = sitemaps.edges_of(edges, level, buckets, True)
    filters = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan_of(near))[1]
    assert len(set(buckets)) == 2 and all(str(b) in filters for b in buckets) and re.search(r"bucket#\d+ IN \(", filters)
    assert near.count() == 20


def frames(spark, pairs):
    return written_edges(spark.createDataFrame([(a, "sitemap", b) for a, b in pairs], "parent string, kind string, loc string"))


def test_sql_closure_of_many_diamonds(spark):
    layers = [(f"{k}-{i}", f"{k + 1}-{j}") for k in range(20) for i in range(8) for j in range(8)]
    edges = frames(spark, [("root", f"0-{i}") for i in range(8)] + layers + [("20-3", "root"), ("20-3", "20-3")])
    seeds = spark.createDataFrame([("root",), ("alone",)], "url string")
    got = {tuple(r) for r in closure_sql(seeds, edges).collect()}
    assert got == {tuple(r) for r in walk(seeds, edges, []).sitemaps.collect()} and len(got) == 2 + 21 * 8


def test_sql_closure_beyond_a_million_rows(spark):
    node = lambda c: F.concat(F.lit("n"), c)
    ids = spark.range(510_000)
    edges = written_edges(ids.select(node(F.col("id")).alias("parent"), F.lit("sitemap").alias("kind"), F.explode(F.array(*[node(2 * F.col("id") + k) for k in (1, 2, 3)])).alias("loc")))
    seeds = spark.createDataFrame([("n0",)], "url string")
    sql, looped = closure_sql(seeds, edges), walk(seeds, edges, [])
    assert sql.count() == looped.n_sitemaps > 1_000_000
    assert sql.join(looped.sitemaps, ["url", "depth"]).count() == looped.n_sitemaps
