import csv
import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hrefsieve.operators.links import page_blobs, page_links, with_links
from hrefsieve.operators.report import matched_inputs, matched_preview, report, summary, wide
from hrefsieve.operators.variants import input_variants
from hrefsieve.params import AuditParams
from hrefsieve.plans.jobs import audit_pages, check_page
from hrefsieve.sinks import writers
from hrefsieve.sources.inputs import no_inputs, read_inputs
from hrefsieve.sources.landed import read_landed

GOLDEN = {
    "https://www.example.com/a?x=1&amp;y=2#frag": {
        "https://www.example.com/a?x=1&amp;y=2#frag", "https://www.example.com/a?x=1&y=2#frag", "https://www.example.com/a?x=1&y=2",
        "www.example.com/a?x=1&y=2", "https://example.com/a?x=1&y=2", "example.com/a?x=1&y=2",
    },
    "www.example.com": {"www.example.com"},
    "a.co": set(),
    "https://x.io/é": {"https://x.io/é", "x.io/é", "https://x.io/%C3%A9", "x.io/%C3%A9"},
    "HTTPS://x.io/?u=https://y": {"HTTPS://x.io/?u=https://y", "HTTPS://x.io/?u=y"},
    "http://[bad/x": {"http://[bad/x"},
    "//www.x.io/p": {"//www.x.io/p", "//x.io/p"},
    "https://www./": {"https://www./", "https:///"},
}


def test_variant_goldens(spark):
    inputs = spark.createDataFrame(list(enumerate(GOLDEN)), "input_id bigint, queried_url string")
    got = {u: set() for u in GOLDEN}
    for r in input_variants(inputs).collect():
        got[r["queried_url"]].add(r["variant"])
    assert got == GOLDEN


def test_uri_variants(spark):
    inputs = spark.createDataFrame([(0, "https://www.X.io:8080/a%[é]&amp;#f")], "input_id bigint, queried_url string")
    cut = "www.X.io:8080/a%[é]&amp;"
    enc = "www.X.io:8080/a%25%5B%C3%A9%5D&amp;"
    got = {r["variant"] for r in input_variants(inputs, "uri").collect()}
    # the lower-cased host does not occur in the text, so it is not shortened
    assert got == {f"https://{cut}#f", f"https://{cut}", cut, f"https://{enc}#f", f"https://{enc}", enc}


def pages_frame(spark, html, url="https://example.com/es/12?u=1"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_dom_links(spark):
    html = (
        '<!-- <a href="/c"> --><script>"<a href=/s>"</script><A HREF=the,>1</A><a href="/de">2</a><a href="#top">3</a><a href="">4</a><a href>5</a>'
        '<a href="mailto:b@c">6</a><a href="http://[">7</a><a href="/x?a=1&amp;b=2">8</a><a href="/one" href="/two">9</a><link href="/l"><a name="n">'
    )
    want = ["https://example.com/es/the,", "https://example.com/de", "https://example.com/es/12?u=1", "mailto:b@c", "https://example.com/x?a=1&b=2", "https://example.com/two"]
    assert with_links(pages_frame(spark, html)).first()["hrefs"] == want
    page = "https://example.com/es/12?u=1"
    assert with_links(pages_frame(spark, html), keep_empty=True).first()["hrefs"] == want[:3] + [page, page] + want[3:]


def test_regex_links(spark):
    html = "<!-- <a href=/c> --><a data-href='/d'><A\n class=x HREF='the,'>1</A><a href=\"/x?a=1&amp;b=2\"><a href=\"\"><area href='/no'>"
    got = [r["href"] for r in page_links(pages_frame(spark, html), "regex").orderBy("pos").collect()]
    assert got == ["https://example.com/c", "https://example.com/d", "https://example.com/es/the,", "https://example.com/x?a=1&amp;b=2"]


@pytest.mark.parametrize("mode,body,keep,want", [
    ("dom", True, False, "<p>"), ("dom", False, False, ""), ("dom", True, True, "\n<p>"), ("regex", True, False, "\n<p>"), ("regex", False, False, ""),
])
def test_blob_of_a_page_without_links(spark, mode, body, keep, want):
    assert page_blobs(pages_frame(spark, "<p>"), mode, body, keep).first()["blob"] == want


def test_pattern_across_link_lines(spark):
    inputs = spark.createDataFrame([(0, "https://h.com/a&#10;https://h.com/b")], "input_id bigint, queried_url string")
    pages = pages_frame(spark, '<a href="/a">x</a><a href="/b">y</a>', "https://h.com/")
    assert audit_pages(inputs, pages, AuditParams()).first()["found"]


@pytest.fixture(scope="module")
def small(spark):
    inputs = spark.createDataFrame([(0, "bbbbbb"), (1, "aaaaaa"), (2, "bbbbbb"), (3, "zzzzzz")], "input_id bigint, queried_url string")
    hits = spark.createDataFrame([("aaaaaa", f"p{i}") for i in (3, 1, 2, 1)] + [("bbbbbb", "p,\"9")], "pattern string, url string")
    return inputs, input_variants(inputs), hits


def test_report_invariants(small):
    rows = report(*small, n=2).orderBy("input_id").collect()
    assert [(r["queried_url"], r["found"], r["match_count"], r["pages"]) for r in rows] == [
        ("bbbbbb", True, 1, ['p,"9']), ("aaaaaa", True, 2, ["p1", "p2"]), ("bbbbbb", True, 1, ['p,"9']), ("zzzzzz", False, 0, []),
    ]
    full = report(*small)
    assert summary(full).first().asDict() == {"inputs": 4, "distinct_inputs": 3, "inputs_matched": 2, "pages_listed": 5}
    assert sorted(r[0] for r in matched_inputs(full).collect()) == ["aaaaaa", "bbbbbb"]
    assert [r[0] for r in matched_preview(full, 1).collect()] == ["aaaaaa"]
    for r in wide(full, 5).collect():
        assert sum(r[f"match_page_{i}"] != "" for i in range(1, 6)) == r["match_count"] and r["found"] == (r["match_count"] > 0)


def test_hot_keys_spread_without_changing_the_report(small, monkeypatch):
    inputs, variants, hits = small
    want = sorted(map(str, report(inputs, variants, hits).collect()))
    monkeypatch.setattr("hrefsieve.session.HOT_ROWS", 1)
    assert sorted(map(str, report(inputs, variants, hits).collect())) == want


def read_csv(path):
    out = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            rows = list(csv.reader(f))
            out += rows if not out else rows[1:]
    return out


def test_written_outputs(spark, small, tmp_path):
    writers.write_report(report(*small), str(tmp_path / "r.csv"), 3)
    assert read_csv(tmp_path / "r.csv") == [
        ["queried_url", "found", "match_count", "match_page_1", "match_page_2", "match_page_3"],
        ["bbbbbb", "true", "1", 'p,"9', "", ""], ["aaaaaa", "true", "3", "p1", "p2", "p3"],
        ["bbbbbb", "true", "1", 'p,"9', "", ""], ["zzzzzz", "false", "0", "", "", ""],
    ]
    urls = spark.createDataFrame([(u,) for u in "bcabé"], "url string")
    writers.write_urls(urls, str(tmp_path / "u.txt"))
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/u.txt/part-*")) for x in open(p, encoding="utf-8").read().splitlines()]
    assert lines == ["a", "b", "c", "é"]
    writers.write_inventory(spark.createDataFrame([("u", 5)], "url string, size_bytes long"), str(tmp_path / "i.csv"))
    assert read_csv(tmp_path / "i.csv") == [["url", "size_bytes"], ["u", "5"]]


def test_paths():
    now = datetime(2024, 1, 31, 23, 59, 58)
    assert writers.run_stamp(now=now) == "20240131_235958" and writers.run_stamp(True, now) == "20240131T235958"
    assert writers.run_folder("out/list.csv", "S") == "out/output_S" and writers.run_folder("list.csv", "S") == "./output_S"
    assert writers.stamped_path("x/list.csv", "f", "S") == "f/list_S.csv"


def test_read_inputs(spark, tmp_path):
    (tmp_path / "in.csv").write_text(" b \r\n\n\ta,\"c\"\r \nb\n" + "".join(f"line{i}\n" for i in range(3000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_inputs(spark, str(tmp_path / "in.csv")).orderBy("input_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["queried_url"] for r in rows] == ["b", 'a,"c"', "b"] + [f"line{i}" for i in range(3000)]
    assert no_inputs(spark).count() == 0


def test_single_page_check(spark):
    inputs = spark.createDataFrame([(0, "https://h.com/go"), (1, "nowhere"), (2, "https://h.com/x")], "input_id bigint, queried_url string")
    pages = spark.createDataFrame([("https://h.com/x", '<a href="go">1</a><a href="">2</a>'), ("https://h.com/y", "nowhere")], "url string, html string")
    for mode in ("dom", "regex"):
        rows = check_page(inputs, pages, "https://h.com/x", AuditParams(link_mode=mode, scan_body=False)).orderBy("input_id").collect()
        # an empty link stands for the page itself, in the parsed form only
        assert [(r["found"], r["pages"]) for r in rows] == [(True, ["https://h.com/x"]), (False, []), (mode == "dom", ["https://h.com/x"] if mode == "dom" else [])]
    assert check_page(inputs, pages, "https://h.com/none", AuditParams()).where("found").count() == 0


def test_partitioning_and_order_do_not_matter(spark, small):
    inputs, variants, hits = small
    want = sorted(map(str, report(inputs, variants, hits).collect()))
    got = report(inputs.orderBy(F.rand(1)), variants.repartition(3), hits.repartition(5).orderBy(F.rand(2)))
    assert sorted(map(str, got.collect())) == want


def exchanged_columns(df):
    """Columns of every shuffle of a plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = plan.split("\n\n")
    return [b for b in blocks if " Exchange" in b.split("\n")[0] or ") Exchange" in b]


def test_page_text_never_shuffles(spark, tmp_path):
    rows = [(f"https://h.com/{i}", f"<a href='/l{i % 4}'>common{i % 2}</a>") for i in range(64)]
    spark.createDataFrame(rows, "url string, html string").repartition(16).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # one split per file, as in a large table
    try:
        pages = read_landed(spark, str(tmp_path / "p"))
        inputs = spark.createDataFrame([(i, f"common{i}") for i in range(40)], "input_id bigint, queried_url string")
        for strategy in ("automaton", "windows"):
            for mode in ("dom", "regex"):
                df = audit_pages(inputs, pages, AuditParams(match_strategy=strategy, link_mode=mode))
                shuffles = exchanged_columns(df)
                assert shuffles and not [b for b in shuffles if "html#" in b or "blob#" in b]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scans_read_only_what_they_need(spark):
    from hrefsieve.plans.registered import QUERIES

    def plan(name):
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "html" not in plan("domain_of_page") and "html" not in plan("domain_pages") and "html" not in plan("input_variants")
    assert "lang" not in plan("passage_containment")


def test_the_driver_lets_go_of_what_nothing_uses(spark, monkeypatch):
    from types import SimpleNamespace as Fake

    from hrefsieve import session

    collected = []

    def driver(taken):
        heap = Fake(totalMemory=lambda: taken, maxMemory=lambda: 100)
        lang = Fake(Runtime=Fake(getRuntime=lambda: heap), System=Fake(gc=lambda: collected.append(taken)))
        return Fake(_jvm=Fake(java=Fake(lang=lang)))

    for taken in (10, 59, 61, 100):
        session.release_unused(driver(taken))
    assert collected == [61, 100]

    asked = []
    monkeypatch.setattr(session, "release_unused", asked.append)
    assert session.cut(spark.range(3)).count() == 3
    assert session.cut_counted(spark.range(3))[1]["n"] == 3
    assert len(asked) == 2
